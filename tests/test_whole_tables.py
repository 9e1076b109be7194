"""Queries over whole tables that have no SQL, against brute force."""

import itertools

import numpy as np

from lodestone.operators.selection import diversity, top_jaccard
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


def test_diversity_of_all_vectors(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], [float(x) for x in r[1]]) for r in t.collect()]
    for data in (rows, [*rows[:30], (rows[0][0], rows[5][1]), (900, [0.0] * len(rows[0][1])), (901, [1.0, 2.0]), (902, [2.0, 1.0])]):
        cos = [0.0 if len(x) != len(y) or not np.any(x) or not np.any(y) else np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) for (i, x), (j, y) in itertools.combinations(data, 2) if i != j]
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        assert abs(diversity(df, "vec_id", "embedding").first()[0] - (1 - np.mean(cos))) < 1e-9
    assert registry.QUERIES["pairwise_diversity"](spark, SF).count() == 1


def test_most_similar_pairs_of_all_rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, [str(x) for x in rng.permutation(40)[: rng.integers(3, 30)]]) for i in range(120)]
    data += [(500, data[7][1]), (501, data[90][1][1:]), (502, []), (503, None)]
    df = spark.createDataFrame(data, "doc_id long, t array<string>")
    score = lambda x, y: round(len(set(x) & set(y)) / max(1, len(set(x) | set(y))), 6)
    want = sorted((-score(x or [], y or []), a, b) for (a, x), (b, y) in itertools.combinations(data, 2))
    for k in (2, 20, 300):
        got = sorted((-r.score, r.a, r.b) for r in top_jaccard(df, "doc_id", "t", k).collect())
        assert got == want[:k]
    few = top_jaccard(df.where("doc_id in (1, 502, 503)"), "doc_id", "t", 5)
    assert few.count() == 3


def test_most_similar_pairs_of_all_documents(spark):
    import re

    d = {r.doc_id: set(re.findall("[a-z0-9_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}
    score = lambda x, y: round(len(x & y) / max(1, len(x | y)), 6)
    want = sorted((-score(d[a], d[b]), a, b) for a, b in itertools.combinations(sorted(d), 2))[:20]
    assert [(-r.score, r.a, r.b) for r in registry.QUERIES["jaccard_pairs"](spark, SF).collect()] == want


def test_no_query_reads_a_subset_of_ids():
    import inspect
    import re

    for name, f in registry.QUERIES.items():
        text = inspect.getsource(f) + registry.ORACLE_SQL.get(name, "")
        found = re.findall(r"(?:doc_id|vec_id|l_partkey|o_custkey|c_custkey) <=? \d+", text)
        assert not found or name == "vector_topk_batch", (name, found)
