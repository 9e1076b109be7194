"""Most similar pairs where large groups of rows have equal or nearly equal sets."""

import itertools

import numpy as np

from lodestone.operators import selection
from lodestone.operators.selection import top_jaccard


def test_copies_are_not_expanded_into_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    some = [[str(x) for x in rng.permutation(60)[: rng.integers(3, 30)]] for _ in range(25)]
    data = [(900 - i, some[i % 3]) for i in range(6)] + [(i, t) for i, t in enumerate(some)] + [(7, some[8]), (7, some[7]), (3, some[9][:-1]), (40, some[9][1:]), (950, []), (951, None), (952, ["1", None]), (953, ["1", None, "null"])]
    df = spark.createDataFrame(data, "doc_id long, t array<string>").repartition(3)
    score = lambda x, y: round(len(set(x) & set(y)) / max(1, len(set(x) | set(y))), 6)
    want = sorted((-score(x or [], y or []), min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(data, 2) if a != b)
    for k in (4, 15, 60):
        assert [(-r.score, r.a, r.b) for r in top_jaccard(df, "doc_id", "t", k).collect()] == want[:k]
    kept, write = {}, selection.materialize

    def seen(rows, label, *more):
        kept[label] = write(rows, label, *more)
        return kept[label]

    monkeypatch.setattr(selection, "materialize", seen)
    copies = spark.range(3000).selectExpr("id doc_id", "transform(sequence(1, 50), x -> cast(x + id % 2 as string)) t")
    got = top_jaccard(copies, "doc_id", "t", 20).collect()
    assert [(r.score, r.a, r.b) for r in got] == [(1.0, 0, 2 * i) for i in range(1, 21)]
    assert set(kept) == {"jaccard-keys", "jaccard-same"} and "t" not in kept["jaccard-keys"].columns
