"""Vector search, duplicates and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.functions.vector import as_double, cosine, is_finite, norm
from lodestone.operators.selection import diversity, mmr_metrics, mmr_select, top_jaccard
from lodestone.plans.registry import query
from lodestone.session import load


def cos_sql(a: str, b: str) -> str:
    dot = lambda x, y: f"list_inner_product({x}::DOUBLE[], {y}::DOUBLE[])"
    return f"coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0), 0)"


_COS = cos_sql("a.embedding", "b.embedding")


@query(f"SELECT b.vec_id, b.label, round({_COS}, 6) AS score FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 0) a WHERE len(b.embedding) > 0 AND b.vec_id <> 0 ORDER BY {_COS} DESC, b.vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    """FILT-3, MATH-1, SORT-1: ten nearest by cosine to vector 0."""
    v = load(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    rest = v.where((F.size("embedding") > 0) & (F.col("vec_id") != 0)).join(F.broadcast(q)).withColumn("s", cosine("embedding", "q"))
    return rest.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", "label", F.round("s", 6).alias("score"))


@query(f"SELECT query_id, rank, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id < 8 AND a.vec_id <> b.vec_id) WHERE rank <= 5")
def vector_topk_batch(spark, sf_dir):
    """SORT-1 for a bounded batch of eight stated queries in one job."""
    v = load(spark, sf_dir, "embeddings")
    q = v.where("vec_id < 8").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).limit(8)
    j = v.join(F.broadcast(q), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", cosine("embedding", "q").alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "rank", "vec_id", F.round("s", 6).alias("score"))


@query(f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 1) a WHERE b.label = 3 ORDER BY {_COS} DESC, b.vec_id LIMIT 5")
def vector_filter_label_topk(spark, sf_dir):
    """FILT-4 before SORT-1: the filter reaches the scan."""
    v = load(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 1").select(F.col("embedding").alias("q")).limit(1)
    return v.where("label = 3").join(F.broadcast(q)).withColumn("s", cosine("embedding", "q")).orderBy(F.desc("s"), "vec_id").limit(5).select("vec_id", F.round("s", 6).alias("score"))


@query("WITH d AS (SELECT arg_min(len(embedding), vec_id) AS dim FROM embeddings) SELECT label, count(*) AS n, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm, CAST(sum(CASE WHEN embedding IS NULL OR len(embedding) <> d.dim OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM embeddings, d GROUP BY label")
def vector_norms_invalid(spark, sf_dir):
    """FILT-18, IDX-5: invalid against the dimension of the first vector."""
    v = load(spark, sf_dir, "embeddings")
    dim = v.agg(F.min_by(F.size("embedding"), "vec_id").alias("dim"))
    bad = F.col("embedding").isNull() | (F.size("embedding") != F.col("dim")) | ~is_finite("embedding")
    return v.join(F.broadcast(dim)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm("embedding")), 6).alias("mean_norm"), F.sum(bad.cast("long")).alias("invalid"))


@query(f"SELECT round(1 - avg({_COS}), 6) AS diversity FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id")
def pairwise_diversity(spark, sf_dir):
    """JOIN-27, AGG-30 over all vectors, without forming pairs."""
    return diversity(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.round("diversity", 6).alias("diversity"))


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum((n - 1) * dim * 4), 0) AS BIGINT) AS bytes FROM (SELECT embedding, count(*) AS n, len(embedding) AS dim FROM embeddings GROUP BY embedding HAVING count(*) > 1)")
def duplicate_vectors(spark, sf_dir):
    """AGG-14: groups of equal vectors and the bytes they waste."""
    g = load(spark, sf_dir, "embeddings").groupBy("embedding").agg(F.count("*").alias("n")).where("n > 1").withColumn("dim", F.size("embedding"))
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum((F.col("n") - 1) * F.col("dim") * 4), F.lit(0)).alias("bytes"))


def _candidates(spark, sf_dir, full: bool = False):
    """Documents as candidates of their vector's label; ``full``: with file, type and words."""
    v, d = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "documents")
    k = F.col("vec_id")
    own = [F.col("label").cast("long").alias("query_id"), k.alias("id"), "embedding", (1 / (1 + k % 17)).alias("relevance"), F.ceil(F.length("text") / 4).alias("tokens"), (k % 50 == 0).alias("critical")]
    more = [F.col("source").alias("file_path"), (k % 5).cast("string").alias("chunk_type"), F.array_distinct(words(F.col("text"))).alias("words")] if full else []
    return v.join(d, k == F.col("doc_id")).select(*own, *more)


@query()
def mmr_selection(spark, sf_dir):
    """MMR-1 (its budget), MMR-2 to MMR-4 with cosine: critical rows first, then greedy selection under a token budget; one group per label."""
    return mmr_select(_candidates(spark, sf_dir), 10)


@query()
def mmr_semantic(spark, sf_dir):
    """MMR-2, MMR-3 with the preset's similarity: cosine and overlap of words."""
    return mmr_select(_candidates(spark, sf_dir, True), 5)


@query()
def mmr_report(spark, sf_dir):
    """MMR-5, AGG-30: coverage, tokens, utilisation and diversity of what mmr_selection takes."""
    c = _candidates(spark, sf_dir)
    m = mmr_metrics(mmr_select(c, 10), c, 4)
    return m.select("query_id", "chunks", "tokens", *(F.round(x, 6).alias(x) for x in ("utilisation", "coverage", "raw_coverage", "diversity")))


@query()
def jaccard_pairs(spark, sf_dir):
    """MATH-2's token overlap, SET-4 over all documents: the twenty most similar pairs (no SQL: it would form all pairs)."""
    w = load(spark, sf_dir, "documents").select("doc_id", F.array_distinct(words(F.col("text"))).alias("t"))
    return top_jaccard(w, "doc_id", "t", 20).select("a", "b", "score").orderBy(F.desc("score"), "a", "b")
