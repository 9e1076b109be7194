"""Deltas, caches, health rules and class-priority queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import delta, selection
from lodestone.plans.registry import query
from lodestone.session import load

_OLD = "SELECT doc_id, source, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1"
_NEW = "SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 2"


def _snapshots(spark, sf_dir):
    """Two versions of the documents: some rows only in one, some changed."""
    d = load(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 <> 1").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    new = d.where("doc_id % 10 <> 2").select("doc_id", "source", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("h"))
    return old, new


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def file_delta(spark, sf_dir):
    """JOIN-12, JOIN-13."""
    return delta.diff(*_snapshots(spark, sf_dir), "doc_id", "h")


@query(f"WITH o AS (SELECT DISTINCT source, h FROM ({_OLD})), n AS (SELECT DISTINCT source, h FROM ({_NEW})) SELECT coalesce(o.source, n.source) AS source, CASE WHEN o.h IS NULL THEN 'add' WHEN n.h IS NULL THEN 'remove' ELSE 'keep' END AS action, count(*) AS n FROM o FULL JOIN n ON o.source = n.source AND o.h = n.h GROUP BY ALL")
def chunk_delta(spark, sf_dir):
    """JOIN-11, SET-6: actions by file."""
    return delta.chunk_diff(*_snapshots(spark, sf_dir), "source", "h").groupBy("source", "action").agg(F.count("*").alias("n"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}), u AS (SELECT n.* FROM n LEFT JOIN o ON o.doc_id = n.doc_id WHERE o.h IS NULL OR o.h <> n.h) SELECT doc_id, h FROM o WHERE doc_id IN (SELECT doc_id FROM n) AND doc_id NOT IN (SELECT doc_id FROM u) UNION ALL SELECT doc_id, h FROM u")
def apply_delta(spark, sf_dir):
    """IDX-2, IDX-3: the old index with the delta applied equals the new snapshot."""
    old, new = _snapshots(spark, sf_dir)
    d = delta.diff(old, new, "doc_id", "h")
    upserts = new.join(d.where("change in ('added', 'modified')"), "doc_id", "left_semi")
    return delta.apply_delta(old, d.where("change = 'deleted'"), upserts, "doc_id").select("doc_id", "h")


@query("WITH c AS (SELECT sha256(text) AS h, min(doc_id) AS cached FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT d.doc_id, c.cached, c.cached IS NOT NULL AS hit FROM (SELECT doc_id, sha256(text) AS h FROM documents) d LEFT JOIN c ON d.h = c.h")
def cache_partition(spark, sf_dir):
    """JOIN-14, JOIN-15, AGG-36: cache hits by content hash."""
    d = load(spark, sf_dir, "documents")
    cache = d.where("doc_id % 3 = 0").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("cached"))
    return delta.with_cache(d.select("doc_id", F.sha2("text", 256).alias("h")), cache, "h", "cached").select("doc_id", "cached", "hit")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing(spark, sf_dir):
    """JOIN-24: documents without a label."""
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def orphans(spark, sf_dir):
    """JOIN-23: labels whose document is not in the (non-English) index."""
    docs = load(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id")
    return load(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id", "left_anti")


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS files, CAST(sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty, count(*) - count(DISTINCT doc_id) AS same_ids, count(text) - count(DISTINCT text) AS same_texts FROM documents")
def index_stats(spark, sf_dir):
    """AGG-26: texts are compared by 256-bit digests, so none is shuffled."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    n = d.agg(F.count("*").alias("chunks"), F.count_if(F.col("size") == 0).alias("empty"), F.count("h").alias("texts"))
    distinct = lambda c: d.groupBy(c).agg(F.lit(1)).agg(F.count(c).alias(f"n_{c}"))
    row = n.join(distinct("source")).join(distinct("doc_id")).join(distinct("h"))
    return row.select("chunks", F.col("n_source").alias("files"), "empty", (F.col("chunks") - F.col("n_doc_id")).alias("same_ids"), (F.col("texts") - F.col("n_h")).alias("same_texts"))


@query("SELECT doc_id, class FROM (SELECT doc_id, class, row_number() OVER (PARTITION BY doc_id ORDER BY class) AS r FROM (SELECT doc_id, 1 AS class FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 2 FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 3 FROM documents WHERE lang = 'fr')) WHERE r = 1")
def class_priority_dedup(spark, sf_dir):
    """WIN-2, SET-2: the best class of every document."""
    l, d = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents")
    rows = l.where("toxic = 1").select("doc_id", F.lit(1).alias("class")).unionByName(l.where("quality = 0").select("doc_id", F.lit(2).alias("class"))).unionByName(d.where("lang = 'fr'").select("doc_id", F.lit(3).alias("class")))
    return rows.groupBy("doc_id").agg(F.min("class").alias("class"))


_SIZES = "SELECT source, doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents"


@query(f"SELECT source, doc_id, tokens, used FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM ({_SIZES})) WHERE used <= 4000")
def budget_prefix_stop(spark, sf_dir):
    """WIN-7."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id", F.ceil(F.length("text") / F.lit(4)).cast("long").alias("tokens"))
    return selection.prefix_stop(d, ["source"], ["doc_id"], "tokens", 4000)


@query(f"WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM ({_SIZES})), w(source, rank, used, taken, doc_id) AS (SELECT source, rank, CASE WHEN tokens <= 4000 THEN tokens ELSE 0 END, tokens <= 4000, doc_id FROM s WHERE rank = 1 UNION ALL SELECT s.source, s.rank, CASE WHEN w.used + s.tokens <= 4000 THEN w.used + s.tokens ELSE w.used END, w.used + s.tokens <= 4000, s.doc_id FROM w JOIN s ON s.source = w.source AND s.rank = w.rank + 1) SELECT source, doc_id, CAST(rank AS INTEGER) AS rank FROM w WHERE taken")
def budget_prefix_skip(spark, sf_dir):
    """WIN-6: rows that do not fit are skipped, later ones may fit."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id", F.ceil(F.length("text") / F.lit(4)).cast("long").alias("tokens"))
    return selection.prefix_skip(d, ["source"], ["doc_id"], "tokens", 4000).select("source", "doc_id", "rank")


@query("SELECT d.source, count(*) AS chunks, round(least(1.0, avg(1 + len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x IN ('for', 'and', 'or', 'if')))) / 10 + CASE WHEN max(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) = 1 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS importance, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def context_groups(spark, sf_dir):
    """AGG-1 to AGG-4, SORT-5: file groups with importance and tokens."""
    from lodestone.functions.scores import group_importance
    from lodestone.functions.text import count_words

    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    c = 1 + count_words(F.col("text"), ("for", "and", "or", "if"))
    g = d.groupBy("source").agg(F.count("*").alias("chunks"), F.avg(c).alias("mean"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("recent"), F.ceil(F.sum(F.length("text")) / F.lit(4)).cast("long").alias("tokens"))
    return g.select("source", "chunks", F.round(group_importance(F.col("mean"), F.col("recent")), 6).alias("importance"), "tokens")


@query("WITH c AS (SELECT user_id AS key, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM c) SELECT key FROM (SELECT key, row_number() OVER (ORDER BY last, key) AS r FROM c), n WHERE r <= floor(n * 0.2) AND n > 0.8 * 100")
def lru_eviction(spark, sf_dir):
    """SORT-12: keys that a cache of 100 entries would evict."""
    c = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last"))
    return delta.evict(c, "key", "last", 100)


@query("SELECT source, rank, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def top_per_group(spark, sf_dir):
    """WIN-1, SORT-13, SORT-14: the first rows of every group."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return load(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("rank")).where("rank <= 3").select("source", "rank", "doc_id")


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only_docs', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'any', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def set_operations(spark, sf_dir):
    """SET-1, 2, 5, 7, 8."""
    d, l = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id")
    parts = [("both", d.intersect(l)), ("only_docs", d.subtract(l)), ("any", d.union(l).distinct())]
    out = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
