"""Health of an index over documents and vectors, derived so that every rule is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import health
from lodestone.plans.registry import query
from lodestone.session import load

#: Chunks: one for each document, its vector where there is one; some ids twice. Scanned files: all sources but two, and some new ones.
_CHUNKS_SQL = "c AS (SELECT CASE WHEN doc_id % 31 = 5 THEN doc_id - 1 ELSE doc_id END AS chunk_id, 'src/' || source || '.ts' AS file_path, CASE WHEN doc_id % 17 = 3 THEN list_slice(embedding, 1, 3) ELSE embedding END AS embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"
_SCAN_SQL = "f AS (SELECT DISTINCT 'src/' || source || '.ts' AS file_path FROM documents WHERE source NOT IN ('src1', 'src2') UNION SELECT 'src/new' || (doc_id % 40) || '.ts' FROM documents)"


def _chunks(spark, sf_dir):
    d, v = load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    short = F.when(F.col("doc_id") % 17 == 3, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    ids = F.when(F.col("doc_id") % 31 == 5, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return d.join(v, F.col("vec_id") == F.col("doc_id"), "left").select(ids.alias("chunk_id"), F.concat(F.lit("src/"), "source", F.lit(".ts")).alias("file_path"), short.alias("embedding"))


def _scan(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    old = d.where(~F.col("source").isin("src1", "src2")).select(F.concat(F.lit("src/"), "source", F.lit(".ts")).alias("file_path"))
    return old.union(d.select(F.concat(F.lit("src/new"), (F.col("doc_id") % 40).cast("string"), F.lit(".ts")))).distinct()


_ISSUES_SQL = f"""
{_CHUNKS_SQL}, {_SCAN_SQL},
g AS (SELECT arg_min(coalesce(len(embedding), -1), chunk_id) AS dim FROM c),
s AS (SELECT count(*) AS n, count_if(embedding IS NULL OR len(embedding) <> dim OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS invalid, count(*) - count(DISTINCT chunk_id) AS again, count_if(coalesce(len(embedding), 0) = 0) AS bare, count(DISTINCT file_path) AS indexed, count_if(file_path NOT IN (SELECT file_path FROM f)) AS gone FROM c, g),
t AS (SELECT count(*) AS files, count_if(file_path NOT IN (SELECT file_path FROM c)) AS missing FROM f),
u AS (SELECT count(*) AS extra FROM (SELECT DISTINCT file_path FROM c) WHERE file_path NOT IN (SELECT file_path FROM f)),
k AS (SELECT count_if(c_mktsegment = 'BUILDING') AS dependencies, count_if(c_mktsegment = 'MACHINERY') AS builds FROM customer WHERE c_custkey % 3 = 0),
a AS (SELECT count(*) AS behind, date_diff('day', min(o_orderdate), DATE '1996-01-01') AS age FROM orders WHERE o_orderdate > DATE '1995-12-01'),
issues AS (SELECT * FROM (
  SELECT 'corruption' AS type, 'invalid_embeddings' AS rule, CASE WHEN invalid > 0.5 * n THEN 'critical' ELSE 'warning' END AS severity, CAST(invalid AS BIGINT) AS affected, CASE WHEN invalid > 0.5 * n THEN 'full_rebuild' ELSE 'incremental_update' END AS action FROM s
  UNION ALL SELECT 'corruption', 'duplicate_ids', 'critical', CAST(again AS BIGINT), 'full_rebuild' FROM s
  UNION ALL SELECT 'corruption', 'deleted_files', 'warning', CAST(gone AS BIGINT), 'incremental_update' FROM s
  UNION ALL SELECT 'staleness', 'branch_changed', 'warning', 1, 'incremental_update'
  UNION ALL SELECT 'staleness', 'commits_behind', 'warning', CASE WHEN behind > 20 THEN behind ELSE 0 END, 'incremental_update' FROM a
  UNION ALL SELECT 'staleness', 'dependencies_changed', 'info', CAST(dependencies AS BIGINT), 'incremental_update' FROM k
  UNION ALL SELECT 'staleness', 'build_changed', 'warning', CAST(builds AS BIGINT), 'full_rebuild' FROM k
  UNION ALL SELECT 'staleness', 'old', 'info', CASE WHEN age > 7 THEN age ELSE 0 END, 'incremental_update' FROM a
  UNION ALL SELECT 'performance', 'left_over_files', 'warning', CASE WHEN indexed < 0.8 * files THEN extra ELSE 0 END, 'incremental_update' FROM s, t, u
  UNION ALL SELECT 'performance', 'missing_files', 'warning', CASE WHEN indexed < 0.8 * files THEN missing ELSE 0 END, 'incremental_update' FROM s, t
  UNION ALL SELECT 'performance', 'missing_embeddings', CASE WHEN bare > 0.05 * n THEN 'critical' ELSE 'warning' END, CAST(bare AS BIGINT), 'incremental_update' FROM s
) WHERE affected > 0)
"""


def _issues(spark, sf_dir):
    """All rules. Customers stand for dependency and build files, every third with another hash; orders of December for commits."""
    chunks, scan = _chunks(spark, sf_dir), _scan(spark, sf_dir)
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "dependency").when(F.col("c_mktsegment") == "MACHINERY", "build").otherwise("other")
    files = load(spark, sf_dir, "customer").select(kind.alias("kind"), F.col("c_name").alias("file"), F.sha2("c_name", 256).alias("hash"), "c_custkey")
    changed = health.changed_hashes(files, files.where((F.col("c_custkey") % 3 != 0) | (F.col("c_custkey") % 2 == 0)).withColumn("hash", F.when(F.col("c_custkey") % 3 == 0, "old").otherwise(F.col("hash"))))
    late = load(spark, sf_dir, "orders").where("o_orderdate > DATE '1995-12-01'")
    state = late.agg(F.count("*").alias("commits_behind"), F.date_diff(F.lit("1996-01-01").cast("date"), F.min("o_orderdate").cast("date")).alias("age_days"))
    state = state.withColumns({"branch": F.lit("main"), "indexed_branch": F.lit("topic")})
    return health.corruption(chunks, scan).unionByName(health.staleness(state, changed)).unionByName(health.coverage(chunks, scan))


@query(f"WITH {_ISSUES_SQL} SELECT * FROM issues")
def health_rules(spark, sf_dir):
    """IDX-5, IDX-6, IDX-7, JOIN-25."""
    return _issues(spark, sf_dir)


@query(f"WITH {_ISSUES_SQL} SELECT CASE WHEN count_if(severity = 'critical') > 0 THEN 'critical' WHEN count(*) > 0 THEN 'degraded' ELSE 'healthy' END AS health, count(*) > 0 AS should_rebuild, CASE WHEN count_if(severity = 'critical' AND type = 'corruption') > 0 THEN 'full' ELSE 'incremental' END AS mode, CASE WHEN count_if(severity = 'critical') > 0 THEN 'critical issues' ELSE 'build configuration changed' END AS reason, count_if(severity = 'critical' AND type = 'corruption') > 0 AS forced FROM issues")
def health_verdict(spark, sf_dir):
    """IDX-8, and the decision to rebuild."""
    return health.verdict(_issues(spark, sf_dir))


_META_SQL = "m AS (SELECT * FROM (VALUES ('2.0.0', false, 40, 50, 1), ('1.1.0', true, 3, 20000, 2), ('1.0.0', true, 31, 20000, 3)) v(schema_version, compatible, age_days, chunks, nth))"


@query(f"WITH {_ISSUES_SQL}, {_META_SQL}, n AS (SELECT count_if(severity = 'critical') AS critical, count_if(severity = 'warning') AS warning FROM issues), r AS (SELECT nth, 0 AS pos, 'schema' AS category, CASE WHEN schema_version NOT IN ('1.0.0', '1.1.0') THEN 'high' END AS severity FROM m UNION ALL SELECT nth, 1, 'model', CASE WHEN NOT compatible THEN 'high' END FROM m UNION ALL SELECT nth, 2, 'corruption', CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'medium' END FROM m, n UNION ALL SELECT nth, 3, 'staleness', CASE WHEN age_days > 30 THEN 'low' END FROM m UNION ALL SELECT nth, 4, 'performance', CASE WHEN age_days <= 30 AND chunks > 10000 THEN 'low' END FROM m) SELECT CAST(nth AS INTEGER) AS nth, category, severity, CAST(row_number() OVER (PARTITION BY nth ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, pos) AS INTEGER) AS place FROM r WHERE severity IS NOT NULL")
def rebuild_advice(spark, sf_dir):
    """IDX-9, SORT-10 for three states of an index."""
    from pyspark.sql import Window

    issues, out = _issues(spark, sf_dir), None
    for nth, row in enumerate([("2.0.0", False, 40, 50), ("1.1.0", True, 3, 20000), ("1.0.0", True, 31, 20000)], 1):
        meta = spark.createDataFrame([row], "schema_version string, compatible boolean, age_days int, chunks int")
        one = health.rebuild_advice(issues, meta).withColumn("nth", F.lit(nth))
        out = one if out is None else out.unionByName(one)
    return out.select("nth", "category", "severity", F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("weight"), "at")).alias("place"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'full' WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'full_after_backup' ELSE 'incremental' END ELSE 'full_after_backup' END AS mode, CASE WHEN c_custkey % 4 = 0 THEN true ELSE c_custkey % 3 <> 1 AND c_custkey % 6 <> 2 AND (c_custkey % 7 = 0 OR c_custkey % 8 <> 3) END AS compatible, CASE WHEN c_custkey % 5 = 0 THEN 'no index' WHEN c_custkey % 4 IN (0, 1) THEN 'empty or corrupt index' WHEN c_custkey % 4 <> c_custkey % 3 THEN 'chunk count mismatch' ELSE 'healthy' END AS quick FROM customer")
def index_states(spark, sf_dir):
    """IDX-4, IDX-10, IDX-11 over states derived from customers."""
    k = F.col("c_custkey")
    requested = F.when(k % 3 == 0, "incremental").when(k % 3 == 1, "full").otherwise("reindex")
    cached = F.when(k % 4 != 0, F.struct(F.when(k % 3 == 1, "other").otherwise("model").alias("name"), F.when(k % 6 == 2, "0").otherwise("1").alias("version"), F.when(k % 7 != 0, F.when(k % 8 == 3, "x").otherwise("h")).alias("hash")))
    current = F.struct(F.lit("model").alias("name"), F.lit("1").alias("version"), F.lit("h").alias("hash"))
    listed = F.when(k % 4 == 1, 0).otherwise(k % 4)
    quick = health.quick_health(k % 5 != 0, listed, k % 3)
    return load(spark, sf_dir, "customer").select("c_custkey", health.index_mode(k % 5 != 0, requested, k % 7 == 0).alias("mode"), health.model_compatible(cached, current).alias("compatible"), quick.alias("quick"))


@query("WITH s AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'local' ELSE 'global' END AS location, CASE WHEN n_nationkey < 2 THEN 'embeddings' ELSE 'relationships' END AS kind, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(n_nationkey * 30 AS BIGINT)) AS modified FROM nation WHERE n_nationkey < 3), p AS (SELECT location, max(modified) FILTER (kind = 'embeddings') AS e, max(modified) FILTER (kind = 'relationships') AS r FROM s GROUP BY 1) SELECT location, 'relationships_missing' AS issue FROM p WHERE e IS NOT NULL AND r IS NULL UNION ALL SELECT 'all', 'not_synchronised' WHERE NOT EXISTS (SELECT 1 FROM p WHERE abs(epoch(e) - epoch(r)) < 3600) UNION ALL SELECT 'all', kind || '_apart' FROM s GROUP BY kind HAVING count(*) > 1 AND epoch(max(modified)) - epoch(min(modified)) > 86400")
def store_consistency(spark, sf_dir):
    """IDX-12, SCALAR-31: two locations, one of them without a graph; times 30 hours apart."""
    k = F.col("n_nationkey")
    stores = load(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.when(k % 2 == 0, "local").otherwise("global").alias("location"), F.when(k < 2, "embeddings").otherwise("relationships").alias("kind"), F.lit(True).alias("exists"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + k * 30 * 3600).alias("modified"))
    return health.store_issues(stores)


@query("WITH u AS (SELECT user_id, count(*) AS queries, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)::DOUBLE AS follow_up_rate, avg(value) / 100 AS utilisation, avg(value) * 40 AS response_ms, avg(CASE WHEN event_type = 'click' THEN 0.5 ELSE 1.0 END)::DOUBLE AS coverage FROM events GROUP BY 1) SELECT advice, count(*) AS users FROM (SELECT unnest(list_filter([CASE WHEN follow_up_rate > 0.3 THEN 'tune_relevance' END, CASE WHEN coverage < 0.9 THEN 'raise_budget_for_coverage' END, CASE WHEN utilisation < 0.6 THEN 'lower_budget' END, CASE WHEN utilisation > 0.95 THEN 'raise_budget' END, CASE WHEN response_ms > 2000 THEN 'speed_up' END], lambda x: x IS NOT NULL)) AS advice FROM u) GROUP BY 1")
def telemetry_advice(spark, sf_dir):
    """IDX-14: rules over the usage of every user."""
    share = lambda kind, yes, no: F.avg(F.when(F.col("event_type") == kind, yes).otherwise(no))
    usage = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("queries"), share("error", 1.0, 0.0).alias("follow_up_rate"), (F.avg("value") / 100).alias("utilisation"), (F.avg("value") * 40).alias("response_ms"), share("click", 0.5, 1.0).alias("coverage"))
    return health.telemetry_advice(usage).groupBy("advice").agg(F.count("*").alias("users"))
