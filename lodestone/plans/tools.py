"""The tool surface over the test tables: vectors as chunks, order lines as edges between them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone import tools
from lodestone.plans.registry import query
from lodestone.plans.vectors import cos_sql
from lodestone.session import load, shared_dir

_EDGES = "SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN max(l_quantity) > 40 THEN 'calls' ELSE 'imports' END AS type, round(avg(l_quantity) / 50, 6) AS strength FROM lineitem GROUP BY l_partkey, l_suppkey"


def _search_sql(k: int, hops: int, types: tuple[str, ...], decay: float, least: float = 0.0, where: str = "true", back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    named = ", ".join(f"'{t}'" for t in types) or "NULL"
    ctes = [f"e AS (SELECT DISTINCT {a} AS src, {b} AS dst FROM ({_EDGES}) WHERE type IN ({named}) AND strength >= {least} AND {b} IN (SELECT vec_id FROM embeddings))"]
    ctes += [f"s0 AS (SELECT b.vec_id AS node, {cos_sql('b.embedding', 'a.embedding')} AS score FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 0) a WHERE len(b.embedding) > 0 AND {where} ORDER BY score DESC, node LIMIT {k})"]
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM s{i}" for i in range(h))
        ctes.append(f"s{h} AS (SELECT e.dst AS node, max(s.score) * {decay} AS score FROM s{h - 1} s JOIN e ON e.src = s.node WHERE e.dst NOT IN ({seen}) GROUP BY e.dst)")
    rows = " UNION ALL ".join(f"SELECT node AS vec_id, {h} AS hop, round(score, 6) AS score FROM s{h}" for h in range(hops + 1))
    return f"WITH {', '.join(ctes)} {rows}"


def _workspace(spark, sf_dir):
    chunks = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("file_path"), "embedding")
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.max("l_quantity").alias("q"), F.avg("l_quantity").alias("a"))
    edges = g.select("src", "dst", F.when(F.col("q") > 40, "calls").otherwise("imports").alias("type"), F.round(F.col("a") / 50, 6).alias("strength"))
    vector = [float(x) for x in load(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]
    return tools.Workspace(chunks, edges), vector


def _out(df):
    return df.select(F.col("chunk_id").alias("vec_id"), "hop", F.round("score", 6).alias("score"))


@query(_search_sql(20, 2, ("calls",), 0.8))
def tool_semantic_search(spark, sf_dir):
    w, v = _workspace(spark, sf_dir)
    return _out(w.semantic_search(v))


@query(_search_sql(10, 0, (), 1.0, where="b.label = 3"))
def tool_contextual_read(spark, sf_dir):
    w, v = _workspace(spark, sf_dir)
    return _out(w.contextual_read(v, "label3"))


@query(_search_sql(20, 3, ("calls", "imports", "data_flow"), 0.7))
def tool_code_intelligence(spark, sf_dir):
    w, v = _workspace(spark, sf_dir)
    return _out(w.code_intelligence(v))


@query(_search_sql(30, 3, ("calls", "imports", "data_flow"), 0.9))
def tool_relationship_analysis(spark, sf_dir):
    w, v = _workspace(spark, sf_dir)
    return _out(w.relationship_analysis(v))


@query(_search_sql(25, 3, ("calls", "throws"), 0.8, back=True))
def tool_trace_execution_path(spark, sf_dir):
    w, v = _workspace(spark, sf_dir)
    return _out(w.trace_execution_path(v, backward=True, max_depth=3))


@query(_search_sql(5, 2, ("calls", "imports", "extends", "implements"), 0.9, 0.7))
def tool_find_code_patterns(spark, sf_dir):
    w, v = _workspace(spark, sf_dir)
    return _out(w.find_code_patterns(v, "file"))


@query("SELECT doc_id, CAST(1 AS INTEGER) AS page, CAST(greatest(1, ceil(length(text) / 1000.0)) AS INTEGER) AS total, substr(text, 1001, 1000) AS part FROM documents WHERE length(text) > 1000")
def tool_next_chunk(spark, sf_dir):
    """The page after the first, for every document that has one."""
    paged = tools.result_pages(load(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    return tools.next_chunk(paged, tools.fetch_chunk(paged), "doc_id").select("doc_id", F.col("page").cast("int").alias("page"), "total", "part")


@query("SELECT n_nationkey AS project_id, n_name AS name, n_nationkey = 7 AS active FROM nation")
def tool_switch_project(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("path"))
    p = tools.Projects(spark, f"{shared_dir(spark)}/stores/projects-{uuid.uuid4().hex}")
    p.add_project(rows)
    p.switch_project(3)
    p.switch_project(7)
    return p.list_projects().select("project_id", "name", "active")


_SESSIONS = "SELECT user_id, user_id % 40 AS project, min(ts) AS started, max(ts) AS last_activity, arg_max(event_type, (ts, event_id)) AS status, list(event_type <> 'error' ORDER BY ts, event_id) AS checks FROM events WHERE user_id IS NOT NULL GROUP BY user_id"
_HEALTH = f"SELECT user_id, project, date_sub('second', started, TIMESTAMP '2024-01-31') AS uptime_s, CASE WHEN status = 'error' THEN 'error' WHEN date_sub('second', last_activity, TIMESTAMP '2024-01-31') > 60 OR len(list_filter(list_slice(checks, -3, -1), lambda x: NOT x)) * 1.0 / least(3, len(checks)) > 0.5 THEN 'warning' ELSE 'good' END AS health FROM ({_SESSIONS})"


def _sessions(spark, sf_dir):
    """Users as sessions; only a session's latest three checks are kept, so no group grows with its events."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").where("user_id is not null")
    late = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 3")
    checks = late.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("event_type") != "error").alias("ok")))), lambda x: x["ok"]).alias("checks"))
    span = e.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("last_activity"))
    return span.join(checks, "user_id").withColumn("project", F.col("user_id") % 40)


_NOW = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


@query(_HEALTH)
def tool_session_health(spark, sf_dir):
    return tools.session_health(_sessions(spark, sf_dir), F.expr(_NOW)).select("user_id", "project", "uptime_s", "health")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS sessions, count(*) FILTER (WHERE n > 1) AS conflicts, CAST(sum(w) AS BIGINT) AS warnings, 'unhealthy' AS overall FROM (SELECT project, count(*) AS n, count(*) FILTER (WHERE health = 'warning') AS w FROM ({_HEALTH}) GROUP BY project)")
def tool_multi_instance_health(spark, sf_dir):
    return tools.multi_instance_health(_sessions(spark, sf_dir), F.expr(_NOW), recent_errors=5)


@query("SELECT (SELECT count(*) FROM events) AS requests, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean_ms, round(max(value), 6) AS longest_ms FROM (SELECT value FROM events ORDER BY ts DESC NULLS LAST, value DESC NULLS LAST LIMIT 100)")
def request_dashboard(spark, sf_dir):
    """SRC-26: counters and the latest response times."""
    e = load(spark, sf_dir, "events").select("ts", F.col("value").alias("ms"), (F.col("event_type") == "error").alias("failed"))
    return tools.request_dashboard(e).select("requests", "errors", F.round("mean_ms", 6).alias("mean_ms"), F.round("longest_ms", 6).alias("longest_ms"))
