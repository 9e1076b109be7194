"""Usage, queues, histories and caches: the small operators around an index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import embeddings as e
from lodestone.operators.delta import diff
from lodestone.plans.deltas import _NEW, _OLD, _snapshots
from lodestone.plans.registry import query
from lodestone.plans.telemetry import _events
from lodestone.session import load


@query("SELECT vec_id, label, len(embedding) AS dimension FROM embeddings")
def all_vectors(spark, sf_dir):
    """SRC-25: every stored vector."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dimension"))


@query("SELECT l_suppkey, l_partkey, count(*) AS frequency FROM lineitem GROUP BY ALL")
def all_relationships(spark, sf_dir):
    """SRC-25: every stored relationship."""
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("frequency"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT (SELECT count(*) FROM o) AS initial, (SELECT count(*) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)) + (SELECT count(*) FROM o JOIN n USING (doc_id) WHERE o.h <> n.h) AS removed, (SELECT count(*) FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)) + (SELECT count(*) FROM o JOIN n USING (doc_id) WHERE o.h <> n.h) AS added, (SELECT count(*) FROM n) AS final")
def delta_accounting(spark, sf_dir):
    """AGG-33: initial - removed + added = final, over distinct ids."""
    old, new = _snapshots(spark, sf_dir)
    n = diff(old, new, "doc_id", "h").agg(F.count_if(F.col("change") != "added").alias("initial"), F.count_if(F.col("change").isin("deleted", "modified")).alias("removed"), F.count_if(F.col("change").isin("added", "modified")).alias("added"))
    return n.withColumn("final", F.expr("initial - removed + added"))


@query("SELECT count(*) AS total, CAST(count_if(user_id % 3 > 0) AS BIGINT) AS tracked, CAST(count_if(user_id % 3 = 0) AS BIGINT) AS untracked, CAST(count_if(event_type = 'view') AS BIGINT) AS staged, CAST(count_if(event_type = 'purchase') AS BIGINT) AS indexed, CAST(count_if(event_type = 'nothing') AS BIGINT) AS failed FROM events")
def staging_stats(spark, sf_dir):
    """AGG-27: totals by state, zeros kept."""
    states = {"staged": "view", "indexed": "purchase", "failed": "nothing"}
    return load(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(F.col("user_id") % 3 > 0).alias("tracked"), F.count_if(F.col("user_id") % 3 == 0).alias("untracked"), *(F.count_if(F.col("event_type") == v).alias(k) for k, v in states.items()))


@query("SELECT c_mktsegment AS command, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_processes(spark, sf_dir):
    """AGG-17 over a process table (customers; the command is their segment)."""
    return load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("command")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first")).where("n > 1")


@query("SELECT user_id AS project, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_access, CAST(row_number() OVER (ORDER BY max(ts) DESC, user_id) AS INTEGER) AS place FROM events GROUP BY user_id")
def projects_by_access(spark, sf_dir):
    """SORT-11: users as projects, the latest first."""
    p = _events(spark, sf_dir).groupBy(F.col("user_id").alias("project")).agg(F.max("ts").alias("last"))
    place = F.row_number().over(Window.orderBy(F.desc("last"), "project"))  # a registry: one row a project
    return p.select("project", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_access"), place.alias("place"))


@query("SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE regexp_matches(event_type, '(?i)^(P|S).*') AND ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY 1")
def metric_lookup(spark, sf_dir):
    """FILT-21: by name, whatever its case, and by a window that ends with the last event."""
    ev = _events(spark, sf_dir)
    last = ev.agg(F.max("ts").alias("last"))
    rows = ev.join(F.broadcast(last)).where(F.col("event_type").rlike("(?i)^(P|S).*") & (F.col("ts") >= F.col("last") - F.expr("INTERVAL 5 DAYS")))
    return rows.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def history_trim(spark, sf_dir):
    """WIN-11: the last five samples of every history."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 5").select("user_id", "event_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS line FROM events) WHERE line <= 50 AND event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def recent_errors(spark, sf_dir):
    """WIN-17: of the last fifty lines of every log, the last five errors."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    lines = _events(spark, sf_dir).withColumn("line", F.row_number().over(w)).where("line <= 50 and event_type = 'error'")
    return lines.withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_id", "user_id")


@query("WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), w(user_id, r, n, mean) AS (SELECT user_id, r, n, value FROM s WHERE r = 1 UNION ALL SELECT s.user_id, s.r, s.n, (w.mean + s.value) / 2 FROM w JOIN s ON s.user_id = w.user_id AND s.r = w.r + 1) SELECT user_id, round(mean, 4) AS moving FROM w WHERE r = n")
def moving_average(spark, sf_dir):
    """WIN-15: (mean + x) / 2 in order of time. The last 60 values decide: older ones weigh less than 2^-59 of a double."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    late = _events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 60")
    n = F.max("r").over(Window.partitionBy("user_id"))
    late = late.withColumn("n", n).withColumn("part", F.col("value") * F.pow(F.lit(0.5), F.when(F.col("r") == F.col("n"), F.col("r") - 1).otherwise(F.col("r"))))
    return late.groupBy("user_id").agg(F.round(F.sum("part"), 4).alias("moving"))


@query("SELECT vec_id, embedding IS NOT NULL AND len(embedding) = 64 AND vec_id % 4 > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def cache_entries(spark, sf_dir):
    """FILT-17: cached vectors of 64 numbers; every fourth is of another model."""
    v = load(spark, sf_dir, "embeddings")
    return v.select("vec_id", e.cache_valid(F.col("embedding"), F.when(F.col("vec_id") % 4 > 0, "m").otherwise("other"), "m", 64).alias("valid"))


@query("WITH s AS (SELECT user_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS events, CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS BIGINT) AS skipped, CAST(sum(CASE WHEN n < 2 THEN n ELSE 0 END) AS BIGINT) AS taken FROM s")
def load_shedding(spark, sf_dir):
    """STR-3: events of a suspended minute (two or more of one user) are dropped and counted."""
    ev = _events(spark, sf_dir).groupBy("user_id", F.date_trunc("minute", "ts")).agg(F.count("*").alias("n"))
    return ev.agg(F.sum("n").alias("events"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("skipped"), F.sum(F.when(F.col("n") < 2, F.col("n")).otherwise(0)).alias("taken"))


@query("WITH o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, CAST((r - 1) // 50 AS INTEGER) AS flush, count(*) AS rows FROM o GROUP BY ALL")
def buffered_flush(spark, sf_dir):
    """STR-13: rows of a session leave its buffer in lots of fifty."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = _events(spark, sf_dir).withColumn("flush", F.floor((F.row_number().over(w) - 1) / 50).cast("int"))
    return ev.groupBy("user_id", "flush").agg(F.count("*").alias("rows"))


@query("SELECT count(*) AS events, CAST(count_if(substr(sha256(CAST(event_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3')) AS BIGINT) AS sampled FROM events")
def telemetry_sampling(spark, sf_dir):
    """FILT-23: a quarter of the events, chosen by a hash of their id so that a retry chooses the same."""
    chosen = F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 1).isin("0", "1", "2", "3")
    return load(spark, sf_dir, "events").agg(F.count("*").alias("events"), F.count_if(chosen).alias("sampled"))


@query("SELECT conv_id, turn, n BETWEEN 1 AND 10000 AND turn + 1 BETWEEN 1 AND 1000 AND n <= 50000 AS accepted FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations)")
def input_guard(spark, sf_dir):
    """FILT-22: length of the task, number of wanted chunks, length of the content."""
    n = F.length(F.coalesce("text", F.lit("")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", (n.between(1, 10_000) & (F.col("turn") + 1).between(1, 1000) & (n <= 50_000)).alias("accepted"))


@query("SELECT source, to_json(map_from_entries(list_sort(list((k, v))))) AS merged FROM (SELECT source, k, arg_max(v, place) AS v FROM (SELECT source, lang AS k, 'own' AS v, 0 AS place FROM documents UNION ALL SELECT source, 'en', 'override', 1 FROM documents) GROUP BY ALL) GROUP BY source")
def merged_maps(spark, sf_dir):
    """MAP-2: later maps win, key by key."""
    own = load(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    first = F.map_from_arrays("langs", F.transform("langs", lambda _: F.lit("own")))
    kept = F.map_filter(first, lambda k, _: k != "en")
    merged = F.map_concat(kept, F.create_map(F.lit("en"), F.lit("override")))
    return own.select("source", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("merged"))


@query()
def vector_hashes(spark, sf_dir):
    """UDF-6, AGG-14: the first 16 digits of the SHA-256 of a vector's 32-bit floats (no SQL: DuckDB has no bytes of floats)."""
    return load(spark, sf_dir, "embeddings").select("vec_id", F.substring(e.float32_sha256("embedding"), 1, 16).alias("hash"))


@query()
def mock_embeddings(spark, sf_dir):
    """UDF-2, MATH-13: eight numbers for every source."""
    d = load(spark, sf_dir, "documents").select("source").distinct()
    return d.select("source", F.posexplode(e.mock_embedding(F.col("source"), 8)).alias("place", "value")).withColumn("value", F.round("value", 6))


@query("SELECT q.user_id, q.queries, coalesce(f.follow_ups, 0) AS follow_ups FROM (SELECT user_id, count(*) AS queries FROM events WHERE event_type = 'view' GROUP BY 1) q LEFT JOIN (SELECT a.user_id, count(DISTINCT a.event_id) AS follow_ups FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR WHERE a.event_type = 'view' GROUP BY 1) f USING (user_id)")
def follow_up_interactions(spark, sf_dir):
    """JOIN-22: queries (views) with an interaction of the same user within twelve hours, found by the next event, not by pairs."""
    w = Window.partitionBy("user_id").orderBy("ms").rangeBetween(1, Window.unboundedFollowing)
    ev = _events(spark, sf_dir).withColumn("next", F.min("ms").over(w))
    near = (F.col("next") - F.col("ms")) <= 12 * 3600 * 1000
    return ev.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("queries"), F.count_if(near).alias("follow_ups"))
