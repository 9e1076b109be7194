"""Usage telemetry, activity, sessions and metric series over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.scores import debounce_ms
from lodestone.plans.registry import query
from lodestone.session import load


def _events(spark, sf_dir):
    """Events with ts as TIMESTAMP (UTC session) and seconds since the epoch."""
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts"))


#: Events as telemetry: views retrieve, clicks interact, purchases are selections; a query is a user's day.
_EFFECT_SQL = """
WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y-%m-%d') AS query_id FROM events),
f AS (SELECT count(DISTINCT query_id) FILTER (event_type = 'click' AND value > 50) / nullif(count(DISTINCT query_id) FILTER (event_type = 'view'), 0)::DOUBLE AS follow_up_rate,
  coalesce(avg(value / 100) FILTER (event_type = 'purchase'), 0) AS match_rate, 1 - coalesce(avg(1 - value / 200) FILTER (event_type = 'purchase'), 0) AS waste_rate,
  coalesce(avg(least(1, value / 80)) FILTER (event_type = 'view'), 0) AS coverage, coalesce(avg(value / 20) FILTER (event_type = 'click' AND value >= 10) / 5, 0) AS satisfaction FROM e)
SELECT round(follow_up_rate, 6) AS follow_up_rate, round(match_rate, 6) AS match_rate, round(waste_rate, 6) AS waste_rate, round(coverage, 6) AS coverage, round(satisfaction, 6) AS satisfaction,
  round((1 - follow_up_rate) * 0.3 + match_rate * 0.25 + (1 - waste_rate) * 0.2 + coverage * 0.15 + satisfaction * 0.1, 6) AS score FROM f
"""


@query(_EFFECT_SQL)
def telemetry_effectiveness(spark, sf_dir):
    """AGG-18: follow-ups by distinct query, match, waste, coverage and satisfaction, and their weighted sum."""
    v, kind = F.col("value"), F.col("event_type")
    e = _events(spark, sf_dir).withColumn("query_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    # distinct queries by aggregate first: two counts of distinct values would copy every event
    asked = e.groupBy("query_id").agg(F.bool_or(kind == "view").alias("asked"), F.bool_or((kind == "click") & (v > 50)).alias("followed"))
    follow = asked.agg(F.coalesce(F.try_divide(F.count_if("followed"), F.count_if("asked")), F.lit(0.0)).alias("follow_up_rate"))
    mean = lambda hit, x: F.coalesce(F.avg(F.when(hit, x)), F.lit(0.0))
    rest = e.agg(mean(kind == "purchase", v / 100).alias("match_rate"), (1 - mean(kind == "purchase", 1 - v / 200)).alias("waste_rate"), mean(kind == "view", F.least(F.lit(1.0), v / 80)).alias("coverage"), (mean((kind == "click") & (v >= 10), v / 20) / 5).alias("satisfaction"))
    c = F.col
    score = (1 - c("follow_up_rate")) * 0.3 + c("match_rate") * 0.25 + (1 - c("waste_rate")) * 0.2 + c("coverage") * 0.15 + c("satisfaction") * 0.1
    row = follow.join(rest)
    return row.select(*(F.round(x, 6).alias(x) for x in row.columns), F.round(score, 6).alias("score"))


@query("SELECT event_type AS preset, n, mean_value, p_high, row_number() OVER (ORDER BY mean_value DESC, event_type) AS rank FROM (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS p_high FROM events GROUP BY 1)")
def preset_ranking(spark, sf_dir):
    """AGG-21, AGG-22, WIN-5: presets (event types) ranked by mean quality."""
    g = _events(spark, sf_dir).groupBy(F.col("event_type").alias("preset")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("p_high"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_value"), "preset")))


@query("WITH a AS (SELECT max((epoch_us(ts) // 1000)) AS now FROM events), b AS (SELECT (now - (epoch_us(ts) // 1000)) // 86400000 AS bucket, count(*) AS n, avg(value) AS v FROM events, a GROUP BY 1) SELECT CAST(bucket AS BIGINT) AS bucket, n, round(v, 6) AS mean_value, round((v - lag(v) OVER (ORDER BY bucket DESC)) / lag(v) OVER (ORDER BY bucket DESC) * 100, 4) AS change FROM b")
def daily_trend(spark, sf_dir):
    """AGG-24, WIN-14, DATE-5: 24-hour buckets counted back from the last event, with the change against the day before."""
    e = _events(spark, sf_dir)
    now = e.agg(F.max("ms").alias("now"))
    b = e.join(F.broadcast(now)).groupBy(F.floor((F.col("now") - F.col("ms")) / 86400000).alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    before = F.lag("v").over(Window.orderBy(F.desc("bucket")))
    return b.select("bucket", "n", F.round("v", 6).alias("mean_value"), F.round(F.try_divide(F.col("v") - before, before) * 100, 4).alias("change"))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour LIMIT 3")
def peak_hours(spark, sf_dir):
    """SORT-8, DATE-3."""
    return _events(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(3)


@query("SELECT event_type, CASE WHEN value > 70 THEN 'complex' WHEN value > 40 THEN 'medium' ELSE 'simple' END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def query_patterns(spark, sf_dir):
    """AGG-19."""
    v = F.col("value")
    return _events(spark, sf_dir).groupBy("event_type", F.when(v > 70, "complex").when(v > 40, "medium").otherwise("simple").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT start_ms, n, CASE WHEN n >= 50 THEN 'suspend' WHEN n >= 20 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS activity, round(n / 30.0, 6)::DOUBLE AS rate FROM (SELECT CAST(w * 300000 AS BIGINT) AS start_ms, count(*) AS n FROM (SELECT unnest([(epoch_us(ts) // 1000) // 300000, (epoch_us(ts) // 1000) // 300000 - 1]) AS w FROM events) GROUP BY 1)")
def activity_windows(spark, sf_dir):
    """STR-2, FILT-20, DATE-4: sliding windows (ten minutes every five) and their activity."""
    w = _events(spark, sf_dir).groupBy(F.window("ts", "10 minutes", "5 minutes")).agg(F.count("*").alias("n"))
    n = F.col("n")
    return w.select(F.unix_millis("window.start").alias("start_ms"), "n", F.when(n >= 50, "suspend").when(n >= 20, "high").when(n >= 10, "medium").otherwise("low").alias("activity"), F.round(n / 30, 6).alias("rate"))


@query("WITH g AS (SELECT *, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w < 3600000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(min((epoch_us(ts) // 1000)) AS BIGINT) AS first_ms, CAST(max((epoch_us(ts) // 1000)) AS BIGINT) AS last_ms, count(*) AS n FROM s GROUP BY user_id, session")
def debounce_sessions(spark, sf_dir):
    """STR-1 as batch: bursts of a user's events that are less than an hour apart."""
    s = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("n"))
    return s.select("user_id", "first_ms", "last_ms", "n")


@query("SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'view' THEN 0.5 WHEN 'click' THEN 2.0 ELSE 1.0 END + CASE WHEN r > 3 THEN 1 ELSE 0 END), 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) GROUP BY user_id HAVING sum(CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'view' THEN 0.5 WHEN 'click' THEN 2.0 ELSE 1.0 END + CASE WHEN r > 3 THEN 1 ELSE 0 END) >= 5")
def usage_scores(spark, sf_dir):
    """STR-12, FILT-19, AGG-25: weights by event type and a bonus after three of a kind."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    t = F.col("event_type")
    points = F.when(t == "purchase", 3.0).when(t == "view", 0.5).when(t == "click", 2.0).otherwise(1.0) + F.when(F.row_number().over(w) > 3, 1.0).otherwise(0.0)
    return _events(spark, sf_dir).withColumn("p", points).groupBy("user_id").agg(F.round(F.sum("p"), 6).alias("score")).where("score >= 5")


_SERIES = "SELECT user_id, ts, event_id, value, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(value, 3) OVER w AS v3, lead(value) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _series(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).select("user_id", "ts", "event_id", "value", *(F.lag("value", k).over(w).alias(f"v{k}") for k in (1, 2, 3)), F.lead("value").over(w).alias("nx"))


@query(f"SELECT event_id, round(trend, 6) AS trend, round(least(100, greatest(0, value + trend)), 6) AS next1, round(least(100, greatest(0, least(100, greatest(0, value + trend)) + trend * 0.8)), 6) AS next2 FROM (SELECT *, raw * CASE WHEN abs(raw) > 5 THEN 0.75 ELSE 1 END AS trend FROM (SELECT *, ((v2 - v3) * 1.0 + (v1 - v2) * 2.0 + (value - v1) * 3.0) / 6.0 AS raw FROM ({_SERIES})) WHERE v3 IS NOT NULL)")
def resource_trend(spark, sf_dir):
    """WIN-10: weighted mean of the last deltas, damped, with a two-step forecast."""
    c = F.col
    raw = ((c("v2") - c("v3")) * 1.0 + (c("v1") - c("v2")) * 2.0 + (c("value") - c("v1")) * 3.0) / 6.0
    s = _series(spark, sf_dir).where("v3 is not null").withColumn("raw", raw).withColumn("trend", c("raw") * F.when(F.abs("raw") > 5, 0.75).otherwise(1.0))
    clamp = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    one = clamp(c("value") + c("trend"))
    return s.select("event_id", F.round("trend", 6).alias("trend"), F.round(one, 6).alias("next1"), F.round(clamp(one + c("trend") * 0.8), 6).alias("next2"))


@query(f"WITH x AS (SELECT *, CASE WHEN v1 IS NOT NULL AND nx IS NOT NULL AND (value > v1 AND value > nx OR value < v1 AND value < nx) THEN 1 ELSE 0 END AS ext FROM ({_SERIES})) SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN s >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS oscillating FROM (SELECT user_id, sum(ext) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s FROM x) GROUP BY user_id")
def oscillation(spark, sf_dir):
    """WIN-12: three or more local extrema among the last six samples."""
    v, a, b = F.col("value"), F.col("v1"), F.col("nx")
    ext = F.when(a.isNotNull() & b.isNotNull() & (((v > a) & (v > b)) | ((v < a) & (v < b))), 1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 0)
    s = _series(spark, sf_dir).withColumn("ext", ext).select("user_id", F.sum("ext").over(w).alias("s"))
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("s") >= 3).alias("oscillating"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS peak, arg_max(event_id, (value, -event_id)) AS slowest, round(arg_max(value, (ts, event_id)), 6) AS current FROM events GROUP BY 1")
def metric_summary(spark, sf_dir):
    """AGG-20: counts, means, peaks, the slowest and the current sample."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("peak"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("slowest"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("current"))


@query("WITH r AS (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY ALL), m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS sessions FROM r, m WHERE last > now - INTERVAL 2 DAY GROUP BY 1 HAVING count(*) > 1")
def session_conflicts(spark, sf_dir):
    """AGG-29, FILT-20, STR-18: projects (event types) with several active sessions."""
    e = _events(spark, sf_dir)
    r = e.groupBy("event_type", "user_id").agg(F.max("ts").alias("last")).join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return r.where(F.col("last") > F.col("now") - F.expr("INTERVAL 2 DAYS")).groupBy("event_type").agg(F.count("*").alias("sessions")).where("sessions > 1")


@query("SELECT event_id, CASE WHEN n >= 20 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS activity, greatest(100.0, least(10000.0, CASE WHEN n >= 20 THEN 3.0 WHEN n >= 10 THEN 1.5 ELSE 0.8 END * CASE WHEN event_type = 'error' THEN 0.5 WHEN event_type = 'view' THEN 2.0 ELSE 1.0 END * 500))::DOUBLE AS delay_ms FROM (SELECT *, count(*) OVER (PARTITION BY user_id, (epoch_us(ts) // 1000) // 86400000) AS n FROM events)")
def debounce_delays(spark, sf_dir):
    """MATH-14, AGG-28: delay by activity and priority."""
    e = _events(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("user_id", F.floor(F.col("ms") / 86400000)))
    a = e.select("event_id", "event_type", n.alias("n")).withColumn("activity", F.when(F.col("n") >= 20, "high").when(F.col("n") >= 10, "medium").otherwise("low"))
    priority = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "low").otherwise("high")
    return a.select("event_id", "activity", debounce_ms(F.col("activity"), priority).alias("delay_ms"))


@query("SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, ts, event_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) WHERE rank <= 100")
def priority_queue(spark, sf_dir):
    """SORT-9, SORT-10, STR-4: one entry a user (the latest), by weight then age, capped at 100."""
    from lodestone.operators.delta import latest

    last = latest(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    t = F.col("event_type")
    weight = F.when(t == "error", 4).when(t == "purchase", 3).when(t == "click", 2).otherwise(1)
    top = last.withColumn("w", weight).orderBy(F.desc("w"), "ts", "event_id").limit(100)
    return top.select("event_id", "user_id", F.row_number().over(Window.orderBy(F.desc("w"), "ts", "event_id")).alias("rank"))


@query("SELECT user_id, round(avg(x), 6) AS weighted FROM (SELECT user_id, value * (rank * 2.0 / (n * (n + 1))) * n AS x FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY user_id")
def recency_weighted(spark, sf_dir):
    """WIN-13: mean with weights 1 to n by recency."""
    w = Window.partitionBy("user_id")
    e = _events(spark, sf_dir).select("user_id", "value", F.row_number().over(w.orderBy("ts", "event_id")).alias("rank"), F.count("*").over(w).alias("n"))
    return e.groupBy("user_id").agg(F.round(F.avg(F.col("value") * (F.col("rank") * 2.0 / (F.col("n") * (F.col("n") + 1))) * F.col("n")), 6).alias("weighted"))


@query("SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_p95(spark, sf_dir):
    """AGG-35: the 95th percentile as an element of the data."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"))
