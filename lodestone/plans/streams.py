"""Streaming queries run to completion over what is there; the SQL is the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.delta import latest
from lodestone.plans.registry import query
from lodestone.streaming.live import VersionedTable, debounced, event_stream, run_available, windowed_counts


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_latest(spark, sf_dir):
    """STR-4, STR-6, STR-7: every micro-batch keeps the latest event of a user and upserts it."""
    table = VersionedTable(spark, "latest", "user_id long, ts timestamp, event_id long, event_type string")

    def merge(batch, i):
        rows = batch.select("user_id", "ts", "event_id", "event_type")
        table.write(latest(table.read().unionByName(rows), ["user_id"], ["ts", "event_id"]), i)

    run_available(event_stream(spark, sf_dir), merge, "append")
    return table.read().select("user_id", "event_id", "event_type")


@query("SELECT CAST((epoch_us(ts) // 1000) // 3600000 * 3600000 AS BIGINT) AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """STR-2, STR-5: event-time windows with a watermark, in update mode; the last state of a window counts."""
    table = VersionedTable(spark, "windows", "start_ms long, event_type string, n long")

    def merge(batch, i):
        rows = batch.select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n")
        table.write(table.read().unionByName(rows).groupBy("start_ms", "event_type").agg(F.max("n").alias("n")), i)

    run_available(windowed_counts(event_stream(spark, sf_dir), watermark="60 days"), merge)
    return table.read()


@query("WITH g AS (SELECT *, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w < 3600000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(min((epoch_us(ts) // 1000)) AS BIGINT) AS start_ms, count(*) AS n FROM s GROUP BY user_id, session")
def stream_debounce(spark, sf_dir):
    """STR-1: session windows per key, written when the watermark has passed them (and at the end)."""
    table = VersionedTable(spark, "debounce", "user_id long, start_ms long, n long")

    def merge(batch, i):
        rows = batch.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n")
        table.write(table.read().unionByName(rows).groupBy("user_id", "start_ms").agg(F.max("n").alias("n")), i)

    run_available(debounced(event_stream(spark, sf_dir), "user_id", watermark="60 days"), merge, "complete")
    return table.read()
