"""Sources, sinks, staging and invalidation over the test tables; what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import staging
from lodestone.plans.registry import query
from lodestone.session import load, shared_dir
from lodestone.sources import files, stores


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/stores/{label}-{uuid.uuid4().hex}"


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE source END AS source FROM documents WHERE doc_id IS NOT NULL")
def index_store(spark, sf_dir):
    """SRC-6, SRC-7, SRC-10, SRC-20: save, upsert by key, synchronise with a second store, load there."""
    docs = load(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "source").dropDuplicates(["doc_id"])
    a, b = stores.TableStore(spark, _folder(spark, "a")), stores.TableStore(spark, _folder(spark, "b"))
    stores.save_both(docs, a, b)
    a.upsert(docs.where("doc_id % 5 = 0").withColumn("source", F.lit("new")), "doc_id")
    stores.sync(a, b)
    return b.load()


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event_type")
def telemetry_store(spark, sf_dir):
    """SRC-13, SRC-14: JSON lines by day with a malformed line among them; older days are not read."""
    path = _folder(spark, "telemetry")
    stores.append_telemetry(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), path)
    spark.createDataFrame([("{not json", "2024-01-11")], "value string, day string").write.partitionBy("day").mode("append").text(path)
    rows = stores.read_telemetry(spark, path, "event_id long, user_id long, event_type string, ts string", "2024-01-10")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("SELECT file_path, hash, status FROM (SELECT 'user-' || user_id AS file_path, CAST(event_id AS VARCHAR) AS hash, 'modified' AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM events) WHERE r = 1")
def latest_commit(spark, sf_dir):
    """SRC-4: events as a commit log, users as files."""
    log = load(spark, sf_dir, "events").select(F.concat(F.lit("user-"), "user_id").alias("file_path"), F.col("event_id").cast("string").alias("hash"), F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("message"), F.col("ts").alias("date"))
    return files.latest_commits(log).select("file_path", "hash", "status")


@query("SELECT count(DISTINCT event_id) AS distance FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id = 10) AND ts <= (SELECT max(ts) FROM events WHERE event_id = 40)")
def commit_distance(spark, sf_dir):
    """SRC-5."""
    log = load(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("hash"), F.col("ts").alias("date"))
    return files.commit_distance(log, "10", "40")


@query("WITH f AS (SELECT doc_id, source || '/' || doc_id AS file_path, lang = 'en' AS tracked, n_chars FROM documents WHERE source <> 'src3' AND n_chars <= 100 * 1024) SELECT file_path, 'modified' AS status FROM f WHERE tracked UNION ALL SELECT file_path, 'new' FROM (SELECT *, row_number() OVER (ORDER BY doc_id, file_path) AS r FROM f WHERE NOT tracked) WHERE r <= 50")
def staged_files(spark, sf_dir):
    """STR-11, FILT-11: the limit on untracked files is the feature."""
    f = load(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("file_path"), (F.col("lang") == "en").alias("tracked"), F.col("n_chars").alias("size"), F.col("doc_id").alias("arrived"))
    return staging.stage(f, 50, 100, ("src3/**",)).select("file_path", "status")


_STALE = "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 97 = 5)"


def _stale(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_path"))
    return staging.stale_chunks(d, d.where("chunk_id % 97 = 5"))


@query(f"SELECT DISTINCT source AS file_path FROM ({_STALE})")
def reindex_files(spark, sf_dir):
    """STR-8, STR-9: files of the invalid chunks."""
    return staging.files_to_reindex(_stale(spark, sf_dir))


@query(f"SELECT count(*) AS pending, count(*) = 0 AS fresh, count(*) > 50 AS reindex FROM ({_STALE})")
def freshness_status(spark, sf_dir):
    """STR-8, STR-10."""
    return staging.freshness(_stale(spark, sf_dir))
