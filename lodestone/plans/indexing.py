"""Indexing of documents as files, whole and from an older snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import indexing
from lodestone.plans.registry import query
from lodestone.session import load

_NEW_SQL = "n AS (SELECT doc_id, 'f' || doc_id || '.md' AS file_path, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'more' ELSE text END AS content FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 2)"
_OLD_SQL = "o AS (SELECT 'f' || doc_id || '.md' AS file_path, text AS content FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 1)"
_CHUNKS_SQL = "SELECT file_path, content, i * 5 + 1 AS start_line, least(len(l), (i + 1) * 5) AS end_line, sha256(array_to_string(l[i * 5 + 1 : i * 5 + 5], chr(10))) AS h FROM (SELECT *, unnest(range(0, CAST(ceil(len(l) / 5.0) AS BIGINT))) AS i FROM (SELECT *, string_split(content, chr(10)) AS l FROM {0}))"


def _embed(text):
    """A stand-in for a model: one number."""
    return F.array(F.crc32(text.cast("binary")).cast("double"))


def _files(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where("text is not null")
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path")
    new = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    return d.where("doc_id % 10 <> 1").select(path, F.col("text").alias("content")), d.where("doc_id % 10 <> 2").select(path, new.alias("content"))


@query(f"WITH {_NEW_SQL}, c AS ({_CHUNKS_SQL.format('n')}) SELECT file_path, count(*) AS chunks, CAST(max(end_line) AS INTEGER) AS lines, min(h) AS first_hash FROM c GROUP BY file_path")
def full_index(spark, sf_dir):
    """IDX-1, GEN-1: files chunked by language, hashed and embedded."""
    index = indexing.full_index(_files(spark, sf_dir)[1], _embed, 5)
    return index.groupBy("file_path").agg(F.count("*").alias("chunks"), F.max("end_line").alias("lines"), F.min("content_hash").alias("first_hash"))


@query(f"WITH {_NEW_SQL}, {_OLD_SQL}, c AS ({_CHUNKS_SQL.format('n')}), k AS (SELECT DISTINCT file_path, h FROM ({_CHUNKS_SQL.format('o')})) SELECT c.file_path, count(*) AS chunks, CAST(count(k.h) AS BIGINT) AS reused FROM c LEFT JOIN k ON k.file_path = c.file_path AND k.h = c.h GROUP BY c.file_path")
def incremental_index(spark, sf_dir):
    """IDX-2, JOIN-11, JOIN-12: the same rows from an older index; only new content is embedded."""
    old, new = _files(spark, sf_dir)
    index = indexing.incremental_index(indexing.full_index(old, _embed, 5), new, _embed, 5)
    return index.groupBy("file_path").agg(F.count("*").alias("chunks"), F.count_if("reused").alias("reused"))
