"""Whole and incremental indexing of files: chunks with hashes and embeddings.

An index has rows (file_path, file_hash, chunk, start_line, end_line, content_hash, embedding).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import language_of
from lodestone.operators import chunking
from lodestone.operators.delta import diff

COLUMNS = ["file_path", "file_hash", "chunk", "start_line", "end_line", "content_hash", "embedding"]


def chunk_files(files: DataFrame, lines: int = 50) -> DataFrame:
    """Files (file_path, content) to chunks by language: Python and scripts by their structure, the rest by windows of lines."""
    f = files.withColumn("file_hash", F.sha2("content", 256)).withColumn("lang", language_of(F.col("file_path")))
    code = F.col("lang").isin("python", "javascript", "typescript")
    parsed = chunking.code_chunks(f.where(code), "file_path", "lang", "content").withColumnRenamed("content", "body").select("file_path", "start_line", "end_line", "body")
    plain = chunking.window_chunks(f.where(~code), "file_path", "content", lines).withColumnRenamed("content", "body").select("file_path", "start_line", "end_line", "body")
    both = parsed.unionByName(plain).join(f.select("file_path", "file_hash"), "file_path")
    return both.select("file_path", "file_hash", F.col("start_line").cast("int").alias("chunk"), "start_line", "end_line", F.sha2("body", 256).alias("content_hash"), "body")


def full_index(files: DataFrame, embed: Callable[[Column], Column], lines: int = 50) -> DataFrame:
    return chunk_files(files, lines).withColumn("embedding", embed(F.col("body"))).select(*COLUMNS)


def incremental_index(index: DataFrame, files: DataFrame, embed: Callable[[Column], Column], lines: int = 50) -> DataFrame:
    """The index of ``files`` from an older one, with ``reused``: unchanged files keep their rows, changed ones are chunked again, and a chunk whose content the file had keeps its embedding."""
    old = index.select("file_path", F.col("file_hash").alias("h")).distinct()
    change = diff(old, files.select("file_path", F.sha2("content", 256).alias("h")), "file_path", "h")
    same = change.where(F.col("change") == "unchanged").select("file_path")
    todo = change.where(F.col("change").isin("added", "modified")).select("file_path")
    kept = index.join(same, "file_path", "left_semi").select(*COLUMNS).withColumn("reused", F.lit(True))
    known = index.groupBy("file_path", "content_hash").agg(F.first("embedding").alias("known"))
    fresh = chunk_files(files.join(todo, "file_path", "left_semi"), lines).join(known, ["file_path", "content_hash"], "left")
    vector = F.when(F.col("known").isNotNull(), F.col("known")).otherwise(embed(F.col("body")))
    return kept.unionByName(fresh.withColumn("embedding", vector).withColumn("reused", F.col("known").isNotNull()).select(*COLUMNS, "reused"))
