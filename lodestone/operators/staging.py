"""Staging of changed files and invalidation of stale chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import glob_regex


def stage(files: DataFrame, max_untracked: int = 50, max_kb: int | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files to stage, with status: modified if tracked, else new.

    ``files`` has file_path, tracked, size, arrived. Excluded globs and files
    over ``max_kb`` are left out. The number of untracked files is a limit of
    the feature: the first ``max_untracked`` by arrival stay (ties by path).
    """
    ok = files
    for g in exclude:
        ok = ok.where(~F.col("file_path").rlike(glob_regex(g)))
    if max_kb is not None:
        ok = ok.where(F.col("size") <= max_kb * 1024)
    first = ok.where(~F.col("tracked")).orderBy("arrived", "file_path").limit(max_untracked)
    both = ok.where(F.col("tracked")).unionByName(first)
    return both.withColumn("status", F.when(F.col("tracked"), "modified").otherwise("new"))


def mark_indexed(staged: DataFrame, indexed: DataFrame) -> DataFrame:
    """Staged files with status indexed where ``indexed`` has their file_path."""
    done = indexed.select("file_path").distinct().withColumn("done_", F.lit(True))
    return staged.join(done, "file_path", "left").withColumn("status", F.when(F.col("done_"), "indexed").otherwise(F.col("status"))).drop("done_")


def stale_chunks(index: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks of changed files: the invalidation set."""
    return index.join(changed.select("file_path").distinct(), "file_path", "left_semi").select("chunk_id", "file_path")


def files_to_reindex(stale: DataFrame) -> DataFrame:
    return stale.select("file_path").distinct()


def freshness(stale: DataFrame, threshold: int = 50) -> DataFrame:
    """One row: pending, fresh (nothing is pending), reindex (more than ``threshold`` are)."""
    n = F.count("*")
    return stale.agg(n.alias("pending"), (n == 0).alias("fresh"), (n > threshold).alias("reindex"))


def invalidation_runs(changes: DataFrame, key: str, order: str, weight: str, threshold: int = 50) -> DataFrame:
    """Adds ``run``, the number of reindexes before a change, and ``pending``, by ``key`` in ``order``.

    Stale chunks (``weight`` a change) add up since the last reindex; one
    happens when they exceed the threshold, and clears them. A key's rows pass
    one task in order; the fold keeps two numbers, whatever their count.
    """
    schema = T.StructType([*changes.schema.fields, T.StructField("run", T.LongType()), T.StructField("pending", T.LongType())])

    def fold(batches):
        last, pending, runs, first = None, 0, 0, True
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            weights = batch.column(batch.schema.get_field_index(weight)).to_pylist()
            out_runs, out_pending = [], []
            for k, w in zip(keys, weights, strict=True):
                if first or k != last:
                    last, pending, runs, first = k, 0, 0, False
                pending += int(w or 0)
                if pending > threshold:
                    pending, runs = 0, runs + 1
                out_runs.append(runs)
                out_pending.append(pending)
            yield pa.record_batch([*batch.columns, pa.array(out_runs, pa.int64()), pa.array(out_pending, pa.int64())], names=[*batch.schema.names, "run", "pending"])

    return changes.repartition(key).sortWithinPartitions(key, order).mapInArrow(fold, schema)
