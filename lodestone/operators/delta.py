"""Index deltas: file and chunk differences, their application, caches, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of every key by ``order`` (columns, ascending), as an aggregate: no sort of whole groups."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key and change: added, modified, deleted or unchanged."""
    o, n = old.select(key, F.col(value).alias("old_")), new.select(key, F.col(value).alias("new_"))
    j = o.withColumn("in_old", F.lit(True)).join(n.withColumn("in_new", F.lit(True)), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("old_").eqNullSafe(F.col("new_")), "modified").otherwise("unchanged")
    return j.select(key, change.alias("change"))


def chunk_diff(old: DataFrame, new: DataFrame, file: str, digest: str) -> DataFrame:
    """(file, digest, action): keep, add or remove; one row per file and content."""
    o = old.select(file, digest).distinct().withColumn("in_old", F.lit(True))
    n = new.select(file, digest).distinct().withColumn("in_new", F.lit(True))
    action = F.when(F.col("in_old").isNull(), "add").when(F.col("in_new").isNull(), "remove").otherwise("keep")
    return o.join(n, [file, digest], "full_outer").select(file, digest, action.alias("action"))


def apply_delta(index: DataFrame, removed: DataFrame, upserts: DataFrame, key: str) -> DataFrame:
    """Index without removed and replaced keys, plus the upserts."""
    gone = removed.select(key).union(upserts.select(key)).distinct()
    return index.join(gone, key, "left_anti").unionByName(upserts)


def replace_files(index: DataFrame, changed: DataFrame, fresh: DataFrame, file: str) -> DataFrame:
    """Delete by file, then insert: rows of a changed file that vanished do not stay."""
    return index.join(changed.select(file).distinct(), file, "left_anti").unionByName(fresh)


def with_cache(rows: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the cached value (null on a miss) and hit."""
    return rows.join(cache.select(key, value), key, "left").withColumn("hit", F.col(value).isNotNull())


def evict(cache: DataFrame, key: str, last_used: str, capacity: int, share: float = 0.2, fill: float = 0.8) -> DataFrame:
    """Keys to evict: once over ``fill`` of the capacity, the least recently used ``share`` of it."""
    n = cache.count()
    return cache.select(key, last_used).orderBy(last_used, key).limit(int(n * share) if n > fill * capacity else 0).select(key)


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row of every key, the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
