"""Stored state: index, graph, embedding cache, telemetry, registries, backups, synchronisation, reports.

A store is a folder; every save writes a new version beside the old ones and
is complete once its success marker stands, so a lost executor or driver
leaves the last complete version readable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a store, oldest first (one listing of one folder on the driver)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n[:2] == "v=" and n[2:].isdigit() and _exists(spark, f"{path}/{n}/_SUCCESS"))


class TableStore:
    """A versioned Parquet table: index, graph nodes, graph edges or embedding cache."""

    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd"):
        self.spark, self.path, self.compression = spark, path.rstrip("/"), compression

    def version(self) -> int | None:
        found = _versions(self.spark, self.path)
        return found[-1] if found else None

    def load(self) -> DataFrame | None:
        """The newest complete version; None if there is none."""
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/v={v}")

    def save(self, df: DataFrame, partition_by: str | None = None) -> int:
        """Writes ``df`` as the next version. It may read the present one."""
        v = (self.version() or 0) + 1
        w = df.write.mode("overwrite").option("compression", self.compression)
        (w.partitionBy(partition_by) if partition_by else w).parquet(f"{self.path}/v={v}")
        return v

    def upsert(self, rows: DataFrame, key: str) -> int:
        """Replaces rows by key and keeps the others; of several new rows of a key any one may stay."""
        old, new = self.load(), rows.dropDuplicates([key])
        return self.save(new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new))


def save_both(df: DataFrame, local: TableStore, remote: TableStore) -> None:
    """Writes ``df`` once and copies the written table to the second store, so it is computed once."""
    local.save(df)
    remote.save(local.load())


def sync(a: TableStore, b: TableStore) -> str:
    """Copies the store with the higher version to the other; says what was done. Equal versions stay."""
    va, vb = a.version() or 0, b.version() or 0
    if va == vb:
        return "equal" if va else "empty"
    source, target = (a, b) if va > vb else (b, a)
    source.load().write.mode("overwrite").parquet(f"{target.path}/v={max(va, vb)}")
    return "first to second" if va > vb else "second to first"


def backup(store: TableStore, target: str, source_name: str = "index") -> DataFrame:
    """Copies a store that has rows and appends a manifest row; raises ValueError if there is nothing to keep."""
    rows = store.load()
    n = 0 if rows is None else rows.count()
    if not n:
        raise ValueError(f"nothing to back up in {store.path}")
    name = uuid.uuid4().hex
    rows.write.parquet(f"{target}/data/{name}")
    one = store.spark.range(1).select(F.lit(name).alias("backup"), F.lit(source_name).alias("source"), F.lit(store.version()).alias("version"), F.lit(n).alias("rows"), F.current_timestamp().alias("taken"))
    one.write.mode("append").parquet(f"{target}/manifest")
    return store.spark.read.parquet(f"{target}/manifest")


def restore(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/data/{name}")


def append_telemetry(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends JSON lines by UTC day."""
    events.withColumn("day", F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd")).write.partitionBy("day").mode("append").json(path)


def read_telemetry(spark: SparkSession, path: str, schema: str, since_day: str | None = None) -> DataFrame:
    """All lines that parse, optionally from a UTC day on (whole older folders are not read)."""
    rows = spark.read.schema(f"{schema}, day string, bad_ string").option("columnNameOfCorruptRecord", "bad_").option("mode", "PERMISSIVE").json(path)
    if since_day:
        rows = rows.where(F.col("day") >= since_day)
    return rows.where(F.col("bad_").isNull()).drop("bad_")


def register(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """Adds or replaces entries of a registry (projects, sessions) and returns it."""
    store = TableStore(spark, path)
    store.upsert(rows, key)
    return store.load()


def export_report(df: DataFrame, path: str, title: str, limit: int = 1000) -> str:
    """A report table as Markdown: at most ``limit`` rows, a report is for reading. Returns the text and writes it."""
    rows = df.limit(limit).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]
    text = "\n".join(lines) + "\n"
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def embed_with(texts: DataFrame, key: str, text: str, provider, batch: int = 256) -> DataFrame:
    """key and embedding from ``provider``, a picklable function from a list of texts to a list of vectors.

    Texts go in Arrow batches; the provider sees at most ``batch`` at a time.
    """

    def run(frames):
        for pdf in frames:
            vectors: list = []
            for at in range(0, len(pdf), batch):
                vectors += list(provider(pdf[text].iloc[at : at + batch].fillna("").tolist()))
            yield pdf[[key]].assign(embedding=[list(map(float, v)) for v in vectors])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
