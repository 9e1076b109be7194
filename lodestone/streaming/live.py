"""Live changes: event-time windows, coalescing, deduplication, upserts by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A table as a stream of files; ts becomes TIMESTAMP so that it can carry a watermark."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a file source reads folders; the glob keeps a single file or a folder of parts
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return s.parquet(f"{sf_dir}/{name}*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, sink, mode: str = "update") -> None:
    """Feeds what is there to ``sink(batch, batch_id)`` and returns."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()


class VersionedTable:
    """A table that a micro-batch replaces as a whole: versions are folders, and a version counts once its mark is written.

    With ``base`` the table is found again after a restart; a batch that is run again writes its version anew.
    """

    def __init__(self, spark: SparkSession, label: str, schema, base: str | None = None):
        self.spark, self.schema = spark, schema
        self.base = base or f"{shared_dir(spark)}/live/{label}-{uuid.uuid4().hex}"
        self.version = self._newest() if base else -1

    def _newest(self) -> int:
        try:
            marks = self.spark.read.schema("version long").parquet(f"{self.base}/marks")
            return marks.agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
        except AnalysisException:  # nothing was written yet
            return -1

    def read(self) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{self.version}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.base}/marks")
        self.version = version


def windowed_counts(events: DataFrame, watermark: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events and their mean by window and type; late rows beyond the watermark are dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def debounced(events: DataFrame, key: str, gap: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Bursts by key: session windows."""
    return events.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, key: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
