"""Repositories as tables: file scans, changed files, commit logs, page reads, live change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import SKIP_DIRS, extension, is_relevant, language_of
from lodestone.operators.delta import diff

#: One entry of a change log that a watcher appends to.
CHANGE = T.StructType([T.StructField("type", T.StringType()), T.StructField("path", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("size", T.LongType())])


def relative(path: Column, root: str) -> Column:
    """The part of a file URI below ``root``."""
    return F.regexp_replace(path, r"^.*?\Q" + root.rstrip("/").removeprefix("file://") + r"\E/", "")


def scan_repository(spark: SparkSession, root: str, relevant_only: bool = True) -> DataFrame:
    """Every file below ``root``: file_path, content, size, modified, language, content_hash.

    The listing and the read are distributed; content is decoded as UTF-8 and
    null where the bytes are not text. A file that vanishes meanwhile is left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    files = raw.select(relative(F.col("path"), root).alias("file_path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if relevant_only:
        files = files.where(is_relevant(F.concat(F.lit("/"), F.col("file_path"))))
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    return files.select("file_path", text.alias("content"), "size", "modified", language_of(F.col("file_path")).alias("language"), F.sha2("content", 256).alias("content_hash"))


def scan_changed(spark: SparkSession, root: str, stored: DataFrame) -> DataFrame:
    """The scanned files that are new or differ from ``stored`` (file_path, content_hash)."""
    now = scan_repository(spark, root)
    changed = diff(stored, now, "file_path", "content_hash").where("change in ('added', 'modified')")
    return now.join(changed.select("file_path"), "file_path", "left_semi")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One whole text file: file_path, content. A missing file is an error, as it is for every Spark source."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("content"))


def latest_commits(log: DataFrame) -> DataFrame:
    """The newest commit of every file from a log (file_path, hash, author, message, date); ties go to the larger hash."""
    newest = F.max_by(F.struct("hash", "author", "message", "date"), F.struct("date", "hash"))
    return log.groupBy("file_path").agg(newest.alias("c")).select("file_path", "c.*", F.lit("modified").alias("status"))


def commit_distance(log: DataFrame, since: str, until: str) -> DataFrame:
    """One row, ``distance``: commits after ``since`` up to ``until``; 0 if either is unknown."""
    at = lambda h: F.max(F.when(F.col("hash") == h, F.col("date")))
    ends = log.agg(at(since).alias("low"), at(until).alias("high"))
    inside = log.select("hash", "date").distinct().join(F.broadcast(ends), (F.col("date") > F.col("low")) & (F.col("date") <= F.col("high")))
    return inside.agg(F.countDistinct("hash").alias("distance"))


def project_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Name, version and number of dependencies of every package manifest below ``root``."""
    schema = "name string, version string, dependencies map<string,string>, devDependencies map<string,string>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").json(root)
    size = lambda c: F.coalesce(F.size(F.map_keys(c)), F.lit(0))
    return raw.select(relative(F.input_file_name(), root).alias("file_path"), "name", "version", size("dependencies").alias("dependencies"), size("devDependencies").alias("dev_dependencies"))


def change_stream(spark: SparkSession, log_dir: str, exclude: tuple[str, ...] = SKIP_DIRS, settle_ms: int = 0) -> DataFrame:
    """File changes as a stream from a folder of JSON lines; folders and excluded paths are left out.

    ``settled`` is the time from which a change counts as complete.
    """
    s = spark.readStream.schema(CHANGE).json(log_dir).where(F.col("type").isin("add", "change", "unlink"))
    for d in exclude:
        s = s.where(~F.concat(F.lit("/"), F.col("path"), F.lit("/")).contains(f"/{d}/"))
    return s.withColumn("ts", F.timestamp_millis("timestamp")).withColumn("settled", F.timestamp_millis(F.col("timestamp") + settle_ms)).withColumn("ext", extension(F.col("path")))
