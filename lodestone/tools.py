"""The tool surface: named searches, paged results, projects and health, as functions that return DataFrames.

An index is two tables: chunks (chunk_id, file_path, embedding and whatever
else they carry) and edges between chunks (src, dst, type, strength). Every
tool is a plan over them; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import pages
from lodestone.functions.vector import cosine
from lodestone.operators.graph import traversable
from lodestone.session import materialize
from lodestone.sources.stores import TableStore


@dataclass(frozen=True)
class Shape:
    """How a tool searches: seeds, hops, followed edge types (none: all), decay of the score per hop, least strength."""

    k: int
    hops: int = 0
    types: tuple[str, ...] = ()
    decay: float = 1.0
    min_strength: float = 0.0
    direction: str = "out"


#: The defaults of the tools.
SHAPES = {
    "semantic_search": Shape(20, 2, ("calls",), 0.8),
    "contextual_read": Shape(10),
    "code_intelligence": Shape(20, 3, ("calls", "imports", "data_flow"), 0.7),
    "relationship_analysis": Shape(30, 3, ("calls", "imports", "data_flow"), 0.9),
    "trace_execution_path": Shape(25, 5, ("calls", "throws"), 0.8),
    "find_code_patterns": Shape(10, 2, ("calls", "imports", "extends", "implements"), 0.9, 0.7),
}


class Workspace:
    """The search tools over one index."""

    def __init__(self, chunks: DataFrame, edges: DataFrame):
        self.chunks, self.edges = chunks, edges

    def search(self, vector: list[float], shape: Shape, where: Column | None = None) -> DataFrame:
        """The chunks' columns with score and hop.

        The ``shape.k`` nearest by cosine (ties: smaller chunk_id) are hop 0; a
        chunk first reached by hop h scores the best score before it times the
        decay. Chunks without a vector are reached by edges only; ``where``
        restricts the seeds. Edges to unknown chunks lead nowhere.
        """
        query = F.array(*(F.lit(float(x)) for x in vector))
        able = self.chunks.where(F.size("embedding") > 0)
        able = able if where is None else able.where(where)
        seeds = able.select(F.col("chunk_id").alias("node"), cosine("embedding", query).alias("score")).orderBy(F.desc("score"), "node").limit(shape.k)
        seeds = seeds.withColumn("hop", F.lit(0))
        seen = frontier = materialize(seeds, "tool-seeds") if shape.hops else seeds  # later hops read it, not the scan of all vectors
        e = traversable(self.edges, shape.types, shape.min_strength)
        if shape.direction == "in":
            e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        known = self.chunks.select(F.col("chunk_id").alias("dst")).distinct()
        e = e.select("src", "dst").distinct().join(known, "dst", "left_semi") if shape.hops else e
        for h in range(1, shape.hops + 1):
            step = frontier.join(e, frontier["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg((F.max("score") * shape.decay).alias("score"))
            frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
            frontier = materialize(frontier, "tool-hop") if h < shape.hops else frontier
            seen = seen.unionByName(frontier)
        return self.chunks.join(seen.withColumnRenamed("node", "chunk_id"), "chunk_id")

    def semantic_search(self, vector: list[float], k: int = 20, hops: int = 2) -> DataFrame:
        return self.search(vector, replace(SHAPES["semantic_search"], k=k, hops=hops))

    def contextual_read(self, vector: list[float], file_path: str) -> DataFrame:
        """The nearest chunks of one file."""
        return self.search(vector, SHAPES["contextual_read"], F.col("file_path") == file_path)

    def code_intelligence(self, vector: list[float], max_tokens: int = 4000) -> DataFrame:
        """As many seeds as 200 tokens each allow."""
        return self.search(vector, replace(SHAPES["code_intelligence"], k=max_tokens // 200))

    def relationship_analysis(self, vector: list[float], types: tuple[str, ...] | None = None, max_depth: int = 3) -> DataFrame:
        base = SHAPES["relationship_analysis"]
        return self.search(vector, replace(base, hops=max_depth, types=types or base.types))

    def trace_execution_path(self, vector: list[float], data_flow: bool = False, backward: bool = False, max_depth: int = 5) -> DataFrame:
        types = ("calls", "data_flow", "throws") if data_flow else ("calls", "throws")
        return self.search(vector, replace(SHAPES["trace_execution_path"], types=types, hops=max_depth, direction="in" if backward else "out"))

    def find_code_patterns(self, vector: list[float], scope: str = "project", min_strength: float = 0.7, k: int = 10) -> DataFrame:
        """At most five seeds where the scope is a file or a module."""
        return self.search(vector, replace(SHAPES["find_code_patterns"], k=min(k, 5) if scope in ("file", "module") else k, min_strength=min_strength))


def result_pages(results: DataFrame, key: str, text: str, size: int = 20000) -> DataFrame:
    """key, page (from 0), total, part: what the paging tools read. A null text has one empty page."""
    cut = results.select(key, pages(F.coalesce(F.col(text), F.lit("")), size).alias("parts_"))
    return cut.select(key, F.size("parts_").alias("total"), F.posexplode("parts_").alias("page", "part"))


def fetch_chunk(paged: DataFrame, page: int = 0) -> DataFrame:
    """One page of every result; results with fewer pages give no row."""
    return paged.where(F.col("page") == page)


def next_chunk(paged: DataFrame, cursors: DataFrame, key: str) -> DataFrame:
    """The page after each cursor (key, page); a cursor at the end gives no row."""
    after = cursors.select(key, (F.col("page") + 1).alias("page"))
    return paged.join(after, [key, "page"])


class Projects:
    """A registry of projects (project_id, name, path, active) with at most one active."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store = TableStore(spark, folder)

    def list_projects(self) -> DataFrame | None:
        return self.store.load()

    def add_project(self, rows: DataFrame) -> None:
        """Adds or replaces projects; they are not active."""
        self.store.upsert(rows.select("project_id", "name", "path").withColumn("active", F.lit(False)), "project_id")

    def switch_project(self, project_id) -> None:
        """Raises KeyError for an unknown project and leaves the present one active."""
        rows = self.store.load()
        if rows is None or rows.where(F.col("project_id") == project_id).isEmpty():
            raise KeyError(project_id)
        self.store.save(rows.withColumn("active", F.col("project_id") == project_id))

    def get_current_project(self) -> DataFrame | None:
        rows = self.store.load()
        return None if rows is None else rows.where("active")


def session_health(sessions: DataFrame, now: Column, idle_seconds: int = 60) -> DataFrame:
    """Adds uptime_s and health to sessions (status, started, last_activity, checks: array<boolean>, latest last).

    error by status; warning when idle or when over half of the last three checks failed; else good. A null time counts as idle.
    """
    last = F.slice("checks", F.greatest(F.size("checks") - 2, F.lit(1)), F.lit(3))
    failed = F.size(F.filter(last, lambda x: ~F.coalesce(x, F.lit(False)))) / F.size(last)
    idle = F.coalesce(F.timestamp_diff("SECOND", F.col("last_activity"), now) > idle_seconds, F.lit(True))
    bad = F.coalesce((F.size("checks") > 0) & (failed > 0.5), F.lit(False))
    health = F.when(F.col("status") == "error", "error").when(idle | bad, "warning").otherwise("good")
    return sessions.withColumn("uptime_s", F.timestamp_diff("SECOND", F.col("started"), now)).withColumn("health", health)


def multi_instance_health(sessions: DataFrame, now: Column, recent_errors: int = 0, memory_percent: float = 0.0) -> DataFrame:
    """One row: sessions, conflicts (projects with several sessions), warnings, overall."""
    rows = session_health(sessions, now)
    by_project = rows.groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col("health") == "warning").alias("w"))
    one = by_project.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"), F.count_if(F.col("n") > 1).alias("conflicts"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"))
    unhealthy = (F.col("conflicts") > 0) | F.lit(recent_errors > 3)
    return one.withColumn("overall", F.when(unhealthy, "unhealthy").when(F.lit(memory_percent > 80) | (F.col("warnings") > 0), "degraded").otherwise("healthy"))


def request_dashboard(requests: DataFrame, window: int = 100) -> DataFrame:
    """One row: requests, errors, and mean and longest time of the latest ``window`` of them (ts, ms, failed)."""
    total = requests.agg(F.count("*").alias("requests"), F.count_if("failed").alias("errors"))
    late = requests.orderBy(F.desc("ts"), F.desc("ms")).limit(window).agg(F.avg("ms").alias("mean_ms"), F.max("ms").alias("longest_ms"))
    return total.join(late)
