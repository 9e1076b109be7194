"""Graph operators over edge tables (from, to, type, strength, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialize


def traversable(edges: DataFrame, types=(), min_strength: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    """Filters that reach the edge scan; an empty list of types means all."""
    e = edges.where(F.col("strength") >= min_strength)
    if "confidence" in edges.columns:
        e = e.where(F.col("confidence") >= min_confidence)
    return e.where(F.col("type").isin(*types)) if types else e


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """node, neighbour; nodes has one column node."""
    out, back = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")), edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    all_ = {"out": out, "in": back}.get(direction, out.unionByName(back))
    return all_.join(nodes.select("node").distinct(), "node", "left_semi").distinct()


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int, reverse: bool = False, cut: bool = False) -> DataFrame:
    """node, depth: smallest number of hops from any start (column node), up to ``max_depth``."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    e = materialize(e, "bfs-edges") if cut else e  # else every hop computes the edges again
    seen = starts.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, max_depth + 1):
        step = frontier.select("node").join(e, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        frontier = materialize(step, "bfs") if cut else step
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, starts: DataFrame, max_depth: int, per_node: int | None = None) -> DataFrame:
    """Simple paths from the starts: path (array), types, strengths, depth. ``per_node`` keeps the strongest edges of a node."""
    e = edges.select("src", "dst", "type", "strength")
    if per_node:
        e = e.withColumn("n_", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("strength"), "dst"))).where(F.col("n_") <= per_node).drop("n_")
    now = starts.select(F.array("node").alias("path"), F.array().cast("array<string>").alias("types"), F.array().cast("array<double>").alias("strengths"), F.col("node").alias("end"))
    out = None
    for d in range(1, max_depth + 1):
        now = now.join(e, now["end"] == e["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("type")).alias("types"), F.concat("strengths", F.array("strength")).alias("strengths"), F.col("dst").alias("end"))
        layer = now.withColumn("depth", F.lit(d))
        out = layer if out is None else out.unionByName(layer)
    return out.drop("end")


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """Simple cycles up to a length, once each (rotated to start at the smallest node): cycle (array), length."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    now = e.select(F.array("src").alias("path"), F.col("dst").alias("end")).where("src < dst")
    out = None
    for d in range(2, max_length + 1):
        step = now.join(e, now["end"] == e["src"]).select(F.concat("path", F.array("end")).alias("path"), F.col("dst").alias("end"))
        closed = step.where(F.col("end") == F.col("path")[0]).select(F.col("path").alias("cycle"), F.lit(d).alias("length"))
        out = closed if out is None else out.unionByName(closed)
        now = step.where((F.col("end") > F.col("path")[0]) & ~F.array_contains("path", F.col("end")))
    return out


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def prune(edges: DataFrame, per_node: int, by: str = "strength") -> DataFrame:
    """The best ``per_node`` outgoing edges of every node; by strength, weighted (x confidence) or frequency."""
    score = {"strength": F.col("strength"), "weighted": F.col("strength") * F.col("confidence"), "frequency": F.col("frequency")}[by]
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(score.desc(), "dst"))).where(F.col("rank") <= per_node)


def co_changes(changes: DataFrame, last: int = 10) -> DataFrame:
    """(file, other, shared): files that share commits, over the last ``last`` commits of each. changes: file, commit, ts."""
    w = Window.partitionBy("file").orderBy(F.desc("ts"), F.desc("commit"))
    recent = changes.select("file", "commit", "ts").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= last).select("file", "commit")
    other = changes.select(F.col("file").alias("other"), "commit").distinct()
    return recent.join(other, "commit").where("file <> other").groupBy("file", "other").agg(F.countDistinct("commit").alias("shared"))


def symbols_to_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Range join: symbol in the innermost chunk of its file that covers its first line."""
    j = symbols.alias("s").join(chunks.alias("c"), (F.col("s.file_path") == F.col("c.file_path")) & (F.col("s.start_line") >= F.col("c.start_line")) & (F.col("s.start_line") <= F.col("c.end_line")))
    return j.groupBy(F.col("s.id").alias("id")).agg(F.min_by(F.col("c.chunk_id"), F.struct(F.col("c.end_line") - F.col("c.start_line"), F.col("c.chunk_id"))).alias("chunk_id"))


def normal_path(path: Column) -> Column:
    """A path without . and .. segments; .. at the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(kept, "/")


def resolve_imports(imports: DataFrame, manifest: DataFrame, extensions=(".ts", ".tsx", ".js", ".jsx", ".py")) -> DataFrame:
    """(importer, module, resolved): the first existing candidate path; external modules go to node_modules/<first segment>."""
    folder = F.regexp_extract("importer", "^(.*/)?[^/]*$", 1)
    base = F.when(F.col("module").startswith("."), normal_path(F.concat(folder, "module"))).otherwise(F.col("module"))
    tails = ["", *extensions, *(f"/index{x}" for x in extensions)]
    candidates = imports.select("importer", "module", F.posexplode(F.array(*(F.concat(base, F.lit(t)) for t in tails))).alias("pos", "path"))
    found = candidates.join(manifest.select("path"), "path").groupBy("importer", "module").agg(F.min_by("path", "pos").alias("resolved"))
    external = F.concat(F.lit("node_modules/"), F.split("module", "/")[0])
    own = imports.select("importer", "module").distinct().join(found, ["importer", "module"], "left")
    return own.select("importer", "module", F.coalesce("resolved", F.when(~F.col("module").startswith("."), external)).alias("resolved"))
