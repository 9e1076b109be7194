"""Modules, their imports and exports, and the chain of what a set of symbols depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scores import dependency_strength
from lodestone.operators import graph
from lodestone.operators.delta import keep_first
from lodestone.operators.selection import prefix_skip, prefix_stop
from lodestone.session import materialize


def exported_symbols(exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exports (module, name) with the line of the first symbol of that name in the module; exports of unknown symbols are dropped."""
    first = symbols.groupBy("module", "name").agg(F.min(F.struct("start_line", "kind")).alias("s"))
    return exports.join(first, ["module", "name"]).select("module", "name", F.col("s.start_line").alias("start_line"), F.col("s.kind").alias("kind"))


def module_edges(resolved: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct (src, dst) between modules of the index; resolved: importer, resolved."""
    inner = modules.select(F.col("module").alias("dst")).distinct()
    return resolved.select(F.col("importer").alias("src"), F.col("resolved").alias("dst")).distinct().join(inner, "dst", "left_semi").select("src", "dst")


def import_usage(imports: DataFrame, sources: DataFrame) -> DataFrame:
    """How often an imported name stands as a whole word outside its own line: module, name, usage, lines.

    imports: module, name, line; sources: module, text. A source is split once; its names are looked up by word, not every name in every line.
    """
    lines = sources.select("module", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = lines.select("module", (F.col("pos") + 1).alias("at"), F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_$]+)"), F.lit(1))).alias("name"))
    hits = words.groupBy("module", "at", "name").agg(F.count("*").alias("n"))
    joined = imports.select("module", "name", F.col("line").alias("own")).distinct().join(hits, ["module", "name"], "left").withColumn("n", F.when(F.col("at") != F.col("own"), F.col("n")))
    return joined.groupBy("module", "name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("usage"), F.count("n").alias("lines"))


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """``depends_on`` edges of resolved imports (importer, resolved, usage, is_default, type_only)."""
    strength = dependency_strength(F.col("usage"), F.col("is_default"), F.col("type_only"))
    known = resolved.where("resolved is not null")
    return known.select(F.col("importer").alias("src"), F.col("resolved").alias("dst"), F.lit("depends_on").alias("type"), strength.alias("strength"), F.lit(0.9).alias("confidence"), F.col("usage").alias("frequency"))


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


#: The classes of a chain, in order: edge types, depth (None: as asked), direction, and whether what does not fit is skipped.
CLASSES = (
    ("critical", ("extends", "implements", "instantiates", "calls"), 1, False, True),
    ("forward", ("calls", "accesses", "assigns", "imports"), None, False, False),
    ("backward", ("calls",), None, True, False),
    ("contextual", ("configures", "depends_on", "data_flow"), 2, False, False),
)


def dependency_chain(edges: DataFrame, seeds: DataFrame, sizes: DataFrame, budget: float, max_depth: int = 3, reserve: float = 0.1) -> DataFrame:
    """What a set of symbols depends on, under a token budget: node, class, depth, tokens.

    Each class takes its nodes nearest first (then by name) from what the budget
    leaves: critical ones skip what does not fit, the others stop there. A node
    counts once, in its first class. sizes: node, tokens; nodes without a size are no symbols of the index.
    """
    starts = seeds.select("node").distinct()
    used = sizes.join(starts, "node", "left_semi").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    left, out, taken = budget - used - budget * reserve, None, starts
    for name, types, depth, reverse, skips in CLASSES:
        if left <= 0:
            break
        reached = graph.bfs(edges.where(F.col("type").isin(*types)), starts, depth or max_depth, reverse, cut=True)
        fresh = reached.where("depth > 0").join(taken, "node", "left_anti").join(sizes, "node").withColumn("all_", F.lit(1))
        order = ["depth", "node"]
        chosen = prefix_skip(fresh, ["all_"], order, "tokens", left) if skips else prefix_stop(fresh, ["all_"], order, "tokens", left)
        rows = materialize(chosen.select("node", F.lit(name).alias("class"), "depth", "tokens"), "chain")
        left -= rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        taken = taken.unionByName(rows.select("node"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return sizes.limit(0).select("node", F.lit("").alias("class"), F.lit(0).alias("depth"), "tokens")
    return keep_first(out, ["node"], ["depth"])
