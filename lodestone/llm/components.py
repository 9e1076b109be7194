"""Connected components over an edge table, without collecting it.

Alternating large-star and small-star steps; every step is a group-by over
the edges and is written to the shared folder, so lineage stays short. A hub
is never gathered: stars use aggregates and joins, no lists of neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize


#: Edges beyond which a hub may be too much for one task: the smallest neighbours are then written first, so that the adaptive skew join can split it.
SPLIT_EDGES = 2_000_000


def _star(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    """Connects every node's neighbours to the smallest node around it (only larger ones, or only smaller ones)."""
    u, v = F.col("u"), F.col("v")
    if large:
        around = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
    else:
        around = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    low = materialize(low, "cc-low") if split else low
    joined = around.join(low, "u")
    if large:
        out = joined.where(v > u).select(v.alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(v.alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with one edge to a node that leads nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    both = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return both.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def _round(edges: DataFrame, label: str) -> DataFrame:
    split = edges.count() > SPLIT_EDGES
    return materialize(_star(_star(edges, True, split), False, split), label)


def one_round(edges: DataFrame) -> DataFrame:
    """(node, component) after one round only: nodes with the same component are connected, connected ones may have several."""
    now = _round(edges.select("u", "v").where("u <> v").distinct(), "cc-once")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return ends.groupBy("node").agg(F.min("component").alias("component"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. Edges: u, v long."""
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "cc-0")
    for k in range(max_rounds):
        now = _round(now, f"cc-{k + 1}")
        if _is_forest(now):
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further edges (u, v); only the components that they touch are worked on."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_"))
    between = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_", "u").alias("u"), F.coalesce("v_", "v").alias("v"))
    roots = materialize(components(between).withColumnRenamed("component", "root"), "cc-roots")
    old = labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return old.unionByName(roots.join(labels.select("node"), "node", "left_anti").select("node", F.col("root").alias("component")))
