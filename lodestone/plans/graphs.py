"""Graph queries: order lines as co-changes, suppliers and parts as a bipartite graph, event flows as edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.scores import path_strength, path_type
from lodestone.operators import graph
from lodestone.plans.registry import query
from lodestone.session import load

#: Suppliers (s1, s2, ...) supply parts (p1, ...); strength by quantity.
_EDGES = "SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE WHEN max(l_quantity) > 40 THEN 'calls' ELSE 'imports' END AS type, round(avg(l_quantity) / 50, 6) AS strength, count(*) AS frequency FROM lineitem GROUP BY l_suppkey, l_partkey"


def _edges(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"), F.avg("l_quantity").alias("a"), F.count("*").alias("frequency"))
    return g.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.when(F.col("q") > 40, "calls").otherwise("imports").alias("type"), F.round(F.col("a") / 50, 6).alias("strength"), "frequency")


#: A user's consecutive event types are flow edges, weighted by how often they occur.
_FLOW = "SELECT src, dst, 'data_flow' AS type, n, round(n * 1.0 / sum(n) OVER (PARTITION BY src), 6)::DOUBLE AS strength FROM (SELECT event_type AS src, nxt AS dst, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> event_type GROUP BY ALL)"


def _flow(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null and dst <> src")
    n = e.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.select("src", "dst", F.lit("data_flow").alias("type"), "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 6).alias("strength"))


@query(f"WITH e AS ({_EDGES}), seeds AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_nationkey = 3) SELECT DISTINCT e.dst AS node FROM e JOIN seeds ON e.src = seeds.node WHERE e.type = 'calls' AND e.strength >= 0.5")
def expand_one_hop(spark, sf_dir):
    """FILT-7 and one hop of GRAPH-12 (the joins JOIN-1, 2 and 4 are in code_expansion)."""
    seeds = load(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"))
    e = graph.traversable(_edges(spark, sf_dir), ("calls",), 0.5)
    return e.join(seeds, "src", "left_semi").select(F.col("dst").alias("node")).distinct()


@query(f"WITH e AS ({_EDGES}), b AS (SELECT src AS node, dst AS neighbour FROM e UNION ALL SELECT dst, src FROM e) SELECT DISTINCT node, neighbour FROM b WHERE node IN ('s1', 's2', 'p1', 'p2')")
def neighbors(spark, sf_dir):
    """GRAPH-8, SET-3."""
    nodes = spark.createDataFrame([("s1",), ("s2",), ("p1",), ("p2",)], "node string")
    return graph.neighbours(_edges(spark, sf_dir), nodes)


@query(f"WITH e AS ({_EDGES}), d AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node) SELECT substr(node, 1, 1) AS kind, count(*) AS nodes, CAST(sum(o) AS BIGINT) AS out_edges, CAST(sum(i) AS BIGINT) AS in_edges, round(avg(o + i), 6) AS mean_degree, CAST(max(o + i) AS BIGINT) AS max_degree FROM d GROUP BY 1")
def degree_stats(spark, sf_dir):
    """AGG-9, AGG-11."""
    d = graph.degrees(_edges(spark, sf_dir))
    both = F.col("out_degree") + F.col("in_degree")
    return d.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("out_edges"), F.sum("in_degree").alias("in_edges"), F.round(F.avg(both), 6).alias("mean_degree"), F.max(both).alias("max_degree"))


_BOTH = f"b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM ({_EDGES}) WHERE strength >= 0.8 UNION ALL SELECT dst, src FROM ({_EDGES}) WHERE strength >= 0.8))"
_BFS = f"WITH {_BOTH}, d0 AS (SELECT 's1' AS node, 0 AS depth), d1 AS (SELECT DISTINCT b.dst AS node, 1 AS depth FROM b WHERE b.src = 's1' AND b.dst <> 's1'), d2 AS (SELECT DISTINCT b.dst AS node, 2 AS depth FROM d1 JOIN b ON b.src = d1.node WHERE b.dst NOT IN (SELECT node FROM d0 UNION ALL SELECT node FROM d1)) SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2"


@query(_BFS)
def bfs_depth2(spark, sf_dir):
    """GRAPH-3: nodes within two hops of a supplier, both directions."""
    e = _edges(spark, sf_dir).where("strength >= 0.8").select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.bfs(both, spark.createDataFrame([("s1",)], "node string"), 2, cut=True)


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM ({_FLOW}) WHERE strength >= 0.15), d0 AS (SELECT 'purchase' AS node, 0 AS depth), d1 AS (SELECT DISTINCT src AS node, 1 AS depth FROM e WHERE dst = 'purchase' AND src <> 'purchase'), d2 AS (SELECT DISTINCT e.src AS node, 2 AS depth FROM d1 JOIN e ON e.dst = d1.node WHERE e.src NOT IN (SELECT node FROM d0 UNION ALL SELECT node FROM d1)) SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2")
def callers_depth2(spark, sf_dir):
    """GRAPH-4: what leads to a purchase, on reversed edges."""
    return graph.bfs(_flow(spark, sf_dir).where("strength >= 0.15"), spark.createDataFrame([("purchase",)], "node string"), 2, reverse=True, cut=True)


_PATHS = f"WITH RECURSIVE e AS ({_FLOW}), w(path, strengths, node, depth) AS (SELECT [src, dst], [strength], dst, 1 FROM e WHERE src = 'signup' UNION ALL SELECT list_append(w.path, e.dst), list_append(w.strengths, e.strength), e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, e.dst))"


@query(f"{_PATHS} SELECT array_to_string(path, ' -> ') AS path, depth FROM w")
def simple_paths(spark, sf_dir):
    """GRAPH-1, GRAPH-2, SCALAR-33: simple paths of up to three edges."""
    p = graph.paths(_flow(spark, sf_dir), spark.createDataFrame([("signup",)], "node string"), 3)
    return p.select(F.array_join("path", " -> ").alias("path"), "depth")


@query(f"{_PATHS} SELECT path, depth, path_type, score FROM (SELECT array_to_string(path, ' -> ') AS path, depth, 'data_flow_chain' AS path_type, round(CASE depth WHEN 1 THEN strengths[1] WHEN 2 THEN (strengths[1] + strengths[2]) / 2 ELSE (strengths[1] + (strengths[2] + strengths[3]) / 2) / 2 END, 6) AS score FROM w) ORDER BY score DESC, path LIMIT 20")
def path_scores_topk(spark, sf_dir):
    """MATH-6, SORT-7, SCALAR-32, AGG-6: the strongest paths by the folded mean."""
    p = graph.paths(_flow(spark, sf_dir), spark.createDataFrame([("signup",)], "node string"), 3)
    s = p.select(F.array_join("path", " -> ").alias("path"), "depth", path_type(F.col("types")).alias("path_type"), F.round(path_strength(F.col("strengths")), 6).alias("score"))
    return s.orderBy(F.desc("score"), "path").limit(20)


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_FLOW})), w(path, node) AS (SELECT [src], dst FROM e WHERE src < dst UNION ALL SELECT list_append(w.path, w.node), e.dst FROM w JOIN e ON e.src = w.node WHERE w.node > w.path[1] AND NOT list_contains(w.path, w.node) AND len(w.path) < 4) SELECT array_to_string(path, ' -> ') AS cycle, CAST(len(path) AS INTEGER) AS length FROM w WHERE node = path[1] AND len(path) >= 2")
def cycles(spark, sf_dir):
    """GRAPH-6: cycles of up to four nodes, once each."""
    return graph.cycles(_flow(spark, sf_dir), 4).select(F.array_join("cycle", " -> ").alias("cycle"), "length")


@query(f"{_PATHS} SELECT CAST(max(depth) AS INTEGER) AS longest, count(*) AS paths FROM w")
def longest_depth(spark, sf_dir):
    """GRAPH-7 for paths of up to three edges."""
    return graph.paths(_flow(spark, sf_dir), spark.createDataFrame([("signup",)], "node string"), 3).agg(F.max("depth").alias("longest"), F.count("*").alias("paths"))


@query(f"SELECT src, dst, strength, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS rank FROM ({_EDGES})) WHERE rank <= 3")
def edge_prune_topn(spark, sf_dir):
    """SORT-6."""
    return graph.prune(_edges(spark, sf_dir), 3).select("src", "dst", "strength", "rank")


@query(f"WITH e AS ({_EDGES}) SELECT type, count(*) AS edges, CAST(sum(frequency) AS BIGINT) AS uses, round(avg(strength), 6) AS mean_strength, count(DISTINCT src) AS sources FROM e GROUP BY type")
def edge_statistics(spark, sf_dir):
    """AGG-6, AGG-10, GRAPH-13: edges by type."""
    return _edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("edges"), F.sum("frequency").alias("uses"), F.round(F.avg("strength"), 6).alias("mean_strength"), F.countDistinct("src").alias("sources"))


@query("WITH l AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag) SELECT sha256(a || '|' || b || '|' || type || '|' || n) AS relation, count(*) AS copies FROM l GROUP BY 1 HAVING count(*) > 1")
def duplicate_relationships(spark, sf_dir):
    """AGG-15, IDX-13: edges with both endpoints, type and metadata equal (targets are groups of parts, so that there are some)."""
    n = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    key = F.sha2(F.concat_ws("|", "l_suppkey", F.col("l_partkey") % 50, "l_returnflag", "n"), 256)
    return n.groupBy(key.alias("relation")).agg(F.count("*").alias("copies")).where("copies > 1")


@query("WITH c AS (SELECT l_partkey AS file, l_orderkey AS commit, l_shipdate AS ts FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, commit DESC) AS n FROM (SELECT DISTINCT file, commit, ts FROM c)) SELECT r.file, o.file AS other, count(DISTINCT r.commit) AS shared FROM r JOIN (SELECT DISTINCT file, commit FROM c) o ON r.commit = o.commit AND r.file <> o.file WHERE r.n <= 10 GROUP BY r.file, o.file")
def co_change_pairs(spark, sf_dir):
    """JOIN-5, WIN-1 over all parts and orders."""
    return graph.co_changes(load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("commit"), F.col("l_shipdate").alias("ts")))


_TREE_ALL = "t AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


@query(f"WITH RECURSIVE {_TREE_ALL}, w(root, node, depth) AS (SELECT src, dst, 1 FROM t WHERE src LIKE 'r%' UNION ALL SELECT w.root, t.dst, w.depth + 1 FROM w JOIN t ON t.src = w.node WHERE w.depth < 4) SELECT root, depth, count(DISTINCT node) AS nodes FROM w GROUP BY ALL")
def transitive_deps(spark, sf_dir):
    """GRAPH-5 over all customers and orders; one join a level, since Spark's recursion stops at a number of rows."""
    n, c, o = (load(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    edge = lambda t, p, a, q, b: t.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"))
    edges = edge(n, "r", "n_regionkey", "n", "n_nationkey").unionByName(edge(c, "n", "c_nationkey", "c", "c_custkey")).unionByName(edge(o, "c", "o_custkey", "o", "o_orderkey"))
    level = edges.where("src like 'r%'").select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct()
    levels = [level.withColumn("depth", F.lit(1))]
    for depth in range(2, 5):
        level = level.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        levels.append(level.withColumn("depth", F.lit(depth)))
    every = levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3])
    return every.groupBy("root", "depth").agg(F.count("*").alias("nodes"))


@query("SELECT o.o_orderkey, min(c.c_mktsegment) AS span, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 30 DAY JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_orderkey")
def range_join_lines(spark, sf_dir):
    """JOIN-26 (lookup) after an equi join with a residual range, over all orders."""
    l, o, c = (load(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    j = l.join(o, (l["l_orderkey"] == o["o_orderkey"]) & (l["l_shipdate"] >= o["o_orderdate"]) & (l["l_shipdate"] <= o["o_orderdate"] + F.expr("INTERVAL 30 DAYS")))
    return j.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderkey").agg(F.min("c_mktsegment").alias("span"), F.count("*").alias("n"))
