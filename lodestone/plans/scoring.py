"""Scores of edges, symbols, paths and chunks over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scores as s
from lodestone.functions.text import words
from lodestone.functions.vector import cosine
from lodestone.operators import graph
from lodestone.plans.graphs import _FLOW, _flow
from lodestone.plans.registry import query
from lodestone.plans.vectors import cos_sql
from lodestone.session import load

KINDS = ("calls", "data_flow", "imports", "throws", "catches", "extends", "implements", "exports", "instantiates", "accesses", "assigns", "configures", "depends_on", "other")
QUESTION = "Trace the error data of part7 calls"

#: Suppliers and parts as typed edges; every kind occurs.
_EDGES_SQL = f"e AS (SELECT 's' || l_suppkey AS src, 'part' || l_partkey AS dst, ({list(KINDS)})[(l_suppkey + l_partkey) % {len(KINDS)} + 1] AS type, avg(l_quantity) / 50 AS strength, 1 - avg(l_discount) AS confidence, count(*) AS frequency, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 20 END AS days, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 13 END AS errors, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 3 - 1 END AS feedback FROM lineitem GROUP BY l_suppkey, l_partkey)"


def _edges(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.count("*").alias("frequency"))
    k = F.col("l_suppkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in KINDS)), ((k + F.col("l_partkey")) % len(KINDS) + 1).cast("int"))
    part = lambda m, value: F.when(k % m > 0, value)
    return g.select(F.concat(F.lit("s"), k.cast("string")).alias("src"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("dst"), kind.alias("type"), (F.col("q") / 50).alias("strength"), (1 - F.col("d")).alias("confidence"), "frequency", part(3, k % 20).alias("days"), part(4, k % 13).alias("errors"), part(5, k % 3 - 1).alias("feedback"))


_EDGE_SCORE = """
least(1.0, greatest(0.0, strength
  * CASE type WHEN 'calls' THEN 1.0 WHEN 'data_flow' THEN 0.9 WHEN 'imports' THEN 0.8 WHEN 'throws' THEN 0.9 WHEN 'catches' THEN 0.9 WHEN 'extends' THEN 0.7 WHEN 'implements' THEN 0.7 WHEN 'exports' THEN 0.6 WHEN 'instantiates' THEN 0.8 WHEN 'accesses' THEN 0.6 WHEN 'assigns' THEN 0.7 WHEN 'configures' THEN 0.5 WHEN 'depends_on' THEN 0.6 ELSE 0.5 END
  * confidence * least(2.0, 1 + 0.3 * log10(frequency)) * (1 + coalesce(exp(-days / 7.0) * 0.3, 0))
  * CASE WHEN coalesce(errors, 0) = 0 THEN 1.0 WHEN type IN ('throws', 'catches') THEN 1 + least(0.5, errors * 0.1) ELSE greatest(0.7, 1 - errors * 0.05) END
  * (1 + coalesce(feedback, 0) * 0.2) * (1 + CASE WHEN type IN ('throws', 'catches') THEN 0.3 WHEN type = 'calls' THEN 0.2 WHEN type = 'data_flow' THEN 0.25 ELSE 0 END)))
"""


@query(f"WITH {_EDGES_SQL} SELECT type, count(*) AS edges, round(avg(score), 6)::DOUBLE AS mean_score, round(max(score), 6)::DOUBLE AS best, round(avg(strength * confidence * (1 + 0.5 * CASE WHEN dst LIKE '%part7%' THEN 1.0 ELSE 0.0 END / 6 + 0.5 * CASE WHEN type = 'calls' THEN 1.0 WHEN type IN ('data_flow', 'other') THEN 1.0 ELSE 0.0 END / 6)), 6)::DOUBLE AS mean_relevance FROM (SELECT *, {_EDGE_SCORE} AS score FROM e) GROUP BY type")
def edge_scores(spark, sf_dir):
    """MATH-4, MATH-5, MATH-6 (edges), MATH-7, MATH-8 (boost) for one question."""
    q, c = F.lit(QUESTION), F.col
    e = _edges(spark, sf_dir)
    score = s.edge_score(c("type"), c("strength"), c("confidence"), c("frequency"), c("days"), c("errors"), c("feedback"), q)
    relevance = s.keyword_relevance(c("strength"), c("confidence"), F.concat_ws(" ", "src", "type", "dst"), q)
    out = e.select("type", score.alias("score"), relevance.alias("relevance"))
    return out.groupBy("type").agg(F.count("*").alias("edges"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("relevance"), 6).alias("mean_relevance"))


@query(f"WITH {_EDGES_SQL} SELECT src, dst, type, score FROM (SELECT src, dst, type, round({_EDGE_SCORE}, 6)::DOUBLE AS score FROM e) ORDER BY score DESC, src, dst LIMIT 10")
def top_edges(spark, sf_dir):
    """SORT-7: the ten best edges for a question."""
    c = F.col
    score = s.edge_score(c("type"), c("strength"), c("confidence"), c("frequency"), c("days"), c("errors"), c("feedback"), F.lit(QUESTION))
    return _edges(spark, sf_dir).select("src", "dst", "type", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "src", "dst").limit(10)


_SYMBOLS_SQL = "y AS (SELECT p_partkey, (['function', 'method', 'class', 'variable', 'property', 'module', 'macro'])[p_partkey % 7 + 1] AS kind, (['local', 'class', 'module', 'global', 'none'])[p_partkey % 5 + 1] AS scope, CASE p_partkey % 4 WHEN 0 THEN 'handle' WHEN 1 THEN 'myError' ELSE 'plain' END || p_partkey AS name, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 30 END AS days, CASE WHEN p_partkey % 2 > 0 THEN p_partkey % 9 END AS errors, p_partkey % 11 = 0 AS focused, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 3 - 1 END AS feedback FROM part)"


@query(f"WITH {_SYMBOLS_SQL} SELECT p_partkey, round(least(1.0, greatest(0.0, 0.5 + CASE kind WHEN 'function' THEN 0.3 WHEN 'method' THEN 0.3 WHEN 'class' THEN 0.2 WHEN 'module' THEN 0.2 ELSE 0.1 END + CASE scope WHEN 'local' THEN 0.1 WHEN 'class' THEN 0.08 WHEN 'module' THEN 0.05 WHEN 'global' THEN 0.02 ELSE 0.05 END + coalesce(exp(-days / 7.0) * 0.3, 0) + CASE WHEN errors > 0 AND (name LIKE 'handle%' OR name LIKE 'myError%') THEN least(0.3, errors * 0.05) ELSE 0 END + CASE WHEN focused THEN 0.2 ELSE 0 END + coalesce(feedback, 0) * 0.3)), 6)::DOUBLE AS score FROM y")
def symbol_scores(spark, sf_dir):
    """MATH-6 (symbols)."""
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), (k % len(values) + 1).cast("int"))
    part = lambda m, value: F.when(k % m > 0, value)
    name = F.concat(F.when(k % 4 == 0, "handle").when(k % 4 == 1, "myError").otherwise("plain"), k.cast("string"))
    score = s.symbol_score(pick(("function", "method", "class", "variable", "property", "module", "macro")), pick(("local", "class", "module", "global", "none")), name, part(3, k % 30), part(2, k % 9), k % 11 == 0, part(6, k % 3 - 1))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


_PATHS_SQL = f"RECURSIVE e AS ({_FLOW}), w(path, strengths, node, depth) AS (SELECT [src, dst], [strength], dst, 1 FROM e WHERE src = 'signup' UNION ALL SELECT list_append(w.path, e.dst), list_append(w.strengths, e.strength), e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, e.dst)), f AS (SELECT *, CASE depth WHEN 1 THEN strengths[1] WHEN 2 THEN (strengths[1] + strengths[2]) / 2 ELSE (strengths[1] + (strengths[2] + strengths[3]) / 2) / 2 END AS total, (CASE WHEN list_contains(path, 'purchase') THEN 1 ELSE 0 END + CASE WHEN list_contains(path, 'error') THEN 1 ELSE 0 END) / 3.0 AS share FROM w), g AS (SELECT *, least(1.0, total * 0.95 * pow(0.8, depth - 1) * 1.3 * (1 + least(0.5, share * 0.3) * 0.3)) AS score FROM f)"


@query(f"WITH {_PATHS_SQL} SELECT array_to_string(path, ' > ') AS path, CASE WHEN depth = 1 THEN path[1] || ' flows to ' || path[2] ELSE 'Data flows: ' || array_to_string(path, ' → ') END AS description, round(score, 6)::DOUBLE AS score, round(CASE WHEN depth >= 2 THEN score * total / sqrt(depth) * 1.3 * 1.2 ELSE score END, 6)::DOUBLE AS multi_hop FROM g")
def path_scores(spark, sf_dir):
    """MATH-6 (paths, several hops), MATH-8 (relevance), SCALAR-32, SCALAR-33 for the question 'error data purchase'."""
    q, c = F.lit("error data purchase"), F.col
    p = graph.paths(_flow(spark, sf_dir), spark.createDataFrame([("signup",)], "node string"), 3)
    p = p.withColumn("kind", s.path_type(c("types"))).withColumn("total", s.path_strength(c("strengths"))).withColumn("description", s.path_description(c("path"), c("types")))
    score = s.path_score(c("kind"), c("total"), c("depth"), c("description"), F.array_join("path", " "), q)
    p = p.withColumn("score", score)
    return p.select(F.array_join("path", " > ").alias("path"), "description", F.round("score", 6).alias("score"), F.round(s.multi_hop_score(c("score"), c("kind"), c("total"), c("depth"), F.lit(True)), 6).alias("multi_hop"))


@query(f"WITH {_PATHS_SQL}, {_EDGES_SQL.replace('e AS', 'x AS')}, {_SYMBOLS_SQL} SELECT round(0.3 * (SELECT avg(p_size / 50.0) FROM part) + 0.4 * (SELECT avg({_EDGE_SCORE}) FROM x) + 0.3 * (SELECT avg(score) FROM g), 5)::DOUBLE AS relevance")
def overall_relevance(spark, sf_dir):
    """AGG-31: symbols (parts by size), edges and paths."""
    c = F.col
    one = load(spark, sf_dir, "part").agg(F.avg(c("p_size") / 50).alias("symbols"))
    edges = _edges(spark, sf_dir).agg(F.avg(s.edge_score(c("type"), c("strength"), c("confidence"), c("frequency"), c("days"), c("errors"), c("feedback"), F.lit(QUESTION))).alias("edges"))
    p = graph.paths(_flow(spark, sf_dir), spark.createDataFrame([("signup",)], "node string"), 3)
    score = s.path_score(s.path_type(c("types")), s.path_strength(c("strengths")), c("depth"), s.path_description(c("path"), c("types")), F.array_join("path", " "), F.lit("error data purchase"))
    return one.join(edges).join(p.agg(F.avg(score).alias("paths"))).select(F.round(s.overall_relevance(c("symbols"), c("edges"), c("paths")), 5).alias("relevance"))


@query(f"WITH d AS (SELECT doc_id, source, doc_id % 5 AS kind, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS t, embedding FROM documents JOIN embeddings ON vec_id = doc_id), j AS (SELECT a.doc_id, {cos_sql('a.embedding', 'b.embedding')} AS cosine, CASE WHEN a.source = b.source THEN 0.8 WHEN a.kind = b.kind THEN 0.6 ELSE coalesce(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0) END AS overlap FROM d a JOIN d b ON b.doc_id = a.doc_id + 5 + a.doc_id % 3 * 15) SELECT doc_id, round(overlap, 6)::DOUBLE AS overlap, round(0.7 * cosine + 0.3 * overlap, 6)::DOUBLE AS similarity FROM j")
def semantic_pairs(spark, sf_dir):
    """MATH-2 with its shortcuts, MATH-3: every document with one other."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("doc_id"))
    d = d.select("doc_id", "source", (F.col("doc_id") % 5).alias("kind"), F.array_distinct(words(F.col("text"))).alias("t"), "embedding")
    a = d.select("doc_id", *(F.col(c).alias(f"a_{c}") for c in ("source", "kind", "t", "embedding")), (F.col("doc_id") + 5 + F.col("doc_id") % 3 * 15).alias("other"))
    j = a.join(d.withColumnRenamed("doc_id", "other"), "other")
    overlap = s.chunk_overlap(F.col("a_source") == F.col("source"), F.col("a_kind") == F.col("kind"), F.col("a_t"), F.col("t"))
    j = j.select("doc_id", overlap.alias("overlap"), cosine("a_embedding", "embedding").alias("cosine"))
    return j.select("doc_id", F.round("overlap", 6).alias("overlap"), F.round(s.semantic_similarity(F.col("cosine"), F.col("overlap")), 6).alias("similarity"))


_VALUES = [("assignment", 0.9), ("parameter_passing", 0.8), ("return_value", 0.8), ("property_access", 0.7), ("array_access", 0.7), ("destructuring", 0.8), ("spread", 0.6), ("closure_capture", 0.7), ("callback_parameter", 0.6), ("promise_resolution", 0.5), ("conditional_flow", 0.4), ("other", 0.5)]


@query(f"SELECT flow, count(*) AS edges, round(avg(strength), 6) AS strength, round(avg(least(1.0, 0.7 + CASE WHEN l_linenumber % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN l_linenumber % 3 = 0 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS call_strength, round(avg(greatest(0.1, least(1.0, 0.5 + CASE WHEN l_quantity > 10 THEN 0.3 WHEN l_quantity > 5 THEN 0.2 WHEN l_quantity > 1 THEN 0.1 ELSE 0 END + CASE WHEN l_linenumber = 1 THEN 0.1 ELSE 0 END - CASE WHEN l_linenumber = 2 THEN 0.2 ELSE 0 END))), 6)::DOUBLE AS dependency_strength FROM (SELECT v.flow, v.strength, l.* FROM lineitem l JOIN (VALUES {', '.join(str((*x, i)) for i, x in enumerate(_VALUES))}) v(flow, strength, i) ON l.l_partkey % 12 = v.i) GROUP BY flow")
def flow_strengths(spark, sf_dir):
    """MATH-9, MATH-10, MATH-11 over order lines."""
    c = F.col
    kind = F.element_at(F.array(*(F.lit(k) for k, _ in _VALUES)), (c("l_partkey") % 12 + 1).cast("int"))
    rows = load(spark, sf_dir, "lineitem").select(kind.alias("flow"), s.call_strength(c("l_linenumber") % 2 == 0, c("l_linenumber") % 3 == 0).alias("call"), s.dependency_strength(c("l_quantity"), c("l_linenumber") == 1, c("l_linenumber") == 2).alias("need"))
    rows = rows.withColumn("strength", s.flow_strength(c("flow")))
    return rows.groupBy("flow").agg(F.count("*").alias("edges"), F.round(F.avg("strength"), 6).alias("strength"), F.round(F.avg("call"), 6).alias("call_strength"), F.round(F.avg("need"), 6).alias("dependency_strength"))


#: Chunks are parts; paths lead through them from suppliers; groups are manufacturers.
_RANK_SQL = "p AS (SELECT DISTINCT l_suppkey AS path, l_partkey AS part FROM lineitem), q AS (SELECT l_suppkey AS path, avg(l_quantity) / 50 AS strength FROM lineitem GROUP BY 1), b AS (SELECT part, avg(strength) AS boost FROM p JOIN q USING (path) GROUP BY part), g AS (SELECT p_brand, avg(p_size) / 50 AS importance FROM part GROUP BY 1)"


@query(f"WITH {_RANK_SQL} SELECT p_partkey, round(p_retailprice / 2500 + 0.3 * coalesce(boost, 0) + 0.2 * coalesce(importance, 0), 6) AS score FROM part LEFT JOIN b ON part = p_partkey LEFT JOIN g ON g.p_brand = part_.p_brand ORDER BY score DESC, p_partkey LIMIT 20".replace("FROM part LEFT", "FROM part part_ LEFT"))
def enhanced_rank(spark, sf_dir):
    """JOIN-7, JOIN-8, SORT-3, SORT-4: similarity + .3 x strength of a chunk's paths + .2 x importance of its groups."""
    l, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    strength = l.groupBy(F.col("l_suppkey").alias("path")).agg((F.avg("l_quantity") / 50).alias("strength"))
    members = l.select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("p_partkey")).distinct()
    boost = members.join(strength, "path").groupBy("p_partkey").agg(F.avg("strength").alias("boost"))
    groups = p.groupBy("p_brand").agg((F.avg("p_size") / 50).alias("importance"))
    ranked = p.join(boost, "p_partkey", "left").join(groups, "p_brand", "left")
    score = F.col("p_retailprice") / 2500 + F.coalesce("boost", F.lit(0.0)) * 0.3 + F.coalesce("importance", F.lit(0.0)) * 0.2
    return ranked.select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@query("WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, avg(l_quantity) / 50 AS strength FROM lineitem GROUP BY 1, 2), k AS (SELECT l_orderkey AS path, l_linenumber AS at, l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT path, round(avg(strength), 6) AS strength, count(*) AS edges FROM k JOIN e USING (src, dst) GROUP BY path HAVING count(*) >= 6")
def chain_strength(spark, sf_dir):
    """AGG-32, JOIN-21: mean strength of the edges along a path (an order's lines), each found by its two ends."""
    l = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_quantity")
    e = l.groupBy("src", "dst").agg((F.avg("l_quantity") / 50).alias("strength"))
    return l.select("path", "src", "dst").join(e, ["src", "dst"]).groupBy("path").agg(F.round(F.avg("strength"), 6).alias("strength"), F.count("*").alias("edges")).where("edges >= 6")


@query("WITH p AS (SELECT l_returnflag || l_linestatus AS kind, l_suppkey AS symbol, l_orderkey AS edge, l_quantity / 50 AS strength, l_linenumber AS depth FROM lineitem), g AS (SELECT kind, count(DISTINCT symbol) AS symbols, count(DISTINCT edge) AS edges, avg(strength / greatest(depth, 1)) AS importance FROM p GROUP BY 1), t AS (SELECT kind, sum((symbol % 9 + 1) * 15 + 2 * 5 * 15) AS tokens FROM (SELECT DISTINCT kind, symbol FROM p) GROUP BY 1) SELECT kind, CASE kind WHEN 'AF' THEN 'Function Calls' WHEN 'NO' THEN 'Data Flow' ELSE 'Related Code' END AS theme, symbols, edges, round(importance, 6) AS importance, CAST(tokens AS BIGINT) AS tokens, round((SELECT avg(strength) FROM p) / greatest((SELECT sum(tokens) FROM t) / 1000, 1), 6)::DOUBLE AS efficiency, CAST(row_number() OVER (ORDER BY importance DESC, kind) AS INTEGER) AS place FROM g JOIN t USING (kind)")
def path_groups(spark, sf_dir):
    """AGG-7, AGG-8, SCALAR-16, SCALAR-34, SORT-5: groups by kind of path with symbols, edges, importance, tokens, and the efficiency of all."""
    c = F.col
    p = load(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), c("l_suppkey").alias("symbol"), c("l_orderkey").alias("edge"), (c("l_quantity") / 50).alias("strength"), c("l_linenumber").alias("depth"))
    g = p.groupBy("kind").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("edge").alias("edges"), F.avg(c("strength") / F.greatest("depth", F.lit(1))).alias("importance"))
    t = p.select("kind", "symbol").distinct().groupBy("kind").agg(F.sum((c("symbol") % 9 + 1) * 15 + 2 * 5 * 15).alias("tokens"))
    whole = p.agg(F.avg("strength").alias("mean")).join(t.agg(F.sum("tokens").alias("all")))
    efficiency = F.least(F.lit(1.0), c("mean") / F.greatest(c("all") / 1000, F.lit(1.0)))
    name = s.theme(F.when(c("kind") == "AF", "call_chain").when(c("kind") == "NO", "data_flow_chain").otherwise("mixed"))
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "kind"))  # one row a kind of path
    out = g.join(t, "kind").join(F.broadcast(whole)).withColumn("place", rank)
    return out.select("kind", name.alias("theme"), "symbols", "edges", F.round("importance", 6).alias("importance"), "tokens", F.round(efficiency, 6).alias("efficiency"), "place")
