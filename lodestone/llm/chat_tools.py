"""Tool calls in conversations: linked, ordered, validated, canonical.

Calls come from two places. A message whose text is a JSON object with
``tool_calls`` holds explicit calls (id, name, arguments, depends_on), and one
with ``tool_call_id`` is a result. In plain conversations a user turn is a call
of the tool ``reply`` with identifier ``conv_id:turn``, and the assistant turn
right after it is its result.

Calls and results meet in a hash join on conversation and identifier, so an
identifier may recur in other conversations. Calls of a conversation are put
in topological order: by level over their explicit dependencies (the longest
chain below a call), then by turn and position. Chains of calls with one
dependency each are shortened by pointer doubling, so rounds grow with the
logarithm of their length; what is left is peeled off round by round until
nothing is freed, and what then remains lies on or behind a cycle. Arguments
are checked against the tool schemas and calls are serialised as JSON with
sorted keys and no white space.

Only DataFrame operations are used. Order numbers are counted per segment of
1024 turns and then added up, so no conversation meets in one task whole.

Defined results: equal rows count once; of several results of one identifier
the earliest turn, then the smaller text is the call's, the others are rows of
their own (``surplus_result``); calls of one conversation with the same
identifier all get its result and its deepest level; a null conv_id, or a null
turn of a plain call, gives a call without identifier (``no_identifier``,
never linked); a null text is an empty argument; a role that is null is
ignored; results without a call are ``orphan_result``; a dependency that is no
call of the conversation is ignored; ties of the order go by position,
identifier, canonical text; texts of any length are taken whole; only the
columns conv_id, turn, role and text are read, so others may have any name; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import load, materialize

SEGMENT = 1024


@dataclass(frozen=True)
class Tool:
    """A tool's parameters: name -> (type as in JSON Schema, required)."""

    name: str
    params: tuple[tuple[str, str, bool], ...]


TOOLS = (Tool("reply", (("text", "string", True), ("turn", "integer", True))),)
_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>, tool_call_id string, content string"


def _type_of(v: Column) -> Column:
    """JSON Schema type of a variant."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("null")


def argument_errors(name: Column, arguments: Column, tools: tuple[Tool, ...] = TOOLS) -> Column:
    """Sorted error texts of a call; ``arguments`` is JSON text."""
    parsed = F.try_parse_json(arguments)
    entries = F.try_variant_get(parsed, "$", "map<string,variant>")
    out = F.when(entries.isNull(), F.array(F.lit("arguments: not an object")))
    for tool in tools:
        checks = []
        for param, kind, required in tool.params:
            value = F.try_element_at(entries, F.lit(param))
            found = _type_of(value)
            fits = (found == kind) | ((found == "integer") if kind == "number" else F.lit(False))
            checks.append(F.when(value.isNull(), F.lit(f"{param}: missing") if required else F.lit(None)).when(~fits, F.lit(f"{param}: not {kind}")))
        unknown = F.transform(F.array_except(F.map_keys(entries), F.array(*(F.lit(p) for p, _, _ in tool.params))), lambda k: F.concat(k, F.lit(": unknown")))
        out = out.when(name == tool.name, F.array_sort(F.concat(F.array_compact(F.array(*checks)), unknown)))
    return out.otherwise(F.array(F.lit("name: unknown tool")))


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, position, call_id, name, arguments, depends_on) and results (call_id, conv_id, turn, content)."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    j = m.withColumn("j", F.when(F.col("text").startswith("{"), F.from_json("text", _CALLS)))
    explicit = (F.size("j.tool_calls") > 0) | F.col("j.tool_call_id").isNotNull()
    plain = j.where(~F.coalesce(explicit, F.lit(False)))
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    calls = plain.where(F.col("role") == "user").select("conv_id", "turn", F.lit(0).alias("position"), ident(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"}).alias("arguments"), F.array().cast("array<string>").alias("depends_on"))
    results = plain.where(F.col("role") == "assistant").select(ident(F.col("turn") - 1).alias("call_id"), "conv_id", "turn", F.col("text").alias("content"))
    told = j.where(F.size("j.tool_calls") > 0).select("conv_id", "turn", F.posexplode("j.tool_calls").alias("position", "c")).select("conv_id", "turn", "position", F.col("c.id").alias("call_id"), "c.name", F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    answers = j.where(F.col("j.tool_call_id").isNotNull()).select(F.col("j.tool_call_id").alias("call_id"), "conv_id", "turn", F.coalesce("j.content", F.lit("")).alias("content"))
    return calls.unionByName(told), results.unionByName(answers)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call that depends on another call of its conversation; level null on or behind a cycle.

    Rows of ``calls``: conv_id, call_id, depends_on.
    """
    node = ["conv_id", "call_id"]
    edges = calls.where("conv_id is not null and call_id is not null").select(*node, F.explode("depends_on").alias("needs")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("needs")).distinct()
    edges = materialize(edges.join(known, ["conv_id", "needs"], "left_semi"), "chat-edges")
    degree = materialize(edges.groupBy(*node).agg(F.count("*").alias("n"), F.min("needs").alias("needs")), "chat-degrees")
    # chains: (call, target, length), doubled until every target has no or several dependencies
    jump = degree.where("n = 1").select(*node, F.col("needs").alias("target"), F.lit(1).cast("long").alias("length"))
    size, reach = jump.count(), 1
    while reach <= size:
        onward = jump.select("conv_id", F.col("call_id").alias("target"), F.col("target").alias("beyond"), F.col("length").alias("more"))
        joined = jump.join(onward, ["conv_id", "target"], "left")
        moved = F.col("beyond").isNotNull()
        joined = joined.select(*node, F.coalesce("beyond", "target").alias("target"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), moved.alias("moved"))
        jump, reach = materialize(joined, "chat-chains"), reach * 2
        if jump.where("moved").isEmpty():
            break
        jump = jump.drop("moved")
    jump = jump.select(*node, "target", "length")
    # the rest: calls with several dependencies, each led to the end of its chain
    led = jump.select("conv_id", F.col("call_id").alias("needs"), "target", "length")
    left = edges.join(degree.where("n > 1").select(*node), node, "left_semi").join(led, ["conv_id", "needs"], "left")
    left = materialize(left.select(*node, F.coalesce("target", "needs").alias("target"), (F.coalesce("length", F.lit(0)) + 1).alias("length")), "chat-branches")
    done = edges.select("conv_id", F.col("needs").alias("call_id")).distinct().join(degree, node, "left_anti").withColumn("level", F.lit(0).cast("long"))
    done = new = materialize(done, "chat-roots")
    left = left.withColumn("below", F.lit(None).cast("long"))
    while not new.isEmpty() and not left.isEmpty():
        found = new.select("conv_id", F.col("call_id").alias("target"), F.col("level").alias("found"))
        left = left.join(found, ["conv_id", "target"], "left").select(*node, "target", "length", F.coalesce("below", F.col("found") + F.col("length")).alias("below"))
        left = materialize(left, "chat-left")
        new = materialize(left.groupBy(*node).agg(F.count_if(F.col("below").isNull()).alias("open"), F.max("below").alias("level")).where("open = 0").select(*node, "level"), "chat-freed")
        done, left = done.unionByName(new), left.join(new, node, "left_anti")
    ends = done.select("conv_id", F.col("call_id").alias("target"), F.col("level").alias("under"))
    chained = jump.join(ends, ["conv_id", "target"], "left").select(*node, (F.col("under") + F.col("length")).alias("level"))
    branching = degree.where("n > 1").select(*node).join(done, node, "left").select(*node, "level")
    return chained.unionByName(branching)


def link(messages: DataFrame, tools: tuple[Tool, ...] = TOOLS) -> DataFrame:
    """One row per call and per result without a call: conv_id, turn, position, call_id, result_turn, topo_order, status, errors, canonical."""
    calls, results = extract(messages)
    # texts stay out of the ordering: it runs over identifiers and turns
    needing = calls.where(F.size("depends_on") > 0)
    order = levels(needing.select("conv_id", "call_id", "depends_on").unionByName(calls.select("conv_id", "call_id", F.array().cast("array<string>").alias("depends_on"))))
    key = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    told = results.where(key).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    every = results.where(key).groupBy("conv_id", "call_id", "turn", "content").agg(F.count("*").alias("n"))
    other = every.join(told, ["conv_id", "call_id"]).where(~F.struct("turn", "content").eqNullSafe(F.col("r"))).select("conv_id", "call_id", F.struct("turn", "content").alias("r"))
    lone = other.withColumn("kind", F.lit("surplus_result")).unionByName(results.where(~key).select("conv_id", "call_id", F.struct("turn", "content").alias("r"), F.lit("orphan_result").alias("kind")))
    columns = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("position", "int"), ("name", "string"), ("arguments", "string"), ("depends_on", "array<string>"))]
    linked = calls.where(key).join(told, ["conv_id", "call_id"], "full_outer").withColumn("kind", F.lit(None).cast("string"))
    both = linked.unionByName(calls.where(~key).withColumn("r", F.lit(None).cast("struct<turn:bigint,content:string>")).withColumn("kind", F.lit(None).cast("string"))).unionByName(lone.select("*", *columns))
    both = both.join(order.withColumn("deep", F.lit(True)), ["conv_id", "call_id"], "left")
    errors = argument_errors(F.col("name"), F.col("arguments"), tools)
    is_call = F.col("name").isNotNull() | F.col("arguments").isNotNull()
    rows = both.select(
        "conv_id", "kind", F.coalesce("turn", "r.turn").alias("turn"), F.coalesce("position", F.lit(0)).alias("position"), "call_id", F.col("r.turn").alias("result_turn"),
        F.when(F.col("deep"), F.col("level")).otherwise(0).alias("level"), F.coalesce("deep", F.lit(False)).alias("deep"), is_call.alias("is_call"),
        F.when(is_call, errors).otherwise(F.array().cast("array<string>")).alias("e"), "name", "arguments", F.col("r.content").alias("content"),
    )
    status = F.when(~F.col("is_call"), F.coalesce("kind", F.lit("orphan_result"))).when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "no_identifier").when(F.col("deep") & F.col("level").isNull(), "cycle").when(F.size("e") > 0, "invalid_arguments").when(F.col("result_turn").isNull(), "missing_result").otherwise("ok")
    body = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null")), F.lit(',"id":'), _quoted("call_id"), F.lit(',"name":'), _quoted("name"), F.lit(',"result":'), _quoted("content"), F.lit("}"))
    full = rows.select("conv_id", "turn", "position", "call_id", "result_turn", F.coalesce("level", F.lit(1 << 62)).alias("level"), status.alias("status"), F.array_join("e", "; ").alias("errors"), body.alias("canonical"))
    full = full.withColumn("segment", F.floor(F.col("turn") / SEGMENT))
    sizes = full.groupBy("conv_id", "level", "segment").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("level", "segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("conv_id_"), F.col("level").alias("level_"), F.col("segment").alias("segment_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("conv_id", "level", "segment")]
    joined = full.join(sizes, same).select(*full.columns, "before")
    inside = Window.partitionBy("conv_id", "level", "segment").orderBy("turn", "position", "call_id", "canonical")
    return joined.select("conv_id", "turn", "position", "call_id", "result_turn", (F.col("before") + F.row_number().over(inside) - 1).cast("long").alias("topo_order"), "status", "errors", "canonical")


def _quoted(name: str) -> Column:
    """A string column as a JSON string, or null."""
    one = F.to_json(F.array(F.col(name)))
    return F.when(F.col(name).isNull(), "null").otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    out = link(load(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "call_id", "result_turn", "topo_order", "status", "errors", "canonical")


OP4_SQL = """
WITH m AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, text FROM m WHERE role = 'user'),
replies AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM m WHERE role = 'assistant'),
results AS (SELECT * FROM replies WHERE nth = 1),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id, r.turn AS result_turn,
         CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'missing_result' ELSE 'ok' END AS status,
         CASE WHEN c.call_id IS NULL THEN to_json({'arguments': NULL, 'id': r.call_id, 'name': NULL, 'result': r.content})
              ELSE to_json({'arguments': {'text': c.text, 'turn': c.turn}, 'id': c.call_id, 'name': 'reply', 'result': r.content}) END AS canonical
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
  UNION ALL
  SELECT conv_id, turn, call_id, turn, 'surplus_result', to_json({'arguments': NULL, 'id': call_id, 'name': NULL, 'result': content}) FROM replies WHERE nth > 1)
SELECT conv_id, turn, call_id, result_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, call_id, CAST(canonical AS VARCHAR)) - 1 AS topo_order,
       status, '' AS errors, CAST(canonical AS VARCHAR) AS canonical
FROM linked
"""


LOOKUP = (Tool("lookup", (("key", "string", True), ("limit", "integer", True))),)


def lookup_messages(conversations: DataFrame) -> DataFrame:
    """Conversations retold with explicit tool calls: identifiers that recur, chains of dependencies, cycles, bad arguments, missing results."""
    k, t = F.col("conv_id"), F.col("turn")
    ident = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    user = conversations.where(F.col("role") == "user").select("conv_id", "turn").distinct()
    ends = user.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    limit = F.when(k % 5 == 1, F.lit('"x"')).otherwise(t.cast("string"))
    parts = F.array_compact(F.array(F.when(k % 5 != 3, F.concat(F.lit('"key":"k'), t.cast("string"), F.lit('"'))), F.concat(F.lit('"limit":'), limit), F.when(k % 5 == 2, F.lit('"zeta":1'))))
    needs = F.when((k % 7 == 3) & (t == F.col("first")), F.col("last")).otherwise(t - 2)
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), ident(t), F.lit('","name":"lookup","arguments":{'), F.array_join(F.reverse(parts), ","), F.lit('},"depends_on":["'), ident(needs), F.lit('"]}]}'))
    calls = user.join(ends, "conv_id").select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    told = conversations.where((F.col("role") == "assistant") & ~((k % 3 == 2) & (t == 1)))
    answer = F.to_json(F.struct(ident(t - 1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    return calls.unionByName(told.select("conv_id", "turn", F.lit("tool").alias("role"), answer.alias("text")))


def tool_call_graphs(spark, sf_dir: str) -> DataFrame:
    """The operator on explicit calls, over all conversations."""
    out = link(lookup_messages(load(spark, sf_dir, "conversations")), LOOKUP)
    return out.select("conv_id", "turn", "call_id", "result_turn", "topo_order", "status", "errors", "canonical")


GRAPHS_SQL = """
WITH RECURSIVE u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'),
n AS (SELECT conv_id, min(turn) AS first, max(turn) AS last FROM u GROUP BY 1),
c AS (SELECT u.conv_id, turn, 'call_' || turn AS call_id, 'call_' || CASE WHEN u.conv_id % 7 = 3 AND turn = first THEN last ELSE turn - 2 END AS needs FROM u JOIN n USING (conv_id)),
w(conv_id, call_id, level) AS (
  SELECT conv_id, call_id, 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.call_id = c.needs)
  UNION ALL SELECT c.conv_id, c.call_id, w.level + 1 FROM w JOIN c ON c.conv_id = w.conv_id AND c.needs = w.call_id),
r AS (SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY content) AS nth
      FROM (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS content FROM conversations WHERE role = 'assistant' AND NOT (conv_id % 3 = 2 AND turn = 1))),
l AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id, r.turn AS result_turn, r.content, c.call_id IS NOT NULL AS is_call,
         CASE WHEN c.call_id IS NULL THEN 0 ELSE w.level END AS level, CASE WHEN c.call_id IS NULL THEN 'orphan_result' END AS kind
  FROM c LEFT JOIN w USING (conv_id, call_id) FULL JOIN (SELECT * FROM r WHERE nth = 1) r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  UNION ALL SELECT r.conv_id, r.turn, r.call_id, r.turn, r.content, false, CASE WHEN c.call_id IS NULL THEN 0 ELSE w.level END, 'surplus_result'
  FROM r LEFT JOIN c USING (conv_id, call_id) LEFT JOIN w USING (conv_id, call_id) WHERE nth > 1),
e AS (SELECT *, CASE WHEN NOT is_call THEN '' WHEN conv_id % 5 = 1 THEN 'limit: not integer' WHEN conv_id % 5 = 2 THEN 'zeta: unknown' WHEN conv_id % 5 = 3 THEN 'key: missing' ELSE '' END AS errors,
  CASE WHEN is_call THEN '{' || CASE WHEN conv_id % 5 <> 3 THEN '"key":"k' || turn || '",' ELSE '' END || '"limit":' || CASE WHEN conv_id % 5 = 1 THEN '"x"' ELSE turn::VARCHAR END || CASE WHEN conv_id % 5 = 2 THEN ',"zeta":1' ELSE '' END || '}' ELSE 'null' END AS args FROM l),
f AS (SELECT *, CASE WHEN NOT is_call THEN kind WHEN level IS NULL THEN 'cycle' WHEN errors <> '' THEN 'invalid_arguments' WHEN result_turn IS NULL THEN 'missing_result' ELSE 'ok' END AS status,
  '{"arguments":' || args || ',"id":"' || call_id || '","name":' || CASE WHEN is_call THEN '"lookup"' ELSE 'null' END || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS canonical FROM e)
SELECT conv_id, turn, call_id, result_turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 1000000000), turn, call_id, canonical) - 1 AS topo_order, status, errors, canonical FROM f
"""
