"""Sources to symbols and edges; modules, imports and dependency chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph, modules, parsing
from lodestone.plans.registry import query
from lodestone.plans.scoring import _EDGES_SQL, _edges
from lodestone.session import load

#: A source with every construct; 7 stands for the document's number.
SOURCE = """import { read as load7, save } from './io'
import React from 'react'
// function not() {}
export class Box7 extends Base implements Shape {
  area(w, h) {
    const r = w * h
    return this.scale(r)
  }
}
export async function run7(input) {
  const data = await load7(input)
  try {
    save(data, x => x)
  } catch (err) {
    console.log(err, "function g() {")
  }
  return new Box7(data)
}
const { left, right: other } = data7
state.count = left
export default run7
export { pick as choose } from './pick'
export * from './all'
"""
#: What stands in it: kind, detail, rows, sum of their first lines.
_EXPECTED = [
    ("imports", "named", 2, 2), ("imports", "default", 1, 2), ("class", None, 1, 4), ("export", "named", 3, 4 + 10 + 22), ("export", "default", 1, 21), ("export", "namespace", 1, 23),
    ("extends", None, 1, 4), ("implements", None, 1, 4), ("method", "(w, h)", 1, 5), ("function", "(input)", 1, 10), ("variable", "const", 2, 6 + 11), ("assigns", None, 3, 6 + 11 + 20),
    ("calls", "indirect", 2, 7 + 15), ("calls", "async", 1, 11), ("calls", "callback", 1, 13), ("instantiates", None, 1, 17), ("catches", None, 1, 14),
    ("data_flow", "assignment", 3, 6 + 6 + 11), ("data_flow", "return_value", 2, 7 + 17), ("data_flow", "parameter_passing", 2, 7 + 13), ("data_flow", "destructuring", 2, 19 + 19), ("data_flow", "property_access", 1, 20),
]
_ROWS = ", ".join(f"('{k}', {repr(d) if d else 'NULL'}, {n}, {s})" for k, d, n, s in _EXPECTED)


@query(f"SELECT kind, detail, CAST(found * docs AS BIGINT) AS n, CAST(at_lines * docs AS BIGINT) AS lines FROM (VALUES {_ROWS}) v(kind, detail, found, at_lines), (SELECT count(*) AS docs FROM documents)")
def script_symbols(spark, sf_dir):
    """GEN-8 to GEN-15 for JavaScript and TypeScript, over one source for each document."""
    files = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lit(SOURCE), "7", F.col("doc_id").cast("string")).alias("source"))
    rows = parsing.script_symbols(files, "doc_id", "source")
    return rows.groupBy("kind", "detail").agg(F.count("*").alias("n"), F.sum("start_line").alias("lines"))


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, 'Box' || doc_id AS class, 'run' || doc_id AS function, 4 AS class_line, 9 AS class_end, 10 AS function_line, 18 AS function_end FROM documents")
def script_scopes(spark, sf_dir):
    """GEN-8, SCALAR-8: the class and the function of every source with their lines."""
    files = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lit(SOURCE), "7", F.col("doc_id").cast("string")).alias("source"))
    rows = parsing.script_symbols(files, "doc_id", "source").where("kind in ('class', 'function')")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return rows.groupBy("doc_id").agg(of("class", "name").alias("class"), of("function", "name").alias("function"), of("class", "start_line").alias("class_line"), of("class", "end_line").alias("class_end"), of("function", "start_line").alias("function_line"), of("function", "end_line").alias("function_end"))


#: Modules are documents in twenty folders; each imports a module by a path through the parent folder, one of its own folder, and a package.
_MODULES_SQL = "m AS (SELECT doc_id, 'src/d' || (doc_id % 20) || '/m' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '/index.ts' ELSE '.ts' END AS module FROM documents), i AS (SELECT module AS importer, '../d' || ((doc_id * 7 + 1) % 20) || '/m' || (doc_id * 7 + 1) AS target, 'src/d' || ((doc_id * 7 + 1) % 20) || '/m' || (doc_id * 7 + 1) AS base, doc_id FROM m WHERE doc_id % 3 > 0 UNION ALL SELECT module, './m' || (doc_id + 20), 'src/d' || (doc_id % 20) || '/m' || (doc_id + 20), doc_id FROM m WHERE doc_id % 3 > 0 UNION ALL SELECT module, 'react/x' || (doc_id % 4), NULL, doc_id FROM m), r AS (SELECT importer, target, coalesce(a.module, b.module, CASE WHEN base IS NULL THEN 'node_modules/react' END) AS resolved, i.doc_id FROM i LEFT JOIN m a ON a.module = base || '.ts' LEFT JOIN m b ON b.module = base || '/index.ts')"


def _modules(spark, sf_dir):
    k = F.col("doc_id")
    text = lambda n: n.cast("string")
    tail = F.when(k % 3 == 0, "/index.ts").otherwise(".ts")
    m = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/d"), text(k % 20), F.lit("/m"), text(k), tail).alias("module"))
    far = k * 7 + 1
    flat = m.where(k % 3 > 0)
    i = flat.select(F.col("module").alias("importer"), F.concat(F.lit("../d"), text(far % 20), F.lit("/m"), text(far)).alias("module"), "doc_id")
    i = i.unionByName(flat.select(F.col("module").alias("importer"), F.concat(F.lit("./m"), text(k + 20)).alias("module"), "doc_id"))
    i = i.unionByName(m.select(F.col("module").alias("importer"), F.concat(F.lit("react/x"), text(k % 4)).alias("module"), "doc_id"))
    return m, i


@query(f"WITH {_MODULES_SQL} SELECT importer, target AS module, resolved FROM r")
def resolved_imports(spark, sf_dir):
    """JOIN-17: relative paths with parent folders, index files and packages."""
    m, i = _modules(spark, sf_dir)
    return graph.resolve_imports(i, m.select(F.col("module").alias("path")))


@query(f"WITH {_MODULES_SQL}, e AS (SELECT DISTINCT importer AS src, resolved AS dst, r.doc_id FROM r JOIN m ON m.module = resolved) SELECT src, dst, round(greatest(0.1, least(1.0, 0.5 + CASE WHEN doc_id % 15 > 10 THEN 0.3 WHEN doc_id % 15 > 5 THEN 0.2 WHEN doc_id % 15 > 1 THEN 0.1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0 END - CASE WHEN doc_id % 5 = 0 THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS strength FROM e")
def dependency_edges(spark, sf_dir):
    """JOIN-18, GEN-16, MATH-10: edges between modules of the index with their strength."""
    m, i = _modules(spark, sf_dir)
    r = graph.resolve_imports(i, m.select(F.col("module").alias("path")))
    inner = modules.module_edges(r, m)
    ids = m.select(F.col("module").alias("src"), "doc_id")
    facts = inner.join(ids, "src").select(F.col("src").alias("importer"), F.col("dst").alias("resolved"), (F.col("doc_id") % 15).alias("usage"), (F.col("doc_id") % 2 == 0).alias("is_default"), (F.col("doc_id") % 5 == 0).alias("type_only"))
    return modules.dependency_edges(facts).select("src", "dst", F.round("strength", 6).alias("strength"))


@query("WITH s AS (SELECT doc_id % 50 AS module, 'n' || (doc_id % 9) AS name, doc_id AS start_line FROM documents), x AS (SELECT DISTINCT module, 'n' || (module % 12) AS name FROM s) SELECT x.module, x.name, min(start_line) AS start_line FROM x JOIN s USING (module, name) GROUP BY ALL")
def exported_symbols(spark, sf_dir):
    """JOIN-16: exports with their first symbol; those without one are dropped."""
    d = load(spark, sf_dir, "documents")
    s = d.select((F.col("doc_id") % 50).alias("module"), F.concat(F.lit("n"), (F.col("doc_id") % 9).cast("string")).alias("name"), F.col("doc_id").alias("start_line"), F.lit("function").alias("kind"))
    x = s.select("module", F.concat(F.lit("n"), (F.col("module") % 12).cast("string")).alias("name")).distinct()
    return modules.exported_symbols(x, s).select("module", "name", "start_line")


@query(r"WITH n AS (SELECT doc_id, unnest(['de', 'the', 'is', 'zzz']) AS name, unnest([1, 2, 3, 1]) AS line FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents), w AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '[A-Za-z0-9_$]+')) AS name FROM l) SELECT n.doc_id AS module, n.name, count(w.pos) AS usage FROM n LEFT JOIN w ON w.doc_id = n.doc_id AND w.name = n.name AND w.pos <> n.line GROUP BY ALL")
def import_usage(spark, sf_dir):
    """JOIN-28: four names in every document, their own line left out."""
    d = load(spark, sf_dir, "documents").where("text is not null")
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(at).alias("line")) for n, at in (("de", 1), ("the", 2), ("is", 3), ("zzz", 1))))
    i = d.select(F.col("doc_id").alias("module"), F.explode(names).alias("x")).select("module", "x.*")
    return modules.import_usage(i, d.select(F.col("doc_id").alias("module"), "text")).select("module", "name", "usage")


@query(f"WITH {_MODULES_SQL} SELECT 'importing' AS kind, count(DISTINCT importer) AS modules FROM r WHERE contains(target, 'm1') UNION ALL SELECT 'exporting', count(DISTINCT module) FROM m WHERE list_contains(['e' || (doc_id % 13)], 'e4')")
def symbol_modules(spark, sf_dir):
    """JOIN-29: modules that import a name (by part of it) and those that export one (exactly)."""
    m, i = _modules(spark, sf_dir)
    importing = i.where(F.contains("module", F.lit("m1"))).agg(F.countDistinct("importer").alias("modules")).select(F.lit("importing").alias("kind"), "modules")
    exports = m.withColumn("exports", F.array(F.concat(F.lit("e"), (F.col("doc_id") % 13).cast("string"))))
    return importing.unionByName(exports.where(F.array_contains("exports", "e4")).agg(F.countDistinct("module").alias("modules")).select(F.lit("exporting").alias("kind"), "modules"))


@query(f"WITH {_EDGES_SQL}, n AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'part' || p_partkey FROM part WHERE p_partkey % 3 = 0) SELECT type, count(*) AS edges FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) GROUP BY type")
def known_edges(spark, sf_dir):
    """JOIN-19: edges with both ends among the nodes."""
    tag = lambda t, c, p, m: load(spark, sf_dir, t).where(F.col(c) % m == 0).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("node"))
    nodes = tag("supplier", "s_suppkey", "s", 2).unionByName(tag("part", "p_partkey", "part", 3))
    return modules.known_ends(_edges(spark, sf_dir), nodes).groupBy("type").agg(F.count("*").alias("edges"))


@query(f"WITH {_EDGES_SQL}, z AS (SELECT 'part' || p_partkey AS node, p_size AS tokens FROM part), c AS (SELECT DISTINCT dst AS node FROM e WHERE src = 's1' AND type IN ('extends', 'implements', 'instantiates', 'calls')), f AS (SELECT DISTINCT dst AS node FROM e WHERE src = 's1' AND type IN ('calls', 'accesses', 'assigns', 'imports') AND dst NOT IN (SELECT node FROM c)), x AS (SELECT DISTINCT dst AS node FROM e WHERE src = 's1' AND type IN ('configures', 'depends_on', 'data_flow') AND dst NOT IN (SELECT node FROM c UNION ALL SELECT node FROM f)), a AS (SELECT 'critical' AS class, node FROM c UNION ALL SELECT 'forward', node FROM f UNION ALL SELECT 'contextual', node FROM x) SELECT class, count(*) AS nodes, CAST(sum(tokens) AS BIGINT) AS tokens FROM a JOIN z USING (node) GROUP BY class")
def dependency_chain(spark, sf_dir):
    """GRAPH-11, WIN-2: what supplier s1 depends on, by class; the budget takes all (smaller ones are tested)."""
    sizes = load(spark, sf_dir, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_size").alias("tokens"))
    chain = modules.dependency_chain(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), sizes, 1e9)
    return chain.groupBy("class").agg(F.count("*").alias("nodes"), F.sum("tokens").alias("tokens"))
