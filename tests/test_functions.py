"""Formulas and operators with known answers."""

from pyspark.sql import functions as F

from lodestone.functions import scores, text
from lodestone.functions.vector import cosine
from lodestone.operators import chunking, delta, graph, selection


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cosine(spark):
    vec = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    for a, b, want in (((1, 0), (0, 1), 0), ((1, 2), (2, 4), 1), ((1,), (1, 2), 0), ((0, 0), (1, 1), 0)):
        assert abs(value(spark, cosine(vec(*a), vec(*b))) - want) < 1e-9


def test_known_answers(spark):
    assert value(spark, text.tokens_by_length(F.lit("123456789"))) == 3
    assert value(spark, text.tokens_by_structure(F.lit("ab"))) == 22
    assert value(spark, scores.group_importance(F.lit(10.0), F.lit(False))) == 1.0
    assert abs(value(spark, scores.dependency_strength(F.lit(6), F.lit(True), F.lit(False))) - 0.8) < 1e-9
    assert abs(value(spark, scores.dependency_strength(F.lit(0), F.lit(False), F.lit(True))) - 0.3) < 1e-9
    assert abs(value(spark, scores.call_strength(F.lit(True), F.lit(True))) - 1.0) < 1e-9
    assert abs(value(spark, scores.path_strength(F.array(F.lit(0.8), F.lit(0.4)))) - 0.6) < 1e-9
    assert value(spark, scores.path_type(F.array(F.lit("calls"), F.lit("calls")))) == "call_chain"
    assert value(spark, scores.path_type(F.array(F.lit("calls"), F.lit("imports")))) == "mixed"
    assert abs(value(spark, scores.completeness(F.lit(1), F.lit(0), F.lit(1), F.lit(0))) - 0.6) < 1e-9
    assert abs(value(spark, scores.extraction_confidence(F.lit(1), F.lit(1), F.lit(0))) - 0.9) < 1e-9
    assert value(spark, scores.debounce_ms(F.lit("high"), F.lit("critical"))) == 750
    for n, want in ((80, "critical"), (65, "high"), (40, "medium"), (20, "low"), (19, "skip")):
        assert value(spark, text.band(F.lit(n))) == want
    assert [len(p) for p in value(spark, text.pages(F.lit("x" * 45000)))] == [20000, 20000, 5000]


def test_chunks(spark):
    lines = spark.createDataFrame([("f", "\n".join(map(str, range(120))))], "path string, text string")
    got = chunking.window_chunks(lines, "path", "text").orderBy("chunk").select("start_line", "end_line").collect()
    assert [tuple(r) for r in got] == [(1, 50), (51, 100), (101, 120)]
    md = spark.createDataFrame([("f", "intro\n# A\nx\n## B")], "path string, text string")
    got = chunking.section_chunks(md, "path", "text").orderBy("section").select("start_line", "end_line").collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 3), (4, 4)]


def test_code_chunks_and_symbols(spark):
    src = "import os\nclass A(B):\n    def m(self, x):\n        y = f(x)\n        return y\n\ndef g():\n    A()\n"
    files = spark.createDataFrame([("a.py", "python", src), ("b.ts", "typescript", "export function h() {\n  return 1\n}\nconst z = 2\n")], "path string, lang string, text string")
    got = {(r.path, r.chunk_type, r.symbol_name, r.start_line, r.end_line) for r in chunking.code_chunks(files, "path", "lang", "text").collect()}
    assert {("a.py", "class", "A", 2, 5), ("a.py", "function", "g", 7, 8), ("b.ts", "function", "h", 1, 3), ("b.ts", "config", None, 4, 4)} <= got
    sym = {(r.kind, r.name, r.target) for r in chunking.python_symbols(files.where("lang = 'python'"), "path", "text").collect()}
    assert {("class", "A", None), ("method", "m", None), ("extends", "A", "B"), ("calls", "m", "f"), ("calls", "g", "A"), ("data_flow", "x", "y")} <= sym


def test_budgets(spark):
    d = spark.createDataFrame([("q", 1, 5), ("q", 2, 9), ("q", 3, 4)], "q string, i int, size int")
    assert [r.i for r in selection.prefix_stop(d, ["q"], ["i"], "size", 10).collect()] == [1]
    assert sorted(r.i for r in selection.prefix_skip(d, ["q"], ["i"], "size", 10).collect()) == [1, 3]


def test_delta_with_missing_hashes(spark):
    old = spark.createDataFrame([("src/server.ts", None), ("src/indexer.ts", None), ("old-file.ts", None)], "path string, h string")
    new = spark.createDataFrame([("src/server.ts", "a"), ("src/indexer.ts", "b"), ("README.md", "c"), ("package.json", "d")], "path string, h string")
    got = dict(map(tuple, delta.diff(old, new, "path", "h").collect()))
    assert got == {"src/server.ts": "modified", "src/indexer.ts": "modified", "README.md": "added", "package.json": "added", "old-file.ts": "deleted"}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "calls", 0.8), ("b", "c", "calls", 0.4), ("c", "a", "calls", 1.0), ("c", "c", "calls", 1.0)], "src string, dst string, type string, strength double")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.bfs(e, start, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r.cycle for r in graph.cycles(e, 4).collect()] == [["a", "b", "c"]]
    assert {tuple(r.path) for r in graph.paths(e, start, 3).collect()} == {("a", "b"), ("a", "b", "c")}
    s = spark.createDataFrame([("s1", "f", 5)], "id string, file_path string, start_line int")
    c = spark.createDataFrame([("big", "f", 1, 100), ("small", "f", 4, 9)], "chunk_id string, file_path string, start_line int, end_line int")
    assert graph.symbols_to_chunks(s, c).first().chunk_id == "small"
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "react/x")], "importer string, module string")
    files = spark.createDataFrame([("src/b.ts",), ("src/b/index.ts",)], "path string")
    assert {r.module: r.resolved for r in graph.resolve_imports(imports, files).collect()} == {"./b": "src/b.ts", "react/x": "node_modules/react"}


def test_glob():
    import re

    assert re.match(text.glob_regex("src/**/x.ts"), "src/a/b/x.ts") and not re.match(text.glob_regex("*.ts"), "a/b.ts")
