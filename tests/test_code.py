"""Parsing, modules, chains, presets and content analysis with known answers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import content, embeddings, queries, scores, text
from lodestone.operators import graph, modules, parsing, selection
from lodestone.plans.parsing import SOURCE


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_script_parser():
    rows = list(parsing.parse(SOURCE))
    found = {(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows}
    assert {
        ("class", "Box7", "module", 4, 9, None, None), ("method", "area", "Box7", 5, 8, None, "(w, h)"), ("function", "run7", "module", 10, 18, None, "(input)"),
        ("calls", "run7", "run7", 11, 11, "load7", "async"), ("calls", "run7", "run7", 13, 13, "save", "callback"), ("calls", "area", "area", 7, 7, "this.scale", "indirect"),
        ("data_flow", "w", "area", 6, 6, "r", "assignment"), ("data_flow", "data", "run7", 17, 17, "run7", "return_value"), ("instantiates", "run7", "run7", 17, 17, "Box7", None),
        ("imports", "React", "module", 2, 2, "react", "default"), ("export", "choose", "module", 22, 22, "./pick", "named"), ("export", "*", "module", 23, 23, "./all", "namespace"),
    } <= found
    assert not any(r[1] in ("not", "g") for r in rows)  # comments and strings
    strength = {(r[0], r[5]): r[7] for r in rows}
    assert strength["calls", "load7"] == 1.0 and strength["calls", "this.scale"] == 0.8 and strength["catches", "err"] == 0.7


@pytest.mark.parametrize("source", ["", "}}}", "function (", "class {", "import", "export", "`${", "const x = ", "a" * 100_000, "{" * 5000, "x(" * 3000])
def test_script_parser_takes_anything(source):
    list(parsing.parse(source))


def test_script_symbols_of_empty_and_null_sources(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "const a = 1")], "doc_id long, source string")
    assert {(r.doc_id, r.kind) for r in parsing.script_symbols(df, "doc_id", "source").collect()} == {(3, "variable"), (3, "assigns")}


def test_paths_are_normal(spark):
    for path, want in (("src/x/../b", "src/b"), ("./a//b/.", "a/b"), ("../a", "a"), ("a/../../b", "b"), ("", "")):
        assert value(spark, graph.normal_path(F.lit(path))) == want
    imports = spark.createDataFrame([("src/x/a.ts", "../b"), ("src/x/a.ts", "../../c")], "importer string, module string")
    files = spark.createDataFrame([("src/b.ts",), ("c/index.ts",)], "path string")
    assert {r.module: r.resolved for r in graph.resolve_imports(imports, files).collect()} == {"../b": "src/b.ts", "../../c": "c/index.ts"}


def test_fixed_values(spark):
    p = selection.PRESETS
    assert (p["high-relevance"].cushion, p["high-diversity"].lam, p["high-diversity"].budget, p["memory-conservative"].lam, p["enterprise"].cushion) == (0.15, 0.4, 120_000, 0.8, 0.15)
    assert [x.metric for x in p.values()] == ["semantic", "cosine", "semantic", "jaccard", "semantic"]
    for kind, want in (("array_access", 0.7), ("closure_capture", 0.7), ("conditional_flow", 0.4), ("unheard of", 0.5)):
        assert value(spark, scores.flow_strength(F.lit(kind))) == want
    assert value(spark, text.complexity(F.lit("if elif except and or iffy x && y || z ? 1 : 2"))) == 7
    for kinds, want in ((["imports"], "dependency_chain"), (["data_flow", "data_flow"], "data_flow_chain"), (["throws"], "error_propagation"), (["extends"], "inheritance_chain"), (["assigns"], "mixed")):
        assert value(spark, scores.path_type(F.array(*(F.lit(k) for k in kinds)))) == want
    for usage, want in ((1, 0.5), (2, 0.6), (6, 0.7), (11, 0.8)):
        assert abs(value(spark, scores.dependency_strength(F.lit(usage), F.lit(False), F.lit(False))) - want) < 1e-9
    for path, want in (("a/x.hpp", True), ("a/x.rb", False), ("distance/x.ts", False), ("a/x.TS", True)):
        assert value(spark, text.is_relevant(F.lit(path))) is want
    for question, label, preset in (("please refactor it", "complex", "balanced"), ("fix this", "simple", "high-relevance"), ("prefix this", "simple", "balanced"), ("overview of one two three", "simple", "high-diversity")):
        assert value(spark, text.query_label(F.lit(question))) == label and value(spark, text.preset_for(F.lit(question))) == preset


def test_presets_from_settings():
    base = selection.PRESETS["balanced"]
    assert selection.validated({"lam": 2, "budget": 5, "cushion": "x", "metric": "other", "coverage": True}) == base
    got = selection.validated({"lam": 0.1, "budget": 20_000, "cushion": 0.4, "metric": "jaccard", "coverage": 0.5})
    assert (got.lam, got.budget, got.cushion, got.metric, got.coverage) == (0.1, 20_000, 0.4, "jaccard", 0.5)
    env = {"LODESTONE_MMR_PRESET": "enterprise", "LODESTONE_MMR_LAMBDA": "0.2", "LODESTONE_MMR_BUDGET": "lots"}
    got = selection.from_environment(env)
    assert (got.lam, got.budget) == (0.2, 200_000) and selection.from_environment({}) == base
    assert selection.describe(base)[0] == "preset: balanced" and selection.describe(got)[0] == "preset: custom"


def test_content_analysis_of_one_file(spark):
    source = "import a from 'b'\nexport default class Foo {\n  if (x) { y }\n}\n// note\n"
    df = spark.createDataFrame([("src/index.ts", source), ("a/b.unknown", "plain")], "path string, content string")
    ts, other = content.analyse(df, "path", "content").orderBy(F.desc("path")).collect()
    assert (ts.language, ts.file_type, ts.has_imports, ts.has_exports, ts.has_tests, ts.has_documentation) == ("typescript", "source", True, True, False, False)
    assert ts.complexity == 3 and abs(ts.comment_ratio - 0.25) < 1e-9  # class, if, half of two pairs of braces
    assert ts.semantic_value == "high" and ts.importance == 100
    assert (other.language, other.complexity, other.semantic_value) == ("unknown", 0, "low")


def test_prefix_skip_beyond_a_former_cap(spark):
    rows = [("q", i, 3 if i % 2 else 100_000) for i in range(12_000)] + [("r", 1, 9), ("r", 2, 5), ("r", 3, 6), ("r", 4, 5)]
    d = spark.createDataFrame(rows, "q string, i int, size int")
    got = selection.prefix_skip(d, ["q"], ["i"], "size", 20_000).collect()
    assert sum(r.q == "q" for r in got) == 6000 and max(r.rank for r in got if r.q == "q") == 12_000
    assert sorted(r.i for r in selection.prefix_skip(d.where("q = 'r'"), ["q"], ["i"], "size", 15).collect()) == [1, 2]
    assert selection.prefix_skip(d.limit(0), ["q"], ["i"], "size", 15).count() == 0


def test_dependency_chain_keeps_to_its_budget(spark):
    edges = spark.createDataFrame([("s", "base", "extends"), ("s", "big", "calls"), ("s", "f", "calls"), ("f", "g", "calls"), ("caller", "s", "calls"), ("s", "conf", "configures"), ("conf", "deep", "data_flow")], "src string, dst string, type string")
    sizes = spark.createDataFrame([("s", 10), ("base", 5), ("big", 900), ("f", 5), ("g", 5), ("caller", 5), ("conf", 5), ("deep", 5)], "node string, tokens int")
    seeds = spark.createDataFrame([("s",)], "node string")
    got = {r.node: (r["class"], r.depth) for r in modules.dependency_chain(edges, seeds, sizes, 100).collect()}
    # big does not fit: critical ones skip it, forward ones stop there, so g is not reached
    assert got == {"base": ("critical", 1), "f": ("critical", 1), "caller": ("backward", 1), "conf": ("contextual", 1), "deep": ("contextual", 2)}
    got = {r.node: r["class"] for r in modules.dependency_chain(edges, seeds, sizes, 5000).collect()}
    assert got["g"] == "forward" and got["big"] == "critical"
    assert modules.dependency_chain(edges, seeds, sizes, 10).count() == 0


def test_stand_in_embeddings(spark):
    def plain(s, n):
        h = 0
        for c in s:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        seed, out = abs(h), []
        for _ in range(n):
            seed = (seed * 9301 + 49297) % 233280
            out.append(seed / 233280 * 2 - 1)
        return out

    for s in ("", "a", "src1", "a longer text that overflows 32 bits many times"):
        assert np.allclose(value(spark, embeddings.mock_embedding(F.lit(s), 12)), plain(s, 12))
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    got = [r.h for r in v.select(embeddings.float32_sha256("v").alias("h")).collect()]
    assert got == [hashlib.sha256(np.array([1.5, -2.0], "<f4").tobytes()).hexdigest(), None]


def test_critical_set_of_a_question(spark):
    q = F.lit("Fix function parseIt( in src/Login.ts with class UserService")
    assert "login.ts" in value(spark, queries.file_paths(q)) and value(spark, queries.function_names(q)) == ["parseit"]
    assert {"UserService", "Fix", "parseIt", "Login"} == set(value(spark, queries.symbol_names(q)))


def test_incremental_index_equals_the_whole_one(spark):
    from lodestone.operators import indexing

    schema = "file_path string, content string"
    old = spark.createDataFrame([("a.py", "def f():\n    return 1\n\ndef g():\n    return 2\n"), ("b.md", "x\ny"), ("gone.md", "z"), ("same.ts", "const a = 1")], schema)
    new = spark.createDataFrame([("a.py", "def f():\n    return 1\n\ndef g():\n    return 3\n"), ("b.md", "x\ny"), ("new.js", "function h() {\n}\n"), ("same.ts", "const a = 1")], schema)
    embed = lambda text: F.array(F.length(text).cast("double"))
    got = indexing.incremental_index(indexing.full_index(old, embed), new, embed)
    key = lambda df: sorted((r.file_path, r.chunk, r.content_hash, tuple(r.embedding)) for r in df.collect())
    assert key(got) == key(indexing.full_index(new, embed))
    assert {(r.file_path, r.start_line): r.reused for r in got.collect()} == {("a.py", 1): True, ("a.py", 4): False, ("b.md", 1): True, ("new.js", 1): False, ("same.ts", 1): True}


def test_literals_stand_in_every_match():
    import re

    tables = (content.IMPORTS, content.EXPORTS, content.TESTS, content.COMMENTS, content.SHAPES, content.SHAPES_ONCE)
    patterns = {p for t in tables for ps in t.values() for p in ps} | set(content.DOCUMENTATION) | set(content.SEMANTIC_CHANGE)
    samples = SOURCE + "\n# T\n## x\n```a```\n[a](b) ![c](d)\n<!-- x -->\ndef f(\nasync def g\nclass A\nif x\nfor (a) while (b) try {\ntry: with y\nassert z\ntest_a unittest. pytest.\n__all__ = 1\nexports.a = 2\nmodule.exports = 3\nrequire('x')\nimport (\nfrom a import b\nimport a from 'b'\nkey: v\n - item\n\"scripts\": \"dependencies\": \"devDependencies\":\n/** d */\n'''q'''\n\"\"\"r\"\"\"\n@param x\n@returns y\n@description z\n__tests__ interface I type T => { while x"
    met = 0
    for p in patterns:
        for m in re.finditer(p, samples):
            met += 1
            assert content.literal(p) in m[0], (p, m[0])
    assert met > 60
