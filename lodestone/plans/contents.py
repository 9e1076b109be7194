"""Content analysis of files: documents with derived paths and code-like beginnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import content as c
from lodestone.functions import text as t
from lodestone.plans.registry import query
from lodestone.session import load

#: File names and beginnings by doc_id, so that every rule is met.
NAMES = ("index.ts", "util.js", "readme.md", "app.config.json", "test/helper.py", "data.csv", "build.yml", "main.tsx", "notes.txt", "tool.py", "Common.mjs")
HEADS = (
    "import a from 'b'\nexport default class Foo {\n  if (x) { y }\n  for (z) {}\n}\n// note\n",
    "def f():\n  # c\n  if x\n\nclass A\nassert 1\n",
    "# Title\n[link](u)\n",
    "",
    "describe('x')\n/** doc */\nconst r = require('q')\nmodule.exports = r\n",
    "key: 1\n - item\n\"scripts\": {}\n",
    "type Alias = string\n",
)
BANDS = "CASE WHEN importance >= 80 THEN 'critical' WHEN importance >= 65 THEN 'high' WHEN importance >= 40 THEN 'medium' WHEN importance >= 20 THEN 'low' ELSE 'skip' END"


def files(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    pick = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    path = F.concat(F.lit("src/d"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), pick(NAMES))
    return d.select("doc_id", path.alias("path"), F.concat(pick(HEADS), F.coalesce("text", F.lit(""))).alias("content"))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_literal(x) for x in values) + "]"


def _matches(patterns, text: str = "content") -> str:
    return "(" + (" OR ".join(f"regexp_matches({text}, {_literal(p)})" for p in patterns) or "false") + ")"


def _count(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(content, {_literal(p)}))" for p in patterns) or "0"


def _case(table: dict, make, default: str) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {make(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _holds(name: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({name}, '{x}')" for x in parts) + ")"


#: The rules once more, for DuckDB; scores are written out here.
ANALYSIS_SQL = rf"""
f AS (SELECT doc_id, 'src/d' || (doc_id % 10) || '/' || ({_list(NAMES)})[doc_id % {len(NAMES)} + 1] AS path, ({_list(HEADS)})[doc_id % {len(HEADS)} + 1] || coalesce(text, '') AS content FROM documents),
n AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS name, lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS folder, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext FROM f),
l AS (SELECT *,
  CASE WHEN ext IN ('.ts', '.tsx') THEN 'typescript' WHEN ext IN ('.js', '.jsx', '.mjs') THEN 'javascript' WHEN ext IN ('.py', '.pyx') THEN 'python' WHEN ext IN ('.md', '.markdown') THEN 'markdown' WHEN ext IN ('.json', '.jsonc') THEN 'json' WHEN ext IN ('.yml', '.yaml') THEN 'yaml'
       {" ".join(f"WHEN regexp_matches(content, {_literal(p)}) THEN '{k}'" for k, p in c.FALLBACKS.items())} ELSE 'unknown' END AS language,
  CASE WHEN {_holds("name", ".test.", ".spec.")} OR {_holds("folder", "test", "spec")} THEN 'test'
       WHEN {_holds("name", "readme", "changelog", "contributing", "license")} OR path LIKE '%.md' THEN 'documentation'
       WHEN {_holds("name", "config", ".json", ".yml", ".yaml", "package.json", "tsconfig", ".env", "dockerfile")} THEN 'config'
       WHEN {_holds("name", "webpack", "rollup", "vite", "build", "gulpfile", "makefile")} THEN 'build'
       WHEN {_holds("name", ".csv", ".xml", ".sql", "data")} THEN 'data' ELSE 'source' END AS file_type,
  len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda x: length(x) > 2))) AS unique_tokens,
  list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM n),
s AS (SELECT *,
  CASE WHEN language = 'unknown' THEN 0 ELSE CAST(floor({_case(c.SHAPES, _count, "0")} + {_case(c.SHAPES_ONCE, lambda ps: " + ".join(f"CAST(regexp_matches(content, {_literal(p)}) AS INTEGER)" for p in ps), "0")} + len(string_split(content, chr(10))) // 50 + least(length(content) - length(replace(content, '{{', '')), length(content) - length(replace(content, '}}', ''))) * 0.5 + 0.5) AS BIGINT) END AS complexity,
  {_case(c.IMPORTS, _matches, "false")} AS has_imports, {_case(c.EXPORTS, _matches, "false")} AS has_exports, {_case(c.TESTS, _matches, "false")} AS has_tests, {_matches(c.DOCUMENTATION)} AS has_documentation,
  {_case(c.COMMENTS, lambda ps: f"len(list_filter(lines, lambda x: {_matches(ps, 'x')}))", "NULL")} AS commented FROM l),
r AS (SELECT *, coalesce(commented::DOUBLE / nullif(len(lines) - commented, 0), 0) AS comment_ratio FROM s),
v AS (SELECT *, CASE has_exports WHEN true THEN 3 ELSE 0 END + CASE WHEN has_imports THEN 2 ELSE 0 END + CASE WHEN has_documentation THEN 2 ELSE 0 END + CASE WHEN complexity > 5 AND complexity < 100 THEN 2 ELSE 0 END
  + CASE WHEN unique_tokens > 50 THEN 1 ELSE 0 END + CASE WHEN comment_ratio > 0.1 AND comment_ratio < 2 THEN 1 ELSE 0 END
  + CASE file_type WHEN 'source' THEN 3 WHEN 'test' THEN 2 WHEN 'config' THEN 1 WHEN 'documentation' THEN 2 WHEN 'build' THEN 1 ELSE 0 END
  + CASE language WHEN 'typescript' THEN 3 WHEN 'javascript' THEN 2 WHEN 'python' THEN 2 WHEN 'markdown' THEN 1 WHEN 'json' THEN 1 WHEN 'yaml' THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(content, 'TODO|FIXME|HACK|XXX') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(content, 'class\s+\w+|interface\s+\w+|function\s+\w+') THEN 2 ELSE 0 END
  + CASE WHEN contains(content, 'export default') OR contains(content, 'module.exports') THEN 2 ELSE 0 END - CASE WHEN length(content) < 100 THEN 2 ELSE 0 END
  - CASE WHEN regexp_matches(content, 'console\.log\s*\(\s*[''"`]') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(content, '(?i)^\s*//.*test.*file') THEN 1 ELSE 0 END AS points FROM r),
w AS (SELECT *, CASE WHEN points >= 8 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END AS semantic_value FROM v),
a AS (SELECT *, CAST(least(100, floor(CASE semantic_value WHEN 'high' THEN 40 WHEN 'medium' THEN 25 ELSE 10 END
  + CASE file_type WHEN 'source' THEN 30 WHEN 'test' THEN 20 WHEN 'documentation' THEN 15 WHEN 'config' THEN 10 ELSE 5 END
  + CASE language WHEN 'typescript' THEN 20 WHEN 'javascript' THEN 18 WHEN 'python' THEN 15 WHEN 'markdown' THEN 10 WHEN 'json' THEN 8 WHEN 'yaml' THEN 5 ELSE 0 END
  + CASE WHEN has_exports THEN 10 ELSE 0 END + CASE WHEN has_imports THEN 5 ELSE 0 END + CASE WHEN has_documentation THEN 5 ELSE 0 END + CASE WHEN has_tests THEN 8 ELSE 0 END
  + CASE WHEN complexity > 3 AND complexity < 50 THEN least(complexity * 0.5, 10) ELSE 0 END
  + CASE WHEN {_holds("name", "index", "main", "app")} THEN 15 ELSE 0 END + CASE WHEN {_holds("name", "util", "helper", "common")} THEN 10 ELSE 0 END + 0.5)) AS BIGINT) AS importance FROM w)
"""


@query(f"WITH {ANALYSIS_SQL} SELECT doc_id, language, file_type, CAST(unique_tokens AS BIGINT) AS unique_tokens, CAST(complexity AS BIGINT) AS complexity, has_imports, has_exports, has_tests, has_documentation, round(comment_ratio, 6) AS comment_ratio, semantic_value, importance, {BANDS} AS band FROM a")
def content_analysis(spark, sf_dir):
    """SCALAR-18 to SCALAR-24, FILT-13."""
    a = c.analyse(files(spark, sf_dir), "path", "content")
    keep = ["doc_id", "language", "file_type", F.col("unique_tokens").cast("long").alias("unique_tokens"), "complexity", "has_imports", "has_exports", "has_tests", "has_documentation"]
    return a.select(*keep, F.round("comment_ratio", 6).alias("comment_ratio"), "semantic_value", "importance", t.band(F.col("importance")).alias("band"))


@query(f"WITH {ANALYSIS_SQL}, d AS (SELECT *, {BANDS} AS band FROM a) SELECT band, file_type, language, count(*) AS n, round(avg(importance), 6) AS mean_importance, CAST(sum(CASE WHEN band <> 'skip' THEN 1 ELSE 0 END) AS BIGINT) AS indexed, CAST(count_if(semantic_value = 'high') AS BIGINT) AS high, CAST(count_if(semantic_value = 'medium') AS BIGINT) AS medium, CAST(count_if(semantic_value = 'low') AS BIGINT) AS low FROM d GROUP BY GROUPING SETS ((band), (file_type), (language), ())")
def importance_distribution(spark, sf_dir):
    """AGG-12, AGG-13: one pass with grouping sets; zeros are kept for the three values."""
    d = c.analyse(files(spark, sf_dir), "path", "content").withColumn("band", t.band(F.col("importance")))
    value = [F.count_if(F.col("semantic_value") == x).alias(x) for x in ("high", "medium", "low")]
    return d.groupingSets([["band"], ["file_type"], ["language"], []], "band", "file_type", "language").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"), F.count_if(F.col("band") != "skip").alias("indexed"), *value)


@query(rf"""
WITH {ANALYSIS_SQL.split("l AS (SELECT *,")[0].rstrip().rstrip(",")}
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'skip' WHEN contains(name, 'index') OR contains(name, 'main') OR contains(name, 'app') THEN 'critical' WHEN ext IN ('.ts', '.tsx') THEN 'high' WHEN ext IN ('.js', '.jsx', '.py') THEN 'medium' WHEN ext IN ('.md', '.json', '.yml', '.yaml') THEN 'low' ELSE 'skip' END AS band,
  ext IN ('.ts', '.js', '.jsx', '.tsx', '.py', '.md', '.json', '.yml', '.yaml') AS analyzable,
  regexp_matches(content, '(?m)^(import|export|from)\s') OR regexp_matches(content, '(?m)^(class|interface|type|enum)\s') OR regexp_matches(content, '(?m)^(function|const|let|var)\s.*=') OR regexp_matches(content, '(?m)^(async\s+)?function\s') OR regexp_matches(content, '/\*\*[\s\S]*?\*/')
  OR length(trim(regexp_replace(regexp_replace(regexp_replace(content, '/\*[\s\S]*?\*/', '', 'g'), '(?m)//.*$', '', 'g'), '\s+', ' ', 'g'))) >= 50 AS semantic
FROM n
""")
def basic_bands(spark, sf_dir):
    """FILT-14, FILT-15, FILT-16; every fourth file is not tracked."""
    path = F.col("path")
    return files(spark, sf_dir).select("doc_id", c.basic_band(path, F.col("doc_id") % 4 != 0).alias("band"), c.is_analyzable(path).alias("analyzable"), c.is_semantic_change(F.col("content")).alias("semantic"))
