"""Analysis of a file's path and content: language, type, complexity, structure, importance."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import extension

#: Extensions of each analysed language, in order of precedence.
EXTENSIONS = {
    "typescript": (".ts", ".tsx"),
    "javascript": (".js", ".jsx", ".mjs"),
    "python": (".py", ".pyx"),
    "markdown": (".md", ".markdown"),
    "json": (".json", ".jsonc"),
    "yaml": (".yml", ".yaml"),
}
#: What marks the language of a file whose extension does not.
FALLBACKS = {
    "typescript": r"""^import\s+.*from\s+['"`]|interface\s+\w+|type\s+\w+""",
    "javascript": r"""^import\s+.*from\s+['"`]|require\s*\(['"`]""",
    "python": r"^import\s+\w+|^from\s+\w+\s+import|^def\s+\w+",
    "markdown": r"^#{1,6}\s+|\[.*?\]\(.*?\)",
}
_JS_IMPORTS = (r"""(?m)^import\s+.*from\s+['"`]""", r"(?m)^import\s*\(", r"""require\s*\(['"`]""")
_JS_EXPORTS = (r"(?m)^export\s+(default\s+)?", r"(?m)^module\.exports\s*=", r"(?m)exports\.\w+\s*=")
_JS_TESTS = (r"\b(describe|it|test|expect)\s*\(", r"\.test\.|\.spec\.", r"__tests__")
_SLASH_COMMENTS = (r"/\*[\s\S]*?\*/|//.*$",)
_JS_SHAPES = (r"\bclass\s+\w+", r"\bfunction\s+\w+", r"\basync\s+function", r"=>\s*\{", r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\btry\s*\{")
#: Patterns of imports, exports, tests, comments, and of what adds to complexity, by language.
IMPORTS = {"typescript": _JS_IMPORTS, "javascript": _JS_IMPORTS, "python": (r"(?m)^import\s+\w+", r"(?m)^from\s+\w+\s+import")}
EXPORTS = {"typescript": _JS_EXPORTS, "javascript": _JS_EXPORTS, "python": (r"(?m)^def\s+\w+", r"(?m)^class\s+\w+", r"__all__\s*=")}
TESTS = {"typescript": _JS_TESTS, "javascript": _JS_TESTS, "python": (r"\btest_\w+", r"\bassert\s+", r"unittest\.", r"pytest\.")}
COMMENTS = {
    "typescript": _SLASH_COMMENTS,
    "javascript": _SLASH_COMMENTS,
    "python": (r"#.*$", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''"),
    "markdown": (r"<!--[\s\S]*?-->",),
    "json": _SLASH_COMMENTS,
    "yaml": (r"#.*$",),
}
SHAPES = {
    "typescript": (r"\binterface\s+\w+", r"\btype\s+\w+", *_JS_SHAPES),
    "javascript": _JS_SHAPES,
    "python": (r"\bclass\s+\w+", r"\bdef\s+\w+", r"\basync\s+def", r"\bif\s+", r"\bfor\s+", r"\bwhile\s+", r"\btry:", r"\bwith\s+"),
    "markdown": (r"(?m)^#{1,6}\s+", r"```[\s\S]*?```", r"\[.*?\]\(.*?\)", r"!\[.*?\]\(.*?\)"),
    "json": (),
    "yaml": (r"(?m)^[a-zA-Z_][\w-]*:", r"(?m)^\s+-\s"),
}
#: Patterns that count once at most.
SHAPES_ONCE = {"json": (r'"scripts":', r'"dependencies":', r'"devDependencies":')}
#: Marks of documentation.
DOCUMENTATION = (r"/\*\*[\s\S]*?\*/", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", r"(?m)^#{1,6}\s+", r"@param\s+", r"@returns?\s+", r"@description\s+", r"(?i)README|CHANGELOG|CONTRIBUTING")
#: Scores of the type of a file and of its language.
TYPE_VALUE = {"source": 3, "test": 2, "config": 1, "documentation": 2, "build": 1, "data": 0}
LANGUAGE_VALUE = {"typescript": 3, "javascript": 2, "python": 2, "markdown": 1, "json": 1, "yaml": 1}
TYPE_IMPORTANCE = {"source": 30, "test": 20, "documentation": 15, "config": 10, "build": 5, "data": 5}
LANGUAGE_IMPORTANCE = {"typescript": 20, "javascript": 18, "python": 15, "markdown": 10, "json": 8, "yaml": 5}

def java(pattern: str) -> str:
    """The pattern with \\b, which here always begins a word, for ASCII words whatever the Java version takes it to be."""
    return pattern.replace(r"\b", "(?<![A-Za-z0-9_])")


def literal(pattern: str) -> str:
    """The longest text that every match of a pattern holds, as far as it is plain to see; empty if the pattern has alternatives."""
    plain = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    if "|" in plain or "(?i)" in pattern:
        return ""
    plain = re.sub(r"\[[^\]]*\](?:\{[\d,]*\}|[*+?])*|\([^)]*\)[?*]?", "\0", plain)
    plain = re.sub(r"(?<!\\)\{[\d,]+\}", "\0", plain)
    plain = re.sub(r"\\[A-Za-z](?:[*+?])*", "\0", plain)
    plain = re.sub(r"\\(.)", r"\1", re.sub(r"(?:\\.|[^\\\0])[*?]", "\0", plain))
    return max(re.split(r"[\0^$+]|\.\*", plain), key=len)


def _any(text: Column, patterns) -> Column:
    """Whether any pattern matches; what all its matches hold is looked for first."""
    found = F.lit(False)
    for p in patterns:
        known = literal(p)
        hit = text.rlike(java(p))
        found = found | (F.contains(text, F.lit(known)) & hit if known else hit)
    return found


def _count(text: Column, pattern: str) -> Column:
    known, n = literal(pattern), F.regexp_count(text, F.lit(java(pattern)))
    return F.when(F.contains(text, F.lit(known)), n).otherwise(0) if known else n


def _by_language(lang: Column, table: dict, make, default) -> Column:
    out = None
    for name, entry in table.items():
        out = F.when(lang == name, make(entry)) if out is None else out.when(lang == name, make(entry))
    return out.otherwise(default)


def language(path: Column, text: Column) -> Column:
    """By extension, else by marks at the start of the content, else unknown."""
    out = None
    for name, extensions in EXTENSIONS.items():
        hit = extension(path).isin(*extensions)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for name, mark in FALLBACKS.items():
        out = out.when(text.rlike(java(mark)), name)
    return out.otherwise("unknown")


def complexity(lang: Column, text: Column) -> Column:
    """Marks of structure + one for every 50 lines + half the pairs of braces, rounded; 0 for an unknown language."""
    total = lambda patterns: sum((_count(text, p) for p in patterns), F.lit(0))
    once = lambda patterns: sum((text.rlike(java(p)).cast("int") for p in patterns), F.lit(0))
    marks = _by_language(lang, SHAPES, total, F.lit(0)) + _by_language(lang, SHAPES_ONCE, once, F.lit(0))
    lines = F.floor(F.size(F.split(text, "\n")) / 50)
    braces = F.least(F.regexp_count(text, F.lit(r"\{")), F.regexp_count(text, F.lit(r"\}")))
    return F.when(lang == "unknown", 0).otherwise(F.floor(marks + lines + braces * F.lit(0.5) + F.lit(0.5))).cast("long")


def has(table: dict, lang: Column, text: Column) -> Column:
    return _by_language(lang, table, lambda p: _any(text, p), F.lit(False))


def has_documentation(text: Column) -> Column:
    return _any(text, DOCUMENTATION)


def comment_ratio(lang: Column, text: Column) -> Column:
    """Lines with a comment over lines without, blank ones left out; 0 without either."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    counted = lambda patterns: F.size(F.filter(lines, lambda x: _any(x, patterns)))
    n = _by_language(lang, COMMENTS, counted, F.lit(None).cast("int"))
    return F.coalesce(F.try_divide(n, F.size(lines) - n), F.lit(0.0))


def _holds(name: Column, *parts: str) -> Column:
    found = F.lit(False)
    for x in parts:
        found = found | F.contains(name, F.lit(x))
    return found


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "([^/]*)$", 1))


def folder_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def file_type(path: Column) -> Column:
    """Rules in this order: test, documentation, config, build, data, source."""
    name, folder = base_name(path), folder_name(path)
    out = F.when(_holds(name, ".test.", ".spec.") | _holds(folder, "test", "spec"), "test")
    out = out.when(_holds(name, "readme", "changelog", "contributing", "license") | F.endswith(path, F.lit(".md")), "documentation")
    out = out.when(_holds(name, "config", ".json", ".yml", ".yaml", "package.json", "tsconfig", ".env", "dockerfile"), "config")
    out = out.when(_holds(name, "webpack", "rollup", "vite", "build", "gulpfile", "makefile"), "build")
    return out.when(_holds(name, ".csv", ".xml", ".sql", "data"), "data").otherwise("source")


def _points(*rules: tuple[Column, int]) -> Column:
    return sum((F.when(hit, n).otherwise(0) for hit, n in rules), F.lit(0))


def _entry(key: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(0))


def semantic_value(a: dict[str, Column], text: Column) -> Column:
    """high from 8 points on, medium from 4 on, else low."""
    score = _points(
        (a["has_exports"], 3), (a["has_imports"], 2), (a["has_documentation"], 2),
        ((a["complexity"] > 5) & (a["complexity"] < 100), 2), (a["unique_tokens"] > 50, 1),
        ((a["comment_ratio"] > 0.1) & (a["comment_ratio"] < 2), 1),
        (text.rlike("TODO|FIXME|HACK|XXX"), 1), (text.rlike(r"class\s+\w+|interface\s+\w+|function\s+\w+"), 2),
        (_holds(text, "export default", "module.exports"), 2), (F.length(text) < 100, -2),
        (text.rlike(r"""console\.log\s*\(\s*['"`]"""), -1), (text.rlike(r"(?i)^\s*//.*test.*file"), -1),
    )
    score = score + _entry(a["file_type"], TYPE_VALUE) + _entry(a["language"], LANGUAGE_VALUE)
    return F.when(score >= 8, "high").when(score >= 4, "medium").otherwise("low")


def importance(a: dict[str, Column], path: Column) -> Column:
    """Additive, 0 to 100: value, type, language, structure, complexity between 3 and 50, telling names."""
    name = base_name(path)
    total = F.when(a["semantic_value"] == "high", 40).when(a["semantic_value"] == "medium", 25).otherwise(10)
    total = total + _entry(a["file_type"], TYPE_IMPORTANCE) + _entry(a["language"], LANGUAGE_IMPORTANCE)
    total = total + _points((a["has_exports"], 10), (a["has_imports"], 5), (a["has_documentation"], 5), (a["has_tests"], 8), (_holds(name, "index", "main", "app"), 15), (_holds(name, "util", "helper", "common"), 10))
    bonus = F.when((a["complexity"] > 3) & (a["complexity"] < 50), F.least(a["complexity"] * F.lit(0.5), F.lit(10.0))).otherwise(0.0)
    return F.least(F.lit(100), F.floor(total + bonus + F.lit(0.5))).cast("long")


def analysis(path: Column, text: Column, unique_tokens: Column) -> list[tuple[str, object]]:
    """The columns of an analysis in an order in which each uses only earlier ones: (name, column from a name -> column map)."""
    return [
        ("language", lambda a: language(path, text)),
        ("file_type", lambda a: file_type(path)),
        ("unique_tokens", lambda a: unique_tokens),
        ("complexity", lambda a: complexity(a["language"], text)),
        ("has_imports", lambda a: has(IMPORTS, a["language"], text)),
        ("has_exports", lambda a: has(EXPORTS, a["language"], text)),
        ("has_tests", lambda a: has(TESTS, a["language"], text)),
        ("has_documentation", lambda a: has_documentation(text)),
        ("comment_ratio", lambda a: comment_ratio(a["language"], text)),
        ("semantic_value", lambda a: semantic_value(a, text)),
        ("importance", lambda a: importance(a, path)),
    ]


def analyse(df, path: str, text: str):
    """``df`` with the columns of ``analysis``."""
    from lodestone.functions.text import unique_tokens

    known: dict[str, Column] = {}
    for name, make in analysis(F.col(path), F.col(text), unique_tokens(F.col(text))):
        df = df.withColumn(name, make(known))
        known[name] = F.col(name)
    return df


#: Marks of a change that matters, the least length of one without, and extensions of files that are analysed.
SEMANTIC_CHANGE = (r"(?m)^(import|export|from)\s", r"(?m)^(class|interface|type|enum)\s", r"(?m)^(function|const|let|var)\s.*=", r"(?m)^(async\s+)?function\s", r"/\*\*[\s\S]*?\*/")
SIGNIFICANT_LENGTH = 50
ANALYZABLE = (".ts", ".js", ".jsx", ".tsx", ".py", ".md", ".json", ".yml", ".yaml")


def is_analyzable(path: Column) -> Column:
    return extension(path).isin(*ANALYZABLE)


def basic_band(path: Column, tracked: Column, tracked_only: bool = True) -> Column:
    """Importance by name and extension alone; files that are not tracked are skipped if only tracked ones count."""
    name, ext = base_name(path), extension(path)
    gate = F.lit(tracked_only) & ~tracked
    out = F.when(gate, "skip").when(_holds(name, "index", "main", "app"), "critical").when(ext.isin(".ts", ".tsx"), "high")
    return out.when(ext.isin(".js", ".jsx", ".py"), "medium").when(ext.isin(".md", ".json", ".yaml", ".yml"), "low").otherwise("skip")


def is_semantic_change(text: Column) -> Column:
    """A mark of structure, or enough content besides comments and white space."""
    plain = F.regexp_replace(F.regexp_replace(text, r"/\*[\s\S]*?\*/", ""), r"(?m)//.*$", "")
    length = F.length(F.trim(F.regexp_replace(plain, r"\s+", " ")))
    return _any(text, SEMANTIC_CHANGE) | (length >= SIGNIFICANT_LENGTH)
