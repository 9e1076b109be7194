"""Text and path expressions: extractors, estimates, importance scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and the language of each.
LANGUAGE_BY_EXTENSION = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".md": "markdown", ".json": "json"}
#: Words that add a branch.
BRANCH_WORDS = ("if", "else", "elif", "while", "for", "switch", "case", "try", "catch", "except")
#: Extensions of relevant files, and parts of a path that make it irrelevant.
RELEVANT_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".py", ".go", ".rs", ".java", ".cpp", ".c", ".h", ".hpp", ".md", ".rst", ".txt", ".json", ".yaml", ".yml", ".toml", ".html", ".css", ".scss")
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".cache")
#: Extensions of code files.
CODE_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".py", ".go", ".rs", ".java", ".cpp", ".c", ".h")
#: Terms of a query that raise its complexity, label or preset.
TECHNICAL_TERMS = ("class", "function", "import", "export", "async", "await", "error", "bug", "fix")
LABEL_TERMS = ("implement", "understand", "analyze", "debug", "refactor", "architecture")
DEBUG_TERMS = ("debug", "error", "fix", "bug", "issue")
EXPLORE_TERMS = ("understand", "learn", "explore", "architecture", "overview")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def is_code(path: Column) -> Column:
    return extension(path).isin(*CODE_EXTENSIONS)


def is_relevant(path: Column, extensions=RELEVANT_EXTENSIONS) -> Column:
    """A known extension and none of the skipped folders anywhere in the path."""
    skipped = F.lit(False)
    for d in SKIP_DIRS:
        skipped = skipped | path.contains(d)
    return extension(path).isin(*extensions) & ~skipped


def words(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")


def whole_words(wanted) -> str:
    """A pattern for whole ASCII words."""
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(wanted) + r")(?![A-Za-z0-9_])"


def count_words(text: Column, wanted) -> Column:
    return F.regexp_count(text, F.lit(whole_words(wanted)))


def has_word(text: Column, wanted) -> Column:
    return F.lower(text).rlike(whole_words(wanted))


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    import re

    return F.regexp_count(text, F.lit(re.escape(literal)))


def complexity(text: Column) -> Column:
    """1 + branch words + && + || + ?."""
    return 1 + count_words(text, BRANCH_WORDS) + count_of(text, "&&") + count_of(text, "||") + count_of(text, "?")


def tokens_by_length(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def tokens_by_structure(text: Column) -> Column:
    """ceil(ceil(len / 3.5) + .1 lines + 5 fences + 2 definitions + 20)."""
    lines = F.size(F.split(text, "\n"))
    fences = count_of(text, "```")
    defs = count_of(text, "function") + count_of(text, "=>") + count_of(text, "{")
    return F.ceil(F.ceil(F.length(text) / F.lit(3.5)) + lines * F.lit(0.1) + fences * F.lit(5.0) + defs * 2 + 20).cast("long")


def tokens_by_span(start: Column, end: Column, radius: int) -> Column:
    return (end - start + 1) * 15 + 2 * radius * 15


def unique_tokens(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_]", " "), " +")
    return F.size(F.array_distinct(F.filter(parts, lambda w: F.length(w) > 2)))


def calls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)\s*\("), F.lit(1))


def imports(text: Column) -> Column:
    js = F.regexp_extract_all(text, F.lit(r"import[^\n]*?from\s+['\"]([^'\"]+)['\"]"), F.lit(1))
    py = F.regexp_extract_all(text, F.lit(r"(?m)^(?:from|import)\s+([A-Za-z0-9_.]+)"), F.lit(1))
    return F.concat(js, py)


def exports(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"export\s+(?:async\s+)?(?:function|const|class)\s+([A-Za-z0-9_]+)"), F.lit(1))


def embedding_text(symbol: Column, kind: Column, content: Column, imported: Column) -> Column:
    return F.concat_ws(" ", symbol, kind, content, F.concat_ws(" ", F.slice(imported, 1, 3)))


def band(score: Column, threshold: float = 20) -> Column:
    return F.when(score >= 80, "critical").when(score >= 65, "high").when(score >= 40, "medium").when(score >= threshold, "low").otherwise("skip")


def _pieces(text: Column) -> Column:
    """Parts between runs of white space; an empty one counts, as at the ends of a text."""
    return F.size(F.split(text, r"[ \t\n\r\f]+"))


def query_complexity(text: Column) -> Column:
    """min(1, len/200) + min(.3, words/20) + .2 for a technical term, at most 1."""
    tech = F.when(has_word(text, TECHNICAL_TERMS), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.least(F.lit(1.0), F.length(text) / 200) + F.least(F.lit(0.3), _pieces(text) / 20) + tech)


def query_label(text: Column) -> Column:
    n = _pieces(text)
    return F.when((n > 10) | has_word(text, LABEL_TERMS), "complex").when(n > 5, "medium").otherwise("simple")


def preset_for(text: Column) -> Column:
    return F.when(has_word(text, DEBUG_TERMS), "high-relevance").when(has_word(text, EXPLORE_TERMS), "high-diversity").otherwise("balanced")


def glob_regex(glob: str) -> str:
    """Anchored regex of a glob: ** any path, * within a segment, ? one character."""
    import re

    out = re.escape(glob).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace("\0", ".*")
    return f"^{out}$"


def canonical_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def path_hash(path: Column, size: int = 12) -> Column:
    return F.substring(F.sha2(path, 256), 1, size)


def pages(text: Column, size: int = 20000) -> Column:
    """Array of fixed-width pages; an empty text has one empty page."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
