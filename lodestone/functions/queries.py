"""What a question names: files, functions, symbols; and how it is summarised and followed up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that a question can name, and words that are no identifiers.
NAMED_EXTENSIONS = (".ts", ".js", ".tsx", ".jsx", ".py", ".java", ".cpp", ".c", ".h")
STOP_WORDS = ("and", "or", "not", "the", "for", "with", "from")
_W = "(?<![A-Za-z0-9_])"
_E = "(?![A-Za-z0-9_])"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _identifiers(names: Column, least: int) -> Column:
    return F.array_distinct(F.filter(names, lambda x: (F.length(x) >= least) & ~F.lower(x).isin(*STOP_WORDS)))


def file_paths(task: Column) -> Column:
    """Distinct file names, and paths after file, path or in, of the lower-cased question."""
    low = F.lower(task)
    found = F.concat(_all(low, r"[/\\]?([a-zA-Z0-9._-]+\.[a-zA-Z]+)"), _all(low, r"(?:file|path|in)\s+([a-zA-Z0-9._/-]+\.[a-zA-Z]+)"))
    ends = lambda x: F.regexp_extract(x, r"(\.[^.]*)$", 1).isin(*NAMED_EXTENSIONS)
    return F.array_distinct(F.filter(found, lambda x: ends(x) & (F.length(x) > 3) & ~F.contains(x, F.lit("node_modules"))))


def function_names(task: Column) -> Column:
    """Distinct words after function, method or call, and before a parenthesis."""
    low = F.lower(task)
    return _identifiers(F.concat(_all(low, r"(?:function|method|call(?:ing)?)\s+([a-zA-Z_][a-zA-Z0-9_]*)"), _all(low, _W + r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(")), 2)


def symbol_names(task: Column) -> Column:
    """Distinct words after class, interface, type or component, and words in camel or Pascal case (of the question as it is written)."""
    named = _identifiers(_all(task, r"(?i)(?:class|interface|type|component)\s+([A-Z][a-zA-Z0-9]*)"), 2)
    cased = _identifiers(_all(task, _W + r"([A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]*)+)" + _E), 3)
    return F.array_distinct(F.concat(named, cased))


def focus_symbols(task: Column) -> Column:
    """Words after function, class, method, component or service, and identifiers of over two letters."""
    words = F.split(F.lower(task), r"\s+")
    n = F.size(words)
    after = F.filter(words, lambda x, i: (i > 0) & F.get(words, i - 1).isin("function", "class", "method", "component", "service"))
    loose = F.filter(_all(task, _W + r"([a-z][a-zA-Z0-9]*)|[A-Z][a-zA-Z0-9]*"), lambda x: F.length(x) > 2)
    upper = F.filter(_all(task, r"([A-Z][a-zA-Z0-9]*)"), lambda x: F.length(x) > 2)
    return F.array_sort(F.array_distinct(F.concat(F.when(n > 1, after).otherwise(F.array().cast("array<string>")), loose, upper)))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def is_critical(file_path: Column, function: Column, symbol: Column, files: Column, functions: Column, symbols: Column) -> Column:
    """A named file holds the path or the other way round; the same for names, whatever their case."""
    by = lambda names, own: F.coalesce(F.exists(names, lambda x: either_contains(F.lower(own), F.lower(x))), F.lit(False))
    return F.coalesce(F.exists(files, lambda x: either_contains(file_path, x)), F.lit(False)) | by(functions, function) | by(symbols, symbol)


def keyword_match(name: Column, path: Column, question: Column) -> Column:
    """Any question word of over two letters in the lower-cased name and path."""
    words = F.filter(F.split(F.lower(question), r"\s+"), lambda w: F.length(w) > 2)
    return F.exists(words, lambda w: F.contains(F.lower(F.concat_ws(" ", name, path)), w))


def bytes_text(n: Column) -> Column:
    """A size in B, KB, MB or GB with one digit."""
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    unit = F.element_at(F.array(*(F.lit(x) for x in ("B", "KB", "MB", "GB"))), step + 1)
    return F.concat(F.format_string("%.1f", F.round(n / F.pow(F.lit(1024.0), step), 1)), F.lit(" "), unit)


def duration_text(seconds: Column) -> Column:
    """Days and hours, hours and minutes, minutes and seconds, or seconds."""
    part = lambda size, mod: F.floor(seconds / size) % mod if mod else F.floor(seconds / size)
    d, h, m, s = part(86400, 0), part(3600, 24), part(60, 60), seconds % 60
    text = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))
    return F.when(d > 0, text(d, "d", h, "h")).when(h > 0, text(h, "h", m, "m")).when(m > 0, text(m, "m", s, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))


def follow_ups(n_chunks: Column, efficiency: Column, tokens: Column, complexity: Column) -> Column:
    """Tips for the next question by thresholds of this one's result."""
    return F.array_compact(
        F.array(
            F.when(n_chunks == 0, "use other terms"),
            F.when((n_chunks > 0) & (n_chunks < 5), "widen the question"),
            F.when(n_chunks >= 20, "name a file or a symbol"),
            F.when(efficiency < 0.5, "raise the weight of relevance"),
            F.when(tokens > 50_000, "lower the token budget"),
            F.when(complexity == "complex", "split the question"),
        )
    )


def recommended_globs(path: Column, score: Column) -> Column:
    """Patterns for a file: its extension, its folder, and itself if it scores over 10."""
    ext, folder = F.regexp_extract(path, r"(\.[^./]*)$", 1), F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.array_distinct(F.array_compact(F.array(F.when(ext != "", F.concat(F.lit("**/*"), ext)), F.when(folder != "", F.concat(folder, F.lit("/**"))), F.when(score > 10, path))))
