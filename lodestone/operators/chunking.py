"""Files to chunks: windows, paragraphs, sections, and code by a state machine."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines_of(files: DataFrame, key: str, text: str) -> DataFrame:
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def window_chunks(files: DataFrame, key: str, text: str, size: int = 50) -> DataFrame:
    """Chunks of ``size`` lines: key, chunk, start_line, end_line, content. Stays in one row per file until it explodes."""
    n = F.size("l")
    one = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.struct(k.alias("chunk"), (k * size + 1).alias("start_line"), F.least(n, (k + 1) * size).alias("end_line"), F.array_join(F.slice("l", k * size + 1, F.lit(size)), "\n").alias("content")))
    return files.select(key, F.split(text, "\n").alias("l")).select(key, F.explode(one).alias("c")).select(key, "c.*")


def paragraph_chunks(files: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraphs between blank lines: key, chunk, content."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return files.select(key, F.posexplode(parts).alias("chunk", "content"))


def section_chunks(files: DataFrame, key: str, text: str, header: str = "^#{1,6} ") -> DataFrame:
    """Sections that start at header lines: key, section, start_line, end_line, n_chars; blank ones are dropped."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines_of(files, key, text).withColumn("section", F.sum(F.col("line").rlike(header).cast("int")).over(w))
    return tagged.groupBy(key, "section").agg((F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.sum(F.length("line")).alias("n_chars"), F.max(F.length(F.trim("line"))).alias("widest")).where("widest > 0").drop("widest")


CHUNK = T.StructType([T.StructField("chunk_type", T.StringType()), T.StructField("symbol_name", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("content", T.StringType())])
_JS_START = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(")


def js_chunks(text: str) -> Iterator[tuple]:
    """Functions and classes by brace depth, the rest as configuration lines, or the whole file."""
    lines, at, out = text.split("\n"), 0, []
    while at < len(lines):
        m = _JS_START.match(lines[at])
        if not m:
            if lines[at].strip():
                out.append(("config", None, at + 1, at + 1, lines[at]))
            at += 1
            continue
        depth, end, opened = 0, at, False
        for end in range(at, len(lines)):
            depth += lines[end].count("{") - lines[end].count("}")
            opened |= "{" in lines[end]
            if opened and depth <= 0:
                break
        out.append(("class" if m[1] == "class" else "function", m[2] or m[3], at + 1, end + 1, "\n".join(lines[at : end + 1])))
        at = end + 1
    return iter(out or [("documentation", None, 1, len(lines), text)])


def python_chunks(text: str) -> Iterator[tuple]:
    """Top-level functions and classes by syntax tree; text that does not parse is one chunk."""
    lines = text.split("\n")
    try:
        nodes = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return iter([("documentation", None, 1, len(lines), text)])
    out = []
    for node in nodes:
        kind = "class" if isinstance(node, ast.ClassDef) else "function" if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) else "config"
        out.append((kind, getattr(node, "name", None), node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno])))
    return iter(out or [("documentation", None, 1, len(lines), text)])


class ChunkCode:
    """UDTF handler: (language, content) to chunks."""

    def eval(self, language: str, content: str):
        if content is not None:
            yield from (python_chunks if language == "python" else js_chunks)(content)


def code_chunks(files: DataFrame, key: str, language: str, text: str) -> DataFrame:
    """Code files to chunks through a table function, joined laterally."""
    udtf = F.udtf(ChunkCode, returnType=CHUNK)
    own = files.select(key, F.col(language).alias("language_"), F.col(text).alias("text_"))
    return own.lateralJoin(udtf(F.col("language_").outer(), F.col("text_").outer())).select(key, *CHUNK.fieldNames())


SYMBOL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("target", T.StringType()), T.StructField("strength", T.DoubleType())])


class ParsePython:
    """UDTF handler: Python source to symbols and edges (calls, imports, assignments, inheritance, catches, data flow)."""

    def eval(self, content: str):
        try:
            tree = ast.parse(content or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        yield from self._walk(tree, "module")

    def _walk(self, node: ast.AST, scope: str):
        for child in ast.iter_child_nodes(node):
            line, end = getattr(child, "lineno", 0), getattr(child, "end_lineno", 0)
            inner = scope
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield ("method" if isinstance(node, ast.ClassDef) else "function", child.name, scope, line, end, None, None)
                inner = child.name
            elif isinstance(child, ast.ClassDef):
                yield ("class", child.name, scope, line, end, None, None)
                for base in child.bases:
                    yield ("extends", child.name, scope, line, end, ast.unparse(base), 1.0)
                inner = child.name
            elif isinstance(child, ast.Call):
                simple = isinstance(child.func, ast.Name)
                yield ("calls", scope, scope, line, end, ast.unparse(child.func), min(1.0, 0.7 + 0.2 * simple + 0.1 * bool(child.args or child.keywords)))
            elif isinstance(child, ast.Import | ast.ImportFrom):
                for a in child.names:
                    yield ("imports", a.asname or a.name, scope, line, end, f"{getattr(child, 'module', None) or ''}.{a.name}".strip("."), 1.0)
            elif isinstance(child, ast.Assign | ast.AnnAssign):
                for t in getattr(child, "targets", [getattr(child, "target", None)]):
                    if isinstance(t, ast.Name):
                        yield ("variable", t.id, scope, line, end, None, None)
                        for used in ast.walk(child.value) if child.value else ():
                            if isinstance(used, ast.Name):
                                yield ("data_flow", used.id, scope, line, end, t.id, 0.8)
            elif isinstance(child, ast.ExceptHandler) and child.type is not None:
                yield ("catches", scope, scope, line, end, ast.unparse(child.type), 0.7)
            yield from self._walk(child, inner)


def python_symbols(files: DataFrame, key: str, text: str) -> DataFrame:
    """Symbols (no target) and edges (with target) of Python files."""
    udtf = F.udtf(ParsePython, returnType=SYMBOL)
    own = files.select(key, F.col(text).alias("text_"))
    return own.lateralJoin(udtf(F.col("text_").outer())).select(key, *SYMBOL.fieldNames())
