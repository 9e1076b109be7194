"""JavaScript and TypeScript sources to symbols and edges, by a scanner over masked text.

Strings, templates and comments are blanked first, so that patterns and brace
depths only see code. Scopes are ranges of braces; a symbol or an edge belongs
to the innermost scope that holds its line. No grammar is involved: sources
that do not compile give what can be recognised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind: function, method, class, variable, import, export or an edge (calls, extends, implements, assigns, catches, data_flow).
SCHEMA = "kind string, name string, scope string, start_line int, end_line int, target string, detail string, strength double, confidence double"
_SKIP = {"if", "for", "while", "switch", "catch", "return", "function", "super", "typeof", "new", "await", "import", "constructor", "async", "else", "do", "of", "in", "case", "throw", "delete", "void", "yield", "this", "null", "true", "false", "undefined"}
_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_FUNCTION = re.compile(r"\b(async\s+)?function\b\s*\*?\s*(\w+)\s*\(([^)]*)\)")
_ARROW = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(async\s+)?(?:\(([^)]*)\)|(\w+))\s*(?::[^=\n]+)?=>")
_CLASS = re.compile(r"\bclass\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w.,\s]+?))?\s*\{")
_METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|readonly|override)\s+)*(async\s+)?(?:get\s+|set\s+)?(\w+)\s*\(([^)]*)\)\s*(?::[^{;\n]+)?\{", re.M)
_VARIABLE = re.compile(r"\b(const|let|var)\s+(\w+)\s*(?::[^=\n;]+)?(?:=\s*([^\n;]*))?")
_DESTRUCTURED = re.compile(r"\b(?:const|let|var)\s*([{\[])([^}\]]*)[}\]]\s*=\s*([\w.]+)")
_CALL = re.compile(r"(\bawait\s+)?(\bnew\s+)?((?:\w+\s*(?:\?\.|\.)\s*)*)(\b[A-Za-z_$]\w*)\s*\(")
_ASSIGN = re.compile(r"^[ \t]*([A-Za-z_$][\w.]*)\s*=(?![=>])\s*([^\n;]+)", re.M)
_CATCH = re.compile(r"\bcatch\s*(?:\(\s*(\w+)[^)]*\))?\s*\{")
_IMPORT = re.compile(r"^[ \t]*import\s+(type\s+)?(?:(.+?)\s+from\s+)?['\"]([^'\"]+)['\"]", re.M | re.S)
_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(\{[^}]*\}|\w+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)")
_EXPORT = re.compile(r"^[ \t]*export\s+(default\s+)?(?:(?:abstract\s+)?(?:async\s+)?(function|class|const|let|var|interface|type|enum)\s*\*?\s*(\w+)|\*(?:\s+as\s+(\w+))?|\{([^}]*)\}|(\w+))(?:\s+from\s+['\"]([^'\"]+)['\"])?", re.M)
_RETURN = re.compile(r"\breturn\s+([^\n;]+)")
_NAME = re.compile(r"(?<![\w.])([A-Za-z_$]\w*)")


def masked(text: str) -> str:
    """The source with strings, templates and comments blanked; positions and lines stay."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


class Source:
    def __init__(self, text: str):
        self.text, self.code = text, masked(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close = self._braces()
        self.scopes: list[tuple[int, int, str, str]] = []

    def _braces(self) -> dict[int, int]:
        stack, out = [], {}
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                out[stack.pop()] = m.start()
        return out

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at)

    def body(self, at: int) -> tuple[int, int]:
        """Start and end of the block that opens at or after ``at`` on the same statement; the line's end without one."""
        opened = self.code.find("{", at)
        stop = min((x for x in (self.code.find("\n", at), self.code.find(";", at)) if x >= 0), default=len(self.code))
        if opened < 0 or opened > stop and self.code[at:opened].strip(" \t\n") not in ("", "=>"):
            return at, stop
        return opened, self.close.get(opened, len(self.code))

    def scope(self, at: int) -> tuple[str, str]:
        inside = [s for s in self.scopes if s[0] < at <= s[1]]
        return max(inside, key=lambda s: s[0])[2:] if inside else ("module", "module")


def _parameters(text: str) -> list[str]:
    return [m[1] for part in text.split(",") if (m := re.match(r"\s*(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?([A-Za-z_$]\w*)", part))]


def parse(text: str) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for one source."""
    s = Source(text)
    out: list[tuple] = []
    names: set[str] = set()

    def add(kind, name, at, end=None, target=None, detail=None, strength=None, confidence=None):
        out.append((kind, name, s.scope(at)[0], s.line(at), s.line(at if end is None else end), target, detail, strength, confidence))

    found = []
    for m in _CLASS.finditer(s.code):
        found.append((m.start(), "class", m[1], *s.body(m.end() - 1), "", m))
    for m in _FUNCTION.finditer(s.code):
        found.append((m.start(), "function", m[2], *s.body(m.end()), m[3], m))
    for m in _ARROW.finditer(s.code):
        found.append((m.start(), "function", m[1], *s.body(m.end()), m[3] if m[3] is not None else m[4], m))
    classes = [(f[3], f[4]) for f in found if f[1] == "class"]
    for m in _METHOD.finditer(s.code):
        at = m.start(2)
        inside = [c for c in classes if c[0] < at < c[1]]
        if inside and m[2] not in _SKIP - {"constructor"} and s.code.count("{", max(inside)[0], at) - s.code.count("}", max(inside)[0], at) == 1:
            found.append((at, "method", m[2], *s.body(m.end() - 1), m[3], m))
    for at, kind, name, begin, end, _, _ in sorted(found, key=lambda f: f[0]):
        s.scopes.append((begin, end, name, kind))
    for at, kind, name, _, end, parameters, m in sorted(found, key=lambda f: f[0]):
        names.add(name)
        add(kind, name, at, end, detail="(" + ", ".join(_parameters(parameters)) + ")" if kind != "class" else None)
        if kind == "class":
            if m[2]:
                add("extends", name, at, target=m[2], strength=1.0, confidence=0.9)
            for base in (m[3] or "").split(","):
                if base.strip():
                    add("implements", name, at, target=base.strip(), strength=1.0, confidence=0.9)
    declared = {f[2] for f in found if f[1] == "function"}
    for m in _VARIABLE.finditer(s.code):
        if m[2] not in declared and m[2] not in ("function",):
            names.add(m[2])
            add("variable", m[2], m.start(2), detail=m[1])
            if m[3]:
                add("assigns", m[2], m.start(2), target=m[3].strip()[:80], strength=0.8, confidence=0.9)
                _flows(s, add, m[3], m[2], m.start(2), "assignment")
    for m in _DESTRUCTURED.finditer(s.code):
        for part in m[2].split(","):
            if one := re.match(r"\s*(?:\.\.\.)?(\w+)(?:\s*:\s*(\w+))?", part):
                add("data_flow", m[3].split(".")[0], m.start(), target=one[2] or one[1], detail="destructuring", strength=0.8, confidence=0.8)
    for m in _ASSIGN.finditer(s.code):
        add("assigns", m[1], m.start(1), target=m[2].strip()[:80], strength=0.8, confidence=0.9)
        _flows(s, add, m[2], m[1], m.start(1), "property_access" if "." in m[1] else "assignment")
    for m in _CALL.finditer(s.code):
        before = s.code[max(0, m.start() - 12) : m.start(4)]
        if m[4] in _SKIP or re.search(r"\bfunction\s*\*?\s*$", before) or any(f[0] == m.start(4) for f in found if f[1] == "method"):
            continue
        receiver = re.sub(r"\s|\?", "", m[3])
        closing = _closing(s.code, m.end() - 1)
        arguments = s.code[m.end() : closing]
        scope, _ = s.scope(m.start(4))
        if m[2]:
            add("instantiates", scope, m.start(4), target=receiver + m[4], strength=1.0, confidence=0.9)
            continue
        kind = "async" if m[1] else "callback" if "=>" in arguments or re.search(r"\bfunction\b", arguments) else "indirect" if receiver else "direct"
        strength = min(1.0, 0.7 + (0 if receiver else 0.2) + (0.1 if arguments.strip() else 0))
        add("calls", scope, m.start(4), target=receiver + m[4], detail=kind, strength=round(strength, 6), confidence=0.9)
        for x in _NAME.findall(arguments):
            if x not in _SKIP and x in names:
                add("data_flow", x, m.start(4), target=receiver + m[4], detail="parameter_passing", strength=0.8, confidence=0.8)
    for m in _RETURN.finditer(s.code):
        scope, _ = s.scope(m.start())
        _flows(s, add, m[1], scope, m.start(), "return_value")
    for m in _CATCH.finditer(s.code):
        add("catches", s.scope(m.start())[0], m.start(), target=m[1] or "error", strength=0.7, confidence=0.8)
    out += list(_imports(s)) + list(_exports(s))
    return iter(sorted(out, key=lambda r: (r[3], r[0], r[1] or "", r[5] or "")))


def _closing(code: str, at: int) -> int:
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == "(") - (code[i] == ")")
        if not depth:
            return i
    return len(code)


def _flows(s: Source, add, expression: str, target: str, at: int, kind: str) -> None:
    for name in dict.fromkeys(_NAME.findall(expression)):
        if name not in _SKIP and not re.search(rf"(?<![\w.]){re.escape(name)}\s*\(", expression):
            flow = "array_access" if re.search(rf"(?<![\w.]){re.escape(name)}\s*\[", expression) else "property_access" if re.search(rf"(?<![\w.]){re.escape(name)}\s*\.", expression) else kind
            strength = {"assignment": 0.9, "return_value": 0.8, "property_access": 0.7, "array_access": 0.7}[flow]
            add("data_flow", name, at, target=target, detail=flow, strength=strength, confidence=0.8)


def _listed(text: str) -> list[tuple[str, str]]:
    """(name, local name) of a braced list."""
    parts = [re.match(r"\s*(?:type\s+)?(\w+)(?:\s+as\s+(\w+))?", x) for x in text.strip(" {}\n\t").split(",")]
    return [(m[1], m[2] or m[1]) for m in parts if m]


def _imports(s: Source) -> Iterator[tuple]:
    for m in _IMPORT.finditer(s.text):
        if s.code[m.start() : m.start() + len(m[0])].strip()[:6] != "import":
            continue
        line, clause = s.line(m.start() + len(m[0]) - len(m[0].lstrip())), (m[2] or "").strip()
        row = lambda name, kind, line=line, m=m: ("imports", name, "module", line, line, m[3], kind + (" type" if m[1] else ""), 1.0, 0.9)
        if not clause:
            yield row(None, "side_effect")
        if one := re.search(r"\{([^}]*)\}", clause):
            for _, local in _listed(one[1]):
                yield row(local, "named")
        if one := re.search(r"\*\s+as\s+(\w+)", clause):
            yield row(one[1], "namespace")
        if one := re.match(r"(\w+)", clause):
            yield row(one[1], "default")
    for m in _REQUIRE.finditer(s.text):
        line = s.line(m.start())
        if s.code[m.start() : m.start() + 3].strip():
            for _, local in _listed(m[1]):
                yield ("imports", local, "module", line, line, m[2], "named" if m[1][0] == "{" else "default", 1.0, 0.9)


def _exports(s: Source) -> Iterator[tuple]:
    for m in _EXPORT.finditer(s.text):
        if not s.code[m.start() : m.start() + len(m[0])].strip().startswith("export"):
            continue
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        line, source = s.line(at), m[7]
        kind = "default" if m[1] else "named"
        if m[5] is not None:
            names = [(local, kind) for _, local in _listed(m[5])]
        elif m[3]:
            names = [(m[3], kind)]
        elif m[6]:
            names = [(m[6], "default" if m[1] else kind)]
        else:
            names = [(m[4] or "*", "namespace")]
        for name, k in names:
            yield ("export", name, "module", line, line, source, k, 1.0, 0.9)


class ParseScript:
    """UDTF handler."""

    def eval(self, content: str):
        if content:
            yield from parse(content)


def script_symbols(files: DataFrame, key: str, text: str) -> DataFrame:
    """Symbols and edges of JavaScript and TypeScript files: key and the columns of ``SCHEMA``."""
    handler = F.udtf(ParseScript, returnType=SCHEMA)
    own = files.select(key, F.col(text).alias("text_"))
    return own.lateralJoin(handler(F.col("text_").outer())).select(key, *(x.split()[0] for x in SCHEMA.split(", ")))
