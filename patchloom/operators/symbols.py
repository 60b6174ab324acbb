"""Symbols and calls from source text, by patterns and nesting, for thirteen languages.

A file is one row and is bounded by the caller's size limit; work is a map over files in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions.text import language_of_path

# Declaration patterns by language family, call sites and words that are no calls.
_GO = (("function", r"^\s*func\s+(?:\(\s*\w*\s*\*?(?P<owner>[A-Za-z_]\w*)[^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)\s*\(", "upper", False), ("type", r"^\s*type\s+(?P<name>[A-Za-z_]\w*)\s+(?:struct|interface)\b", "upper", True))
_SCRIPT = (("", r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?P<kind>class|interface|type|enum|function)\s+(?P<name>[A-Za-z_$][\w$]*)", "has export", None), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>", "has export", False))
_JVM_TYPE = r"^\s*(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|open|data|value|internal)\s+)*(?P<kind>class|interface|enum|record|object)\s+(?P<name>[A-Za-z_$][\w$]*)"
_JAVA = (("", _JVM_TYPE, "has public", True), ("function", r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]+>\s*)?[A-Za-z_$][\w$<>,.?\[\]]*\s+(?P<name>[A-Za-z_$][\w$]*)\s*\(", "has public", False))
_KOTLIN = (("", _JVM_TYPE, "yes", True), ("function", r"^\s*(?:(?:public|protected|private|internal|open|final|abstract|override|suspend|inline|tailrec|operator|infix|external)\s+)*fun\s+(?:<[^>]+>\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*\(", "has public", False))
_PYTHON = (("class", r"^\s*class\s+(?P<name>[A-Za-z_]\w*)\b", "not _", True), ("function", r"^\s*(?:async\s+)?def\s+(?P<name>[A-Za-z_]\w*)\s*\(", "not _", False))
_C_TYPE = r"^\s*(?:(?:public|protected|private|internal|abstract|sealed|static|partial|readonly|ref|unsafe|final)\s+)*(?P<kind>class|interface|struct|enum|union|namespace)\s+(?P<name>[A-Za-z_]\w*)"
_C_FUNCTION = r"^\s*(?:(?:public|protected|private|internal|static|virtual|override|abstract|sealed|async|extern|inline|constexpr|consteval|friend|unsafe)\s+)*(?:[A-Za-z_~][\w:<>,.?*&\[\]\s]+\s+)(?P<name>[A-Za-z_~]\w*)\s*\("
_C, _CSHARP = ((("", _C_TYPE, rule, True), ("function", _C_FUNCTION, rule, False)) for rule in ("yes", "has public"))
_RUST = (("", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|trait|union|type|mod)\s+(?P<name>[A-Za-z_]\w*)", "has pub", True), ("implementation", r"^\s*impl(?:<[^>]+>)?\s+(?:[^\s]+\s+for\s+)?(?P<name>[A-Za-z_]\w*)", "no", True), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]+\"\s+)?fn\s+(?P<name>[A-Za-z_]\w*)\s*\(", "has pub", False))
_PHP = (("", r"^\s*(?:(?:abstract|final|readonly)\s+)*(?P<kind>class|interface|trait|enum)\s+(?P<name>[A-Za-z_]\w*)", "yes", True), ("function", r"^\s*(?:(?:public|protected|private|static|final|abstract|readonly)\s+)*function\s+&?(?P<name>[A-Za-z_]\w*)\s*\(", "not hidden", False))
_RUBY = (("", r"^\s*(?P<kind>class|module)\s+(?P<name>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)", "yes", True), ("function", r"^\s*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[!?=]?)", "yes", False))
_SWIFT = (("", r"^\s*(?:(?:public|open|internal|private|fileprivate|final|indirect)\s+)*(?P<kind>class|struct|protocol|enum|actor|extension)\s+(?P<name>[A-Za-z_]\w*)", "has public|open", True), ("function", r"^\s*(?:(?:public|open|internal|private|fileprivate|static|class|final|override|mutating|nonmutating|required|convenience)\s+)*(?:async\s+)?func\s+(?P<name>[A-Za-z_]\w*)\s*\(", "has public|open", False))
PATTERNS = {"go": _GO, "typescript": _SCRIPT, "javascript": _SCRIPT, "java": _JAVA, "kotlin": _KOTLIN, "python": _PYTHON, "c": _C, "cpp": _C, "csharp": _CSHARP, "rust": _RUST, "php": _PHP, "ruby": _RUBY, "swift": _SWIFT}
CALL = r"\b([A-Za-z_$][\w$]*)\s*\("
NO_CALLS = frozenset("if for while switch catch return new sizeof typeof func function".split())
NO_DECLARATIONS = ("return ", "throw ", "if ", "if(", "for ", "for(", "while ", "while(", "switch ", "switch(", "catch ", "catch(", "case ", "else ", "new ", "delete ")
TYPE_KINDS = frozenset("struct union record type object actor extension".split())
C_FAMILY, ONE_TYPE_KIND = frozenset(("c", "cpp", "csharp")), frozenset(("c", "cpp", "csharp", "rust", "php", "swift"))
_CONTROL = re.compile(r"\b(if|for|while|switch|catch)\s*\(")
_RUBY_OPENS = re.compile(r"^\s*(?:class|module|def|if|unless|case|begin|while|until|for)\b|\bdo\s*(?:\|[^|]*\|)?\s*$")
#: Lines that a block is followed, and its length where no end is found.
BRACE_LINES, RUBY_LINES, ELSE_LINES = 1000, 500, 200

_COMPILED = {k: [(kind, re.compile(p), rule, box) for kind, p, rule, box in v] for k, v in PATTERNS.items()}
_CALL = re.compile(CALL)


def arity(line: str) -> int:
    """Arguments between the first bracket and the last: commas outside inner brackets, and one."""
    a, b = line.find("("), line.rfind(")")
    inner = line[a + 1 : b] if 0 <= a < b else ""
    depth, n = 0, 1
    for c in inner:
        depth = depth + 1 if c in "<[(" else max(0, depth - 1) if c in ">])" else depth
        n += c == "," and depth == 0
    return n if inner.strip() else 0


def without_comment(language: str, line: str) -> str:
    marks = {"python": "#", "ruby": "#", "php": "#"}
    if language in marks:
        line = line.split(marks[language], 1)[0]
    return line if language in ("python", "ruby") else line.split("//", 1)[0]


class _Ends:
    """Where blocks of one file end."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        opens, closes = (np.array([x.count(c) for x in lines]) for c in "{}")
        self.opened, self.depth = np.flatnonzero(opens), np.cumsum(opens - closes)

    def braces(self, at: int) -> int:
        limit = min(len(self.lines), at + BRACE_LINES)
        k = np.searchsorted(self.opened, at)
        if k < len(self.opened) and self.opened[k] < limit:
            before = self.depth[at - 1] if at else 0
            done = np.flatnonzero(self.depth[self.opened[k] : limit] <= before)
            if len(done):
                return int(self.opened[k] + done[0] + 1)
        return min(len(self.lines), at + ELSE_LINES)

    def indent(self, at: int) -> int:
        margin = lambda x: len(x) - len(x.lstrip())
        own = margin(self.lines[at])
        for k in range(at + 1, len(self.lines)):
            line = self.lines[k]
            if line.strip() and not line.lstrip().startswith("#") and margin(line) <= own:
                return k
        return len(self.lines)

    def ruby(self, at: int) -> int:
        depth = 0
        for k in range(at, min(len(self.lines), at + RUBY_LINES)):
            line = without_comment("ruby", self.lines[k])
            depth += bool(_RUBY_OPENS.search(line))
            if line.lstrip().startswith("end"):
                depth -= 1
                if depth <= 0:
                    return k + 1
        return min(len(self.lines), at + ELSE_LINES)

    def of(self, at: int) -> int:
        text = self.lines[at].strip()
        if text.startswith(("def ", "async def ")) or (text.startswith("class ") and self.lines[at].endswith(":")):
            return self.indent(at)
        return self.ruby(at) if text.startswith(("class ", "module ")) else self.braces(at)


def _declared(language: str, line: str):
    for kind, pattern, rule, box in _COMPILED[language]:
        if (m := pattern.search(line)) is None:
            continue
        if kind == "function" and ((language in ("java", "kotlin") and _CONTROL.search(line)) or (language in C_FAMILY and line.lstrip().startswith(NO_DECLARATIONS))):
            continue
        found = m.groupdict()
        kind, name = kind or found["kind"], found["name"]
        kind = "type" if language in ONE_TYPE_KIND and kind in TYPE_KINDS else kind
        exported = {"yes": True, "no": False, "upper": name[:1].isupper(), "not _": not name.startswith("_"), "not hidden": "private" not in line and "protected" not in line}.get(rule)
        if exported is None:
            exported = any(w in line for w in rule.removeprefix("has ").split("|"))
        owner = found.get("owner")
        return kind, name, f"{owner}.{name}" if owner else name, exported, kind not in ("function", "type") if box is None else box
    return None


def parse(path: str, language: str, content: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols (stable_key, kind, name, qualified_name, start_line, end_line, signature, content_hash, exported) and
    calls (from_key, to_key, confidence, source_line) of one file; of equal ones the first stays."""
    lines = re.split(r"\r\n|[\n\x0b\x0c\r\x85  ]", content)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    symbols = {f"{language}:{path}:file:$module": ("file", path.rsplit("/", 1)[-1], "$module", 1, max(1, len(lines)), path, sha(content), True)}
    ends, open_blocks, by_name, bodies = _Ends(lines), [], {}, []
    for at, line in enumerate(lines):
        if (found := _declared(language, line)) is None:
            continue
        kind, name, qualified, exported, box = found
        end = ends.of(at)
        around = next((q for q, start, stop, holds in reversed(open_blocks) if holds and start < at + 1 <= stop), None)
        qualified = f"{around}.{name}" if around else qualified
        if kind == "function" and qualified != name:
            kind = "method"
        open_blocks.append((qualified, at + 1, end, box))
        key = f"{language}:{path}:{kind}:{qualified}" + (f"/{arity(line)}" if kind in ("function", "method") else "")
        symbols.setdefault(key, (kind, name, qualified, at + 1, end, line.strip(), sha("\n".join(lines[at:end])), exported))
        by_name.setdefault(name, []).append(key)
        bodies.append((key, name, at, end))
    calls: dict[tuple, float] = {}
    for key, own, start, end in bodies:
        for k in range(start, min(end, len(lines))):
            for name in _CALL.findall(without_comment(language, lines[k])):
                if name != own and name not in NO_CALLS:
                    to = by_name.get(name, [])
                    calls.setdefault((key, to[0] if len(to) == 1 else f"unresolved:{name}", k + 1), 0.9 if len(to) == 1 else 0.4)
    return [(k, *v) for k, v in symbols.items()], [(a, b, c, line) for (a, b, line), c in calls.items()]


_SYMBOL = "path string, language string, stable_key string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, content_hash string, exported boolean"
_CALLS = "path string, from_key string, to_key string, confidence double, source_line int"


def _rows(files: DataFrame, schema: str, pick) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for p, g, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for r in pick(p, g, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    source = files.select("path", language_of_path(F.col("path")).alias("language"), "content").filter("language IS NOT NULL AND content IS NOT NULL")
    return source.mapInArrow(run, schema)


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files`` (path, content); files of other languages and without content have none."""
    return _rows(files, _SYMBOL, lambda p, g, c: [(p, g, *x) for x in parse(p, g, c)[0]])


def extract_calls(files: DataFrame) -> DataFrame:
    """Call edges of ``files`` (path, content); a name that isn't the file's only one of its kind stays unresolved."""
    return _rows(files, _CALLS, lambda p, g, c: [(p, *x) for x in parse(p, g, c)[1]])
