"""Text to rows: chunks, symbols, imports, routes, calls and project facts.

What needs a scanner with state goes through Python in Arrow batches, one file at a time; the rest is column expressions.
Python is parsed by its own grammar; other languages by patterns and a scanner of blocks, which is an approximation.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Symbol(NamedTuple):
    name: str
    kind: str
    parent: str | None
    start: int
    end: int
    exported: bool
    is_async: bool


class Import(NamedTuple):
    specifier: str
    names: tuple[str, ...]
    line: int


# -- blocks (E4) -------------------------------------------------------------------------------------------------------


def end_by_indent(lines: list[str], at: int) -> int:
    """The last line (from 1) of the block that line ``at`` (from 1) opens, by indent."""
    indent, last = len(lines[at - 1]) - len(lines[at - 1].lstrip()), at
    for i in range(at, len(lines)):
        if lines[i].strip():
            if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                break
            last = i + 1
    return last


def end_by_keyword(lines: list[str], at: int) -> int:
    """The same where blocks close with the word end."""
    depth = 0
    for i in range(at - 1, len(lines)):
        s = lines[i].strip()
        if re.match(r"(?:def|class|module|if|unless|while|until|case|begin|for)\b", s) or re.search(r"\bdo\b(?:\s*\|[^|]*\|)?\s*$", s):
            depth += 1
        if re.match(r"end\b", s):
            depth -= 1
            if depth <= 0:
                return i + 1
    return len(lines)


def end_by_braces(lines: list[str], at: int) -> int:
    """The same by braces, outside strings and comments; a line without a block ends itself."""
    depth, opened, quote, comment = 0, False, "", False
    for i in range(at - 1, len(lines)):
        line, j = lines[i], 0
        while j < len(line):
            c, two = line[j], line[j : j + 2]
            if comment:
                if two == "*/":
                    comment, j = False, j + 1
            elif quote:
                if c == "\\":
                    j += 1
                elif c == quote:
                    quote = ""
            elif two == "//":
                break
            elif two == "/*":
                comment, j = True, j + 1
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return i + 1
            elif c == ";" and not opened and depth == 0:
                return i + 1
            j += 1
        if quote in "\"'":
            quote = ""
        if not opened and i - at >= 8:
            return at
    return len(lines)


# -- symbols and imports (E2, E3, E5, E6) ------------------------------------------------------------------------------

_BRACES = "braces"
#: By family of languages: how blocks end, and patterns by kind whose group 1 is the name.
GRAMMARS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "js": (_BRACES, [
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
        ("interface", r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)"),
        ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="),
        ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
        ("function", r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"),
        ("method", r"^\s+(?:(?:public|private|protected|static|readonly|override)\s+)*(?:async\s+)?\*?([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^;{]+)?\{\s*$"),
    ]),
    "go": (_BRACES, [
        ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("type", r"^type\s+(\w+)\s+(?!struct|interface)\w"),
        ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*[\[(]"), ("function", r"^func\s+(\w+)\s*[\[(]"),
    ]),
    "java": (_BRACES, [
        ("class", r"^\s*(?:(?:public|private|protected|abstract|final|static|sealed|data|open)\s+)*(?:class|record|object)\s+(\w+)"),
        ("interface", r"^\s*(?:(?:public|private|protected)\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|protected)\s+)*enum\s+(?:class\s+)?(\w+)"),
        ("method", r"^\s+(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|override|suspend|async|virtual|internal)\s+)+(?:fun\s+)?(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^;]*$"),
        ("function", r"^\s*(?:suspend\s+)?fun\s+(\w+)\s*\("),
    ]),
    "rust": (_BRACES, [
        ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"),
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"),
    ]),
    "php": (_BRACES, [
        ("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:interface|trait)\s+(\w+)"),
        ("function", r"^\s*(?:(?:public|private|protected|static|final)\s+)*function\s+&?(\w+)"),
    ]),
    "c": (_BRACES, [("struct", r"^\s*(?:typedef\s+)?(?:struct|class)\s+(\w+)\s*[:{]"), ("function", r"^(?!\s)(?:[\w*&:<>,]+\s+)+[*&]?(\w+(?:::\w+)?)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$")]),
    "ruby": ("keyword", [("class", r"^\s*class\s+([A-Z]\w*)"), ("module", r"^\s*module\s+([A-Z]\w*)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")]),
    "elixir": ("keyword", [("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+(\w+[?!]?)")]),
    "shell": (_BRACES, [("function", r"^\s*(?:function\s+)?(\w[\w-]*)\s*\(\)\s*\{")]),
    "python": ("indent", [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")]),
}
FAMILY = {
    **dict.fromkeys(["javascript", "typescript", "jsx", "tsx", "vue", "svelte", "dart"], "js"), "go": "go",
    **dict.fromkeys(["java", "kotlin", "scala", "csharp", "swift", "groovy"], "java"), "rust": "rust", "php": "php",
    **dict.fromkeys(["c", "cpp"], "c"), "ruby": "ruby", "elixir": "elixir", "shell": "shell", "python": "python",
}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "with", "else", "do", "new"}
IMPORTS = {
    "js": [r"""^\s*import\s+(?:type\s+)?(?:([^;'"]+?)\s+from\s+)?["']([^"']+)["']""", r"""^\s*export\s+(?:\*|\{()[^}]*\})\s+from\s+["']([^"']+)["']""", r"""(?:const|let|var)\s+([\w${},\s]+?)\s*=\s*require\(\s*["']([^"']+)["']\s*\)""", r"""\bimport\(()\s*["']([^"']+)["']\s*\)"""],
    "go": [r"""^import\s+()(?:\w+\s+)?"([^"]+)\"""", r"""^\s+()(?:[\w.]+\s+)?"([^"]+)"\s*$"""],
    "java": [r"^\s*(?:import|using)\s+()(?:static\s+)?([\w.*]+)\s*;?\s*$"], "rust": [r"^\s*(?:pub\s+)?use\s+()([\w:]+)"],
    "php": [r"^\s*use\s+()([\w\\]+)", r"""\b(?:require|include)(?:_once)?\s*\(?()\s*["']([^"']+)["']"""], "c": [r"""^\s*#include\s+()[<"]([^>"]+)[>"]"""],
    "ruby": [r"""^\s*require(?:_relative)?\s+()["']([^"']+)["']"""], "elixir": [r"^\s*(?:import|alias|use)\s+()([\w.]+)"], "shell": [r"^\s*(?:source|\.)\s+()(\S+)"],
    "python": [r"^\s*from\s+()([\w.]+)\s+import\b", r"^\s*import\s+()([\w.]+)"],
}


def _python(content: str) -> tuple[list[Symbol], list[Import]]:
    symbols: list[Symbol] = []
    imports: list[Import] = []

    def walk(node: ast.AST, parent: str | None, in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if in_class else "function"
                symbols.append(Symbol(n.name, kind, parent, start, n.end_lineno, not n.name.startswith("_"), isinstance(n, ast.AsyncFunctionDef)))
                walk(n, n.name, isinstance(n, ast.ClassDef))
            else:
                if isinstance(n, ast.Import):
                    imports.extend(Import(a.name, (a.asname or a.name.split(".")[0],), n.lineno) for a in n.names)
                elif isinstance(n, ast.ImportFrom):
                    imports.append(Import("." * n.level + (n.module or ""), tuple(a.asname or a.name for a in n.names), n.lineno))
                walk(n, parent, in_class)

    walk(ast.parse(content), None, False)
    return symbols, imports


def parse_file(language: str | None, content: str) -> tuple[list[Symbol], list[Import]]:
    """Symbols and imports of a file; an unknown language has none, Python that doesn't parse goes by patterns."""
    family = FAMILY.get(language or "")
    if not family:
        return [], []
    if family == "python":
        try:
            return _python(content)
        except (SyntaxError, ValueError, RecursionError):
            pass
    ends, patterns = GRAMMARS[family]
    compiled = [(k, re.compile(p)) for k, p in patterns]
    lines, symbols = content.split("\n"), []
    end = {"indent": end_by_indent, "keyword": end_by_keyword, _BRACES: end_by_braces}[ends]
    for i, line in enumerate(lines, 1):
        if line.lstrip().startswith(("//", "*", "/*")) or (ends != _BRACES and line.lstrip().startswith("#")):
            continue
        for kind, p in compiled:
            m = p.match(line)
            if m and m[1] not in _NOT_NAMES:
                exported = bool(re.search(r"\b(?:export|pub|public)\b", line)) or (family == "go" and m[1][0].isupper()) or (family in ("python", "ruby") and not m[1].startswith("_"))
                symbols.append([m[1], kind, None, i, end(lines, i), exported, bool(re.search(r"\b(?:async|suspend)\b", line))])
                break
    for s in symbols:  # the innermost type around a symbol is its parent
        around = [t for t in symbols if t is not s and t[1] in ("class", "struct", "interface", "module", "enum") and t[3] <= s[3] and s[4] <= t[4]]
        if around:
            s[2] = max(around, key=lambda t: t[3])[0]
            if s[1] == "function" and family in ("python", "php", "rust", "ruby", "java"):
                s[1] = "method"
    imports, seen = [], set()
    for p in IMPORTS.get(family, []):
        for m in re.finditer(p, content, re.M):
            if (m[2], family) not in seen:
                seen.add((m[2], family))
                names = tuple(x for x in re.findall(r"[\w$]+", m[1] or "") if x not in ("as", "type"))
                imports.append(Import(m[2], names, content.count("\n", 0, m.start(2)) + 1))
    return [Symbol(*s) for s in symbols if not (s[1] == "method" and s[2] is None and family == "js")], sorted(imports, key=lambda x: x.line)


SYMBOL = "path string, name string, kind string, parent string, start_line int, end_line int, exported boolean, is_async boolean, complexity int"
IMPORT = "path string, specifier string, names array<string>, line int"
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|elif|except|when)\b|&&|\|\||\?(?![.?:])")


def _rows(files: DataFrame, schema: str, types: list, f) -> DataFrame:
    """Rows of ``f(path, language, content)`` for every file."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for path, lang, content in zip(*(c.to_pylist() for c in b.columns), strict=True) if content is not None for r in f(path, lang, content)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return files.select("path", "language", "content").mapInArrow(run, schema)


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()


#: Parsers of a caller's own by language: from a content to its symbols and imports.
Parsers = dict[str, Callable[[str], tuple[list[Symbol], list[Import]]]]


def _parser(own: Parsers | None) -> Callable[[str | None, str], tuple[list[Symbol], list[Import]]]:
    """``parse_file``, or for the languages of ``own`` what they name; they go to the executors with the function."""
    own = dict(own or {})
    return lambda lang, content: own[lang](content) if lang in own else parse_file(lang, content)


def symbols(files: DataFrame, parsers: Parsers | None = None) -> DataFrame:
    """All symbols, each with its cyclomatic approximation."""
    parse = _parser(parsers)

    def f(path, lang, content):
        lines = content.split("\n")
        for s in parse(lang, content)[0]:
            yield (path, s.name, s.kind, s.parent, s.start, s.end, s.exported, s.is_async, 1 + len(_BRANCH.findall("\n".join(lines[s.start - 1 : s.end]))))

    return _rows(files, SYMBOL, [_S, _S, _S, _S, _I, _I, _B, _B, _I], f)


def imports(files: DataFrame, parsers: Parsers | None = None) -> DataFrame:
    """All imports, each specifier once a file."""
    parse = _parser(parsers)
    return _rows(files, IMPORT, [_S, _S, pa.list_(_S), _I], lambda path, lang, content: [(path, i.specifier, list(i.names), i.line) for i in parse(lang, content)[1]])


# -- chunks (E1) -------------------------------------------------------------------------------------------------------

LARGEST, WINDOW, OVERLAP, LEAST_GAP, SPLIT_CLASS = 220, 160, 20, 3, 120


def chunk_file(content: str, found: list[Symbol]) -> list[tuple]:
    """(symbol, kind, start, end, text, tokens, hash) of a file's chunks.

    Methods stand alone only where their class is over SPLIT_CLASS lines, and then the class doesn't; a symbol within
    another that fits in a chunk goes.  What is left is cut into windows where too long, gaps of LEAST_GAP lines or more
    become module chunks, blank and repeated chunks go.
    """
    if not content.strip():
        return []
    lines = content.split("\n")
    types = ("class", "struct")
    big = {s.name for s in found if s.kind in types and s.end - s.start + 1 > SPLIT_CLASS}
    chosen = [s for s in found if not (s.kind in types and s.name in big) and not (s.kind == "method" and s.parent is not None and s.parent not in big)]
    kept: list[Symbol] = []
    for i, s in enumerate(chosen):
        inside = any(
            o.start <= s.start and s.end <= o.end and o.end - o.start <= LARGEST and ((o.start, o.end) != (s.start, s.end) or j < i)
            for j, o in enumerate(chosen) if j != i
        )
        if not inside:
            kept.append(s)
    parts: list[tuple[str | None, str, int, int]] = []

    def emit(name: str | None, kind: str, a: int, b: int) -> None:
        b = min(b, len(lines))
        if b - a + 1 <= LARGEST:
            parts.append((name, kind, a, b))
            return
        at = a
        while True:
            parts.append((name, kind, at, min(at + WINDOW - 1, b)))
            if at + WINDOW - 1 >= b:
                break
            at += WINDOW - OVERLAP

    for s in kept:
        emit(s.name, s.kind, s.start, s.end)
    covered = 0
    for a, b in sorted((s.start, s.end) for s in kept):
        if a - covered - 1 >= LEAST_GAP:
            emit(None, "module", covered + 1, a - 1)
        covered = max(covered, b)
    if len(lines) - covered >= (LEAST_GAP if kept else 1):
        emit(None, "module", covered + 1, len(lines))
    out, seen = [], set()
    for name, kind, a, b in sorted(parts, key=lambda p: (p[2], p[3])):
        text = "\n".join(lines[a - 1 : b])
        h = hashlib.sha256(f"{a}:{b}:{text}".encode()).hexdigest()
        if text.strip() and h not in seen:
            seen.add(h)
            out.append((name, kind, a, b, text, -(-len(text) * 10 // 36), h))
    return out


CHUNK = "path string, symbol string, kind string, start_line int, end_line int, content string, tokens int, hash string"


def chunks(files: DataFrame, parsers: Parsers | None = None) -> DataFrame:
    """The chunks of all files."""
    parse = _parser(parsers)
    return _rows(files, CHUNK, [_S, _S, _S, _I, _I, _S, _I, _S], lambda path, lang, content: [(path, *c) for c in chunk_file(content, parse(lang, content)[0])])


def windows(df: DataFrame, id_col: str, n_lines: Column, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(id, start, end): line windows of texts of n lines, native."""
    step = size - overlap
    starts = F.filter(F.sequence(F.lit(1), n_lines, F.lit(step)), lambda x: (x == 1) | (x - step + size - 1 < n_lines))
    return df.where(n_lines > 0).select(id_col, F.explode(starts).alias("start"), n_lines.alias("_n")).select(id_col, "start", F.least(F.col("start") + size - 1, F.col("_n")).alias("end"))


# -- routes and calls (E7, E8) -----------------------------------------------------------------------------------------

#: The verbs of HTTP, and how frameworks that name them otherwise do.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
#: What routes are declared on, by convention: variables of an application, a router or a blueprint.
EXPRESS, FASTIFY, FASTAPI, FLASK = {"app", "router", "server", "api"}, {"fastify", "instance", "server"}, {"app", "router", "api"}, {"app", "bp", "blueprint"}

_HEAD = re.compile(r"(?<![\w$.])(?P<mark>@?)(?P<name>(?:[A-Za-z_$][\w$]*\.|\.)*[A-Za-z_$][\w$]*)[ \t]*(?:<[^()<>]*>)?[ \t]*\(")
#: Names that may declare a route; the arguments of others aren't read.
_MAYBE = re.compile(f"(?i)(?:{'|'.join(VERBS)}|all|any|route|path|re_path|HandleFunc|(?:Http|Map)(?:{'|'.join(VERBS)})|(?:{'|'.join(VERBS)}|Request)Mapping)$")
_KEY = re.compile(r"""["']?([A-Za-z_]\w*)["']?\s*(?:=(?![=>])|:(?!:))\s*""")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: Characters of an argument list that are read at most, and brackets within brackets.
_ARGUMENTS, _DEPTH = 4000, 40


class Arguments:
    """What stands between brackets: values in order and by name; a value is a text, another list, or None for anything else."""

    def __init__(self, text: str, at: int, end: int, close: str = ")", depth: int = 0):
        self.depth = depth
        self.values: list = []
        self.named: dict = {}
        self.count = 0
        while at < end:
            while at < end and text[at] in " \t\r\n,":
                at += 1
            if at >= end or text[at] == close:
                break
            key = _KEY.match(text, at)
            value, at = self._value(text, key.end() if key else at, end, close)
            self.count += 1
            if key:
                self.named.setdefault(key[1], value)
            else:
                self.values.append(value)
        self.end = at + 1

    def _value(self, text: str, at: int, end: int, close: str):
        quoted = re.compile(r"""[rbfuRBFU]{0,2}(["'`])((?:\\.|(?!\1)[^\\])*)\1""", re.S).match(text, at, end)
        if quoted:
            value, at = quoted[2], quoted.end()
        elif at < end and text[at] in _CLOSE and self.depth < _DEPTH:
            value = Arguments(text, at + 1, end, _CLOSE[text[at]], self.depth + 1)
            at = value.end
        else:
            word = re.compile(r"[\w$.]*").match(text, at, end)
            value, at = (Word(word[0]) if word[0] else None), word.end()
        start = at
        while at < end and text[at] not in "," + close:  # what else belongs to the value
            if text[at] in _CLOSE and self.depth < _DEPTH:
                at = Arguments(text, at + 1, end, _CLOSE[text[at]], self.depth + 1).end
            elif text[at] in "\"'`" and (more := re.compile(r"""(["'`])(?:\\.|(?!\1)[^\\])*\1""", re.S).match(text, at, end)):
                at = more.end()
            else:
                at += 1
        return (value if not text[start:at].strip() else None), max(at, start)

    def text(self, *names: str) -> str | None:
        """The text that comes first, or under the first of these names that there is; of a list of texts its first."""
        of = [self.named[n] for n in names if n in self.named] or self.values
        one = of[0] if of else None
        if isinstance(one, Arguments):
            one = one.values[0] if one.values else None
        return one if isinstance(one, str) and not isinstance(one, Word) else None

    def words(self, name: str) -> list[str]:
        """The texts or last parts of names under ``name``."""
        one = self.named.get(name)
        every = one.values if isinstance(one, Arguments) else [one]
        return [x.rpartition(".")[2] for x in every if isinstance(x, str)]


class Word(str):
    """A value that is a name, not a text."""


def _js_route(mark: str, on: str, name: str, args: Arguments):
    path = args.text()
    if mark and name.lower() in (*VERBS, "all") and name[0].isupper() and (path is not None or not args.count):
        return "nest", [name], path or ""
    if name in (*VERBS, "all") and path is not None and path.startswith("/"):
        if on in EXPRESS:
            return "express", [name], path
        if on in FASTIFY:
            return "fastify", [name], path
    if name == "route" and args.values and isinstance(args.values[0], Arguments):
        own = args.values[0]
        url = own.text("url") if "url" in own.named else None
        if own.words("method") and url is not None:
            return "fastify-object", own.words("method"), url
    return None


def _python_route(mark: str, on: str, name: str, args: Arguments):
    path = args.text("rule", "path")
    if mark and name in VERBS and on in FASTAPI and path is not None:
        return "fastapi", [name], path
    if mark and name == "route" and (on in FLASK or on.endswith("_bp")) and path is not None:
        return "flask", args.words("methods") or ["get"], path
    if not mark and not on and name in ("path", "re_path") and path is not None and args.count > 1:
        return "django", ["any"], path
    return None


def _java_route(mark: str, on: str, name: str, args: Arguments):
    path = args.text("value", "path")
    if mark and name.endswith("Mapping") and name[:-7].lower() in (*VERBS, "request") and path is not None:
        return "spring", args.words("method") or ["any" if name[:-7] == "Request" else name[:-7]], path
    if name.startswith("Http") and name[4:].lower() in VERBS and not on:
        return "aspnet", [name[4:]], args.text() or ""
    if name.startswith("Map") and name[3:].lower() in VERBS and args.text() is not None:
        return "aspnet-minimal", [name[3:]], args.text()
    return None


def _go_route(mark: str, on: str, name: str, args: Arguments):
    path = args.text()
    if path is None:
        return None
    if name == "HandleFunc":
        verb, _, rest = path.rpartition(" ")
        return ("net-http", [verb or "any"], rest) if rest.startswith("/") else None
    if (name == "Any" or name.lower() in VERBS and name.isupper()) and path.startswith("/"):
        return "gin", [name], path
    return None


_ROUTE = {"js": _js_route, "python": _python_route, "java": _java_route, "go": _go_route}


def declared_routes(family: str | None, content: str) -> Iterator[tuple[str, list[str], str, int, int]]:
    """(framework, verbs, path, start, end) of each call, decorator, annotation or attribute that declares a route."""
    if family == "ruby":  # a command at the start of a line, with or without brackets
        for m in re.finditer(r"^[ \t]*(" + "|".join(VERBS) + r")[ \t]*[( \t][ \t]*", content, re.M):
            args = Arguments(content, m.end(), min(len(content), (content + "\n").index("\n", m.end())))
            if args.text():
                yield "rails", [m[1]], args.text(), m.start(), args.end
        return
    if family == "java":  # attributes without an argument list
        for m in re.finditer(r"[\[,]\s*Http([A-Z][a-z]+)\s*(?=[\],])", content):
            if m[1].lower() in VERBS:
                yield "aspnet", [m[1]], "", m.start(), m.end()
    declares = _ROUTE.get(family or "")
    for m in _HEAD.finditer(content) if declares else ():
        on, _, name = m["name"].rpartition(".")
        if not _MAYBE.match(name):
            continue
        args = Arguments(content, m.end(), min(len(content), m.end() + _ARGUMENTS))
        found = declares(m["mark"], on.rpartition(".")[2], name, args)
        if found:
            yield (*found, m.start(), args.end)


_AUTH = re.compile(r"(?i)\b(?:auth\w*|require\w*(?:user|login|auth)\w*|isAuthenticated|protect|guard|jwt|session|login_required|permission\w*|Depends\(\s*get_current\w*|PreAuthorize|before_action)\b")


def detect_routes(language: str | None, content: str) -> list[tuple]:
    """(verb, path, framework, line, has_auth) of the routes that a file declares; several verbs of one are joined by commas."""
    out, seen = [], set()
    for framework, verbs, path, start, end in declared_routes(FAMILY.get(language or ""), content):
        verb = ",".join("ANY" if v.upper() in ("ALL", "ANY") else v.upper() for v in verbs)
        path, line = "/" + path.lstrip("/"), content.count("\n", 0, start) + 1
        if (verb, path, line) in seen:
            continue
        seen.add((verb, path, line))
        out.append((verb, path, framework, line, bool(_AUTH.search(content[max(0, start - 400) : end + 400]))))
    return sorted(out, key=lambda r: r[3])


_CALLS = [
    r"""\bfetch\(\s*(?P<q>["'`])(?P<path>(?:(?!(?P=q)).)+)(?P=q)(?:\s*,\s*\{[^}]*?\bmethod\s*:\s*["'](?P<verb>\w+)["'])?""",
    r"""\b(?:axios|http|api|client|ky|got|\$http)\.(?P<verb>get|post|put|patch|delete)\s*(?:<[^(]*>)?\(\s*(?P<q>["'`])(?P<path>(?:(?!(?P=q)).)+)(?P=q)""",
    r"""\b(?:axios|request|ajax)\s*\(\s*\{[^}]*?\burl\s*:\s*(?P<q>["'`])(?P<path>(?:(?!(?P=q)).)+)(?P=q)(?:[^}]*?\bmethod\s*:\s*["'](?P<verb>\w+)["'])?""",
]


def normalise_call(path: str) -> str:
    """``functions.paths.call_path`` in Python, for one path."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "", path)
    path = re.sub(r"[?#].*$", "", re.sub(r"^\$\{[^}]*\}", "", path))
    path = re.sub(r"/{2,}", "/", "/" + re.sub(r"\$\{[^}]*\}", ":param", path))
    return path if path == "/" else path.rstrip("/")


def detect_calls(language: str | None, content: str) -> list[tuple]:
    """(verb, path, line) of the HTTP calls that a script makes."""
    if FAMILY.get(language or "") != "js":
        return []
    out = {}
    for p in _CALLS:
        for m in re.finditer(p, content, re.S):
            raw = m["path"]
            if raw.startswith(("/", "http", "${")):
                out.setdefault(((m["verb"] or "GET").upper(), normalise_call(raw), content.count("\n", 0, m.start()) + 1), None)
    return sorted(out, key=lambda r: (r[2], r[1]))


def routes(files: DataFrame) -> DataFrame:
    return _rows(files, "file_path string, method string, path string, framework string, line int, has_auth boolean", [_S, _S, _S, _S, _I, _B], lambda p, lang, c: [(p, *r) for r in detect_routes(lang, c)])


def http_calls(files: DataFrame) -> DataFrame:
    return _rows(files, "file_path string, verb string, path string, line int", [_S, _S, _S, _I], lambda p, lang, c: [(p, *r) for r in detect_calls(lang, c)])


# -- project facts (E9 to E16) -----------------------------------------------------------------------------------------

ENV_PATTERNS = [
    r"process\.env\.([A-Z][A-Z0-9_]+)", r"process\.env\[[\"']([A-Z][A-Z0-9_]+)[\"']\]", r"import\.meta\.env\.([A-Z][A-Z0-9_]+)",
    r"os\.environ(?:\.get\(|\[)\s*[\"']([A-Z][A-Z0-9_]+)[\"']", r"os\.getenv\(\s*[\"']([A-Z][A-Z0-9_]+)[\"']", r"os\.Getenv\(\s*\"([A-Z][A-Z0-9_]+)\"",
    r"System\.getenv\(\s*\"([A-Z][A-Z0-9_]+)\"", r"ENV(?:\.fetch\()?\[?[\"']([A-Z][A-Z0-9_]+)[\"']",
]


def env_vars(files: DataFrame, each: int = 6, most: int = 200) -> DataFrame:
    """(name, files): environment variables that code reads or a template names."""
    from .aggregates import capped_lists

    found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in ENV_PATTERNS]))
    code = files.select("path", F.explode(found).alias("name"))
    template = files.where(F.col("path").rlike("(?:^|/)\\.env(?:\\.[a-z]+)*\\.?(?:example|sample|template)?$")).select("path", F.explode(F.regexp_extract_all("content", F.lit("(?m)^\\s*(?:export\\s+)?([A-Z][A-Z0-9_]+)\\s*="), F.lit(1))).alias("name"))
    return capped_lists(code.unionByName(template), "name", "path", each, most)


#: Paths of the files that ``scripts``, ``declared_dependencies`` and ``runtimes`` read.
MANIFESTS = (
    "(?:^|/)(?:package\\.json|Makefile|requirements[\\w.-]*\\.txt|go\\.mod|Gemfile|Cargo\\.toml|pom\\.xml|build\\.gradle(?:\\.kts)?|composer\\.json|pyproject\\.toml"
    "|\\.(?:nvmrc|node-version|python-version|ruby-version)|rust-toolchain(?:\\.toml)?)$"
)


def scripts(files: DataFrame, most: int = 200) -> DataFrame:
    """(path, name, command) of package.json scripts and make targets."""
    pk = files.where(F.col("path").rlike("(?:^|/)package\\.json$")).select("path", F.explode(F.from_json("content", "scripts map<string,string>")["scripts"]).alias("name", "command"))
    mk = files.where(F.col("path").rlike("(?:^|/)Makefile$")).select("path", F.explode(F.regexp_extract_all("content", F.lit("(?m)^([A-Za-z][\\w.-]*)\\s*:(?!=)"), F.lit(1))).alias("name"))
    return pk.unionByName(mk.withColumn("command", F.concat(F.lit("make "), "name"))).orderBy("path", "name").limit(most)


def declared_dependencies(files: DataFrame) -> DataFrame:
    """(path, name): dependencies that manifests declare."""
    js = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    keys = lambda c: F.coalesce(F.map_keys(js[c]), F.expr("cast(array() as array<string>)"))
    npm = files.where(F.col("path").rlike("(?:^|/)package\\.json$")).select("path", F.explode(F.array_distinct(F.concat(*[keys(c) for c in ("dependencies", "devDependencies", "peerDependencies")]))).alias("name"))
    by = {
        "requirements[\\w.-]*\\.txt": "(?m)^\\s*([A-Za-z0-9][A-Za-z0-9._-]*)\\s*(?:\\[|[=<>!~;#]|$)", "go\\.mod": "(?m)^\\s*(?:require\\s+)?([a-z0-9.-]+\\.[a-z]{2,}/[^\\s]+)\\s+v", "Gemfile": "(?m)^\\s*gem\\s+[\"']([^\"']+)[\"']",
        "Cargo\\.toml": "(?m)^([a-z0-9_-]+)\\s*=\\s*(?:\"[0-9^~]|\\{)", "pom\\.xml": "<artifactId>([^<]+)</artifactId>", "build\\.gradle(?:\\.kts)?": "(?:implementation|api|testImplementation)\\s*\\(?[\"'][^:\"']+:([^:\"']+)", "composer\\.json": "\"([a-z0-9-]+/[a-z0-9-]+)\"\\s*:", "pyproject\\.toml": "(?m)^\\s*\"([A-Za-z0-9][A-Za-z0-9._-]*)[\\[=<>!~ ]",
    }
    out = npm
    for name, pattern in by.items():
        out = out.unionByName(files.where(F.col("path").rlike(f"(?:^|/){name}$")).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("name")))
    return out


def runtimes(files: DataFrame) -> DataFrame:
    """(runtime, version, path): pinned runtimes, the first of each by path."""
    from .aggregates import prefer

    pins = [("node", "(?:^|/)\\.(?:nvmrc|node-version)$", "v?([0-9][\\w.]*)"), ("node", "(?:^|/)package\\.json$", "\"node\"\\s*:\\s*\"([^\"]+)\""), ("python", "(?:^|/)\\.python-version$", "([0-9][\\w.]*)"), ("python", "(?:^|/)pyproject\\.toml$", "requires-python\\s*=\\s*\"([^\"]+)\""), ("go", "(?:^|/)go\\.mod$", "(?m)^go\\s+([0-9.]+)"), ("ruby", "(?:^|/)\\.ruby-version$", "([0-9][\\w.]*)"), ("java", "(?:^|/)pom\\.xml$", "<java\\.version>([^<]+)<"), ("rust", "(?:^|/)rust-toolchain(?:\\.toml)?$", "(?:channel\\s*=\\s*\")?([0-9a-z][\\w.]*)")]
    out = None
    for i, (name, path, pattern) in enumerate(pins):
        part = files.where(F.col("path").rlike(path)).select(F.lit(name).alias("runtime"), F.regexp_extract("content", pattern, 1).alias("version"), "path", F.lit(i).alias("nth")).where("version <> ''")
        out = part if out is None else out.unionByName(part)
    return prefer(out, ["runtime"], "nth", "path").drop("nth")


def entry_points(files: DataFrame, most: int = 20) -> DataFrame:
    """(path, reason): where a program starts, the first reason wins."""
    from .aggregates import prefer

    named = files.where(F.col("path").rlike("(?:^|/)(?:src/)?(?:index|main|app|server|manage|cli|wsgi)\\.(?:[jt]sx?|py|go|rb)$")).select("path", F.lit("conventional name").alias("reason"), F.lit(1).alias("nth"))
    main = files.where(F.col("path").rlike("(?:^|/)package\\.json$")).select(F.regexp_replace(F.from_json("content", "main string")["main"], "^\\./", "").alias("path"), F.lit("manifest").alias("reason"), F.lit(0).alias("nth")).where("path is not null")
    signal = files.where(F.col("content").rlike("\\.listen\\s*\\(|__name__\\s*==\\s*[\"']__main__|\\bfunc main\\(\\)|createRoot\\s*\\(|public static void main")).select("path", F.lit("start call").alias("reason"), F.lit(2).alias("nth"))
    return prefer(main.unionByName(named).unionByName(signal), ["path"], "nth").orderBy("nth", "path").limit(most).drop("nth")


def project_flags(files: DataFrame) -> DataFrame:
    """One row of what the files say of the project: managers, monorepo, containers, CI, types."""
    has = lambda p: F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False))
    flags = files.agg(
        has("(?:^|/)package\\.json$").alias("npm"), has("(?:^|/)pnpm-lock\\.yaml$").alias("pnpm"), has("(?:^|/)yarn\\.lock$").alias("yarn"), has("(?:^|/)bun\\.lockb?$").alias("bun"),
        has("(?:^|/)(?:requirements[\\w.-]*\\.txt|setup\\.py)$").alias("pip"), has("(?:^|/)poetry\\.lock$").alias("poetry"), has("(?:^|/)go\\.mod$").alias("go"), has("(?:^|/)Cargo\\.toml$").alias("cargo"),
        has("(?:^|/)(?:pnpm-workspace\\.yaml|lerna\\.json|turbo\\.json|nx\\.json)$|^(?:packages|apps)/[^/]+/package\\.json$").alias("monorepo"),
        has("(?:^|/)(?:Dockerfile|docker-compose\\.ya?ml)$").alias("docker"), has("^\\.github/workflows/|(?:^|/)(?:\\.gitlab-ci\\.yml|Jenkinsfile|\\.circleci/config\\.yml)$").alias("ci"),
        has("\\.(?:tsx|jsx|vue|svelte)$").alias("frontend"), has("(?i)(?:^|/)(?:routes?|controllers?|api)/").alias("backend"),
    )
    runner = F.when(F.col("bun"), "bun").when(F.col("pnpm"), "pnpm").when(F.col("yarn"), "yarn").when(F.col("npm"), "npm")
    kinds = F.array_compact(F.array(F.when(F.col("frontend"), "frontend"), F.when(F.col("backend"), "backend"), F.when(F.col("monorepo"), "monorepo")))
    return flags.withColumn("runner", runner).withColumn("types", kinds)


def stack(files: DataFrame) -> DataFrame:
    """(group, name, evidence) of the signatures that declared dependencies support."""
    from quarry.rules.names import SIGNATURES

    from .joins import signature_matches

    rules = files.sparkSession.createDataFrame([(f"{g}:{n}", k, v) for g, n, k, v in SIGNATURES], "rule string, kind string, value string")
    deps = declared_dependencies(files).select(F.col("name").alias("value"), F.concat_ws(" in ", "name", "path").alias("evidence"))
    hits = signature_matches(rules, {"name": deps, "prefix": deps})
    return hits.select(F.split("rule", ":")[0].alias("grp"), F.split("rule", ":")[1].alias("name"), "evidence")


# -- plans, sections (E17 to E20) --------------------------------------------------------------------------------------


def test_plan(target: str, code: str, start: int, most: int = 20) -> list[tuple[str, int, str]]:
    """(kind, line, case) of tests that a function asks for: the happy path, throws, guards, catches, the first await, requests."""
    out: dict[tuple[str, int], tuple] = {("happy", start): ("happy", start, f"{target} gives its result for valid input")}
    awaited = False
    for i, line in enumerate(code.split("\n")):
        n, s = start + i, line.strip()
        if m := re.search(r"\b(?:throw|raise)\s+(?:new\s+)?(\w+)", s):
            out.setdefault(("throws", n), ("throws", n, f"{target} fails with {m[1]}"))
        if m := re.match(r"if\s*\(?\s*(!?[\w.]+(?:\s*(?:===?|!==?|<|>|is)\s*[\w\"'.]+)?)", s):
            out.setdefault(("guard", n), ("guard", n, f"{target} when {m[1].strip()}"))
        if re.search(r"\bcatch\b|\bexcept\b", s):
            out.setdefault(("catch", n), ("catch", n, f"{target} recovers from an error"))
        if re.search(r"\bawait\b", s) and not awaited:
            awaited = True
            out.setdefault(("await", n), ("await", n, f"{target} when what it waits for fails"))
        if re.search(r"\breq(?:uest)?\.(?:body|params|query)", s):
            out.setdefault(("request", n), ("request", n, f"{target} with a malformed request"))
    return list(out.values())[:most]


def test_plans(units: DataFrame) -> DataFrame:
    """Test plans of units (path, language: the target's name, content)."""
    return _rows(units, "path string, kind string, line int, test_case string", [_S, _S, _I, _S], lambda p, target, code: [(p, *t) for t in test_plan(target or p, code, 1)])


def mermaid(edges: DataFrame, most: int = 40) -> DataFrame:
    """One row with a diagram of the strongest edges (from_group, to_group, n, flagged) between groups."""
    from quarry.functions.text import diagram_label

    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    arrow = F.concat(
        F.lit("  "), name("from_group"), F.lit('["'), diagram_label(F.col("from_group")), F.lit('"] '), F.when(F.col("flagged"), "-.->").otherwise("-->"),
        F.lit("|"), F.col("n").cast("string"), F.lit("| "), name("to_group"), F.lit('["'), diagram_label(F.col("to_group")), F.lit('"]'),
    )
    top = edges.orderBy(F.col("n").desc(), "from_group", "to_group").limit(most)
    return top.agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "from_group", "to_group", arrow.alias("line")))), lambda x: x["line"]), "\n")).alias("diagram"))
