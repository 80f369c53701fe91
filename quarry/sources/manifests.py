"""Dependency manifests and lock files: content to resolved packages.

Each parser is a function from content to (ecosystem, name, version, direct, scope) rows.  A manifest that can't be read
gives no rows.  Lines are attributed afterwards, by the first line that holds the name.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Row = tuple[str, str, str, bool, str]


def npm_lock(text: str) -> list[Row]:
    """package-lock 1 to 3 and shrinkwrap: by install path; links and workspace entries left out (M1)."""
    doc = json.loads(text)
    found: dict[tuple[str, str], list] = {}

    def add(name: str, version: str, direct: bool, dev: bool) -> None:
        row = found.setdefault((name, version), [direct, dev])
        row[0] |= direct
        row[1] &= dev  # production wins

    if isinstance(doc.get("packages"), dict):
        declared = set()
        for path, p in doc["packages"].items():
            if "node_modules/" not in path:
                for part in ("dependencies", "devDependencies", "optionalDependencies"):
                    declared |= set(p.get(part) or {})
        for path, p in doc["packages"].items():
            if "node_modules/" not in path or p.get("link") or not p.get("version"):
                continue
            name = p.get("name") or path.rpartition("node_modules/")[2]
            add(name, p["version"], name in declared and path.count("node_modules/") == 1, bool(p.get("dev")))
    else:

        def walk(deps: dict, top: bool) -> None:
            for name, p in (deps or {}).items():
                if p.get("version"):
                    add(name, p["version"], top, bool(p.get("dev")))
                walk(p.get("dependencies"), False)

        walk(doc.get("dependencies"), True)
    return [("npm", n, v, d, "dev" if dev else "prod") for (n, v), (d, dev) in found.items()]


def yarn_lock(text: str) -> list[Row]:
    """yarn.lock, classic and berry: the first descriptor's name before its last at sign (M2)."""
    out = []
    for block in re.split(r"\n(?=\S)", text):
        head = block.split("\n", 1)[0]
        if head.startswith("#") or head.startswith("__metadata") or not head.rstrip().endswith(":"):
            continue
        name = head.rstrip(": \n").split(",")[0].strip().strip('"')
        name = name[: name.rfind("@")] if name.rfind("@") > 0 else name
        version = re.search(r'^\s+version:?\s+"?([^"\s]+)"?', block, re.M)
        if version and "@workspace:" not in head:
            out.append(("npm", name, version[1], False, "unknown"))
    return out


def pnpm_lock(text: str) -> list[Row]:
    """pnpm-lock: keys under packages, without the suffix of peers (M3)."""
    out, inside = [], False
    for line in text.split("\n"):
        if re.match(r"\S", line):
            inside = line.startswith("packages:")
        elif inside and (m := re.match(r"  ['\"]?/?((?:@[^/@'\"]+/)?[^/@'\"(]+)[@/]([^('\":_]+)[^:]*['\"]?:", line)):
            out.append(("npm", m[1], m[2], False, "unknown"))
    return out


def package_json(text: str) -> list[Row]:
    """package.json: exact versions alone (M4)."""
    doc, out = json.loads(text), []
    for part, scope in (("dependencies", "prod"), ("optionalDependencies", "prod"), ("devDependencies", "dev")):
        out += [("npm", n, v, True, scope) for n, v in (doc.get(part) or {}).items() if re.fullmatch(r"\d+\.\d+\.\d+(?:[-+][\w.+-]+)?", str(v))]
    return out


def requirements(text: str) -> list[Row]:
    """requirements.txt: pins by == without wildcards (M5)."""
    out = []
    for line in text.split("\n"):
        line = line.split("#", 1)[0].strip()
        m = re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*==\s*([^\s;,*]+)\s*(?:;.*)?$", line)
        if m and not line.startswith("-"):
            out.append(("PyPI", m[1], m[2], True, "prod"))
    return out


def pipfile_lock(text: str) -> list[Row]:
    """Pipfile.lock: default and develop (M6)."""
    doc, out = json.loads(text), []
    for part, scope in (("default", "prod"), ("develop", "dev")):
        out += [("PyPI", n, p["version"].removeprefix("=="), False, scope) for n, p in (doc.get(part) or {}).items() if isinstance(p, dict) and p.get("version")]
    return out


def toml_packages(text: str) -> list[tuple[str, str]]:
    """(name, version) of the [[package]] blocks; any other header ends a block."""
    out, name, version, inside = [], None, None, False
    for line in [*text.split("\n"), "[end]"]:
        if line.startswith("["):
            if inside and name and version:
                out.append((name, version))
            name = version = None
            inside = line.strip() == "[[package]]"
        elif inside and (m := re.match(r'(name|version)\s*=\s*"([^"]*)"', line)):
            name, version = (m[2], version) if m[1] == "name" else (name, m[2])
    return out


def poetry_lock(text: str) -> list[Row]:
    """poetry.lock (M7)."""
    return [("PyPI", n, v, False, "unknown") for n, v in toml_packages(text)]


def go_mod(text: str) -> list[Row]:
    """go.mod: single and block requirements; marked indirect ones aren't direct (M8)."""
    out, inside = [], False
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("require ("):
            inside = True
        elif inside and s == ")":
            inside = False
        elif m := re.match(r"(?:require\s+)?(\S+)\s+v(\S+)", s) if inside or s.startswith("require ") else None:
            out.append(("Go", m[1], m[2], "// indirect" not in s, "prod"))
    return out


def cargo_lock(text: str) -> list[Row]:
    """Cargo.lock (M9)."""
    return [("crates.io", n, v, False, "unknown") for n, v in toml_packages(text)]


def gemfile_lock(text: str) -> list[Row]:
    """Gemfile.lock: entries of four spaces under specs; direct ones are under DEPENDENCIES."""
    out, part, direct = [], "", set()
    for line in text.split("\n"):
        if re.match(r"\S", line):
            part = line.strip()
        elif part == "DEPENDENCIES" and (m := re.match(r"  ([^\s!(]+)", line)):
            direct.add(m[1])
    part, specs = "", False
    for line in text.split("\n"):
        if re.match(r"\S", line):
            part, specs = line.strip(), False
        elif line.strip() == "specs:":
            specs = True
        elif specs and (m := re.match(r"    (\S+) \(([^)]+)\)", line)):
            out.append(("RubyGems", m[1], m[2], m[1] in direct, "prod"))
    return out


def composer_lock(text: str) -> list[Row]:
    """composer.lock: packages and packages-dev, without the v."""
    doc, out = json.loads(text), []
    for part, scope in (("packages", "prod"), ("packages-dev", "dev")):
        out += [("Packagist", p["name"], re.sub(r"^v(?=\d)", "", p["version"]), False, scope) for p in doc.get(part) or [] if p.get("name") and p.get("version")]
    return out


def pyproject(text: str) -> list[Row]:
    """pyproject.toml: pins by == in its dependencies."""
    doc = tomllib.loads(text)
    return requirements("\n".join(doc.get("project", {}).get("dependencies") or []))


PARSERS: dict[str, Callable[[str], list[Row]]] = {
    "package-lock.json": npm_lock, "npm-shrinkwrap.json": npm_lock, "yarn.lock": yarn_lock, "pnpm-lock.yaml": pnpm_lock, "package.json": package_json,
    "pipfile.lock": pipfile_lock, "poetry.lock": poetry_lock, "go.mod": go_mod, "cargo.lock": cargo_lock, "gemfile.lock": gemfile_lock,
    "composer.lock": composer_lock, "pyproject.toml": pyproject,
}


def parse(path: str, content: str) -> list[tuple[str, str, str, bool, str, int | None]]:
    """Packages of a manifest with their lines (M13); none if its name is unknown or it can't be read."""
    name = path.rpartition("/")[2].lower()
    parser = PARSERS.get(name) or (requirements if re.fullmatch(r"requirements[\w.-]*\.txt", name) else None)
    if parser is None:
        return []
    try:
        rows = parser(content)
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    lines = content.split("\n")
    return [(*r, next((i for i, x in enumerate(lines, 1) if r[1] in x), None)) for r in dict.fromkeys(rows)]


PACKAGE = "path string, ecosystem string, name string, version string, direct boolean, scope string, line int"


def resolved_packages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Packages of all manifests among the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if p and c for r in parse(p, c)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string()] * 4 + [pa.bool_(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["path", "ecosystem", "name", "version", "direct", "scope", "line"])

    return files.select(path, content).mapInArrow(run, PACKAGE)
