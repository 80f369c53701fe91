"""Manifests of all formats, one for each order with a package for each part in it, read back with their lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.sources.manifests import resolved_packages

from .catalog import query, read


def _each(of, sep: str = "\n", only=None) -> Column:
    """What ``of`` makes of each package, or of those for which ``only`` holds, joined."""
    items = F.col("items") if only is None else F.filter("items", only)
    return F.array_join(F.transform(items, of), sep)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_DEV, _PROD = (lambda p: p["third"]), (lambda p: ~p["third"])
_JSON = lambda p: _text('"', p["name"], '": "', p["version"], '"')
_PINNED = lambda p: _text('"', p["name"], '": {"version": "==', p["version"], '"}')
_COMPOSER = lambda p: _text('{"name": "', p["name"], '", "version": "v', p["version"], '"}')
_BLOCK = lambda p: _text('[[package]]\nname = "', p["name"], '"\nversion = "', p["version"], '"')


def _halves(first: str, second: str, of, close: str, end: str) -> Column:
    """Those of production and those of development in two parts."""
    return _text(first, "\n", _each(of, ",\n", _PROD), "\n", close, second, "\n", _each(of, ",\n", _DEV), "\n", end)


#: Of the production half of two a package has its place behind the first line, of the other behind that half.
_HALF_LINE = "CASE WHEN third THEN greatest(prods, 1) + 2 + half ELSE 1 + half END"
_BY_HALF = "CASE WHEN third THEN 'dev' ELSE 'prod' END"

#: id: file, content, and in SQL ecosystem, direct, scope and line; ``n`` is a package's place in its manifest.
FORMATS = {
    "m1_npm_lock": (
        "package-lock.json",
        lambda: _text('{"packages": {\n', _each(lambda p: _text('"node_modules/', p["name"], '": {"version": "', p["version"], '", "dev": ', p["second"].cast("string"), "}"), ",\n"), ',\n"": {"dependencies": {', _each(lambda p: _text('"', p["name"], '": "*"'), ", ", _DEV), "}}}}"),
        "npm", "third", "CASE WHEN second THEN 'dev' ELSE 'prod' END", "1 + n",
    ),
    "m2_yarn_lock": ("yarn.lock", lambda: _each(lambda p: _text(p["name"], '@^1.0, "', p["name"], '@*":\n  version "', p["version"], '"\n')), "npm", "false", "'unknown'", "3 * n - 2"),
    "m3_pnpm_lock": ("pnpm-lock.yaml", lambda: _text("lockfileVersion: 6\npackages:\n", _each(lambda p: _text("  /", p["name"], "@", p["version"], "(peer@1.0.0):"))), "npm", "false", "'unknown'", "2 + n"),
    "m4_package_json": ("package.json", lambda: _halves('{"dependencies": {', ', "devDependencies": {', _JSON, "}", "}}"), "npm", "true", _BY_HALF, _HALF_LINE),
    "m5_requirements": ("requirements-dev.txt", lambda: _text("# pins\n", _each(lambda p: F.when(p["second"], _text(p["name"], "[extra] == ", p["version"], "  # why")).otherwise(_text(p["name"], ">=", p["version"])))), "PyPI", "true", "'prod'", "1 + n"),
    "m6_pipfile_lock": ("Pipfile.lock", lambda: _halves('{"default": {', ', "develop": {', _PINNED, "}", "}}"), "PyPI", "false", _BY_HALF, _HALF_LINE),
    "m7_poetry_lock": ("poetry.lock", lambda: _each(_BLOCK), "PyPI", "false", "'unknown'", "3 * n - 1"),
    "m8_go_mod": ("go.mod", lambda: _text("module x\nrequire (\n", _each(lambda p: _text("\t", p["name"], " v", p["version"], F.when(p["third"], " // indirect").otherwise(""))), "\n)\n"), "Go", "NOT third", "'prod'", "2 + n"),
    "m9_cargo_lock": ("Cargo.lock", lambda: _text("version = 3\n\n", _each(_BLOCK), "\n\n[metadata]\nname = \"none\"\n"), "crates.io", "false", "'unknown'", "3 * n + 1"),
    "m10_gemfile_lock": ("Gemfile.lock", lambda: _text("GEM\n  specs:\n", _each(lambda p: _text("    ", p["name"], " (", p["version"], ")")), "\n\nDEPENDENCIES\n", _each(lambda p: _text("  ", p["name"], "!"), "\n", _DEV)), "RubyGems", "third", "'prod'", "2 + n"),
    "m12_composer_lock": ("composer.lock", lambda: _halves('{"packages": [', ', "packages-dev": [', _COMPOSER, "]", "]}"), "Packagist", "false", _BY_HALF, _HALF_LINE),
    "m11_pyproject": ("pyproject.toml", lambda: _text("[project]\ndependencies = [\n", _each(lambda p: _text('"', p["name"], "==", p["version"], '"'), ",\n"), "\n]\n"), "PyPI", "true", "'prod'", "2 + n"),
}


def _sql(file: str, ecosystem: str, direct: str, scope: str, line: str, where: str) -> str:
    return f"""
    WITH i AS (SELECT l_orderkey, l_partkey, 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS name, max(l_linenumber) || '.' || l_partkey % 7 || '.0' AS version, l_partkey % 3 = 0 AS third, l_partkey % 2 = 0 AS second FROM lineitem GROUP BY l_orderkey, l_partkey),
    p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY name) AS n, row_number() OVER (PARTITION BY l_orderkey, third ORDER BY name) AS half, count(*) FILTER (NOT third) OVER (PARTITION BY l_orderkey) AS prods FROM i)
    SELECT 'r' || l_orderkey || '/{file}' AS path, '{ecosystem}' AS ecosystem, name, version, {direct} AS direct, {scope} AS scope, CAST({line} AS INTEGER) AS line FROM p WHERE {where}"""


def _manifest_query(name: str) -> None:
    file, content, *facts = FORMATS[name]

    def run(spark, d):
        one = read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_linenumber").alias("l"))
        package = F.struct(
            _text("p", F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("name"), _text(F.col("l").cast("string"), ".", (F.col("l_partkey") % 7).cast("string"), ".0").alias("version"),
            (F.col("l_partkey") % 3 == 0).alias("third"), (F.col("l_partkey") % 2 == 0).alias("second"),
        )
        files = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(package)).alias("items"))
        return resolved_packages(files.select(_text("r", F.col("l_orderkey").cast("string"), f"/{file}").alias("path"), content().alias("content")))

    # of requirements only pins count
    query(name, _sql(file, *facts, "second" if name == "m5_requirements" else "true"))(run)


for _name in FORMATS:
    _manifest_query(_name)
