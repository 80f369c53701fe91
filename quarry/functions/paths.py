"""Paths of files, calls and routes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First segments that say nothing about what a route is for.
GENERIC_SEGMENTS = ["api", "v1", "v2", "v3", "rest", "internal", "public", "app"]


def dirname(p: Column) -> Column:
    """What stands before the last slash; a dot without one."""
    d = F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    return F.when(F.contains(p, F.lit("/")), F.when(d == "", "/").otherwise(d)).otherwise(".")


def basename(p: Column) -> Column:
    """The last segment."""
    return F.regexp_extract(p, "([^/]*)$", 1)


def extension(p: Column) -> Column:
    """The lower-case extension with its dot, or nothing."""
    return F.lower(F.regexp_extract(p, "[^/](\\.[^./]+)$", 1))


def normalise(p: Column) -> Column:
    """A path without . and empty segments and with .. folded as far as it goes."""
    rooted = F.startswith(p, F.lit("/"))
    empty = F.expr("cast(array() as array<string>)")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        up = F.when((F.size(acc) > 0) & (last != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(rooted, acc).otherwise(F.concat(acc, F.array(s)))
        return F.when((s == "") | (s == "."), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    body = F.array_join(F.aggregate(F.split(p, "/"), empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def join(base: Column, rel: Column) -> Column:
    """Two paths as one, normalised."""
    return normalise(F.concat_ws("/", base, rel))


def stays_inside(p: Column) -> Column:
    """Whether a relative path never climbs above its root."""
    n = normalise(p)
    return ~F.startswith(p, F.lit("/")) & ~F.contains(p, F.lit("\\")) & ~F.contains(p, F.lit("\u0000")) & (n != "..") & ~F.startswith(n, F.lit("../"))


def package_root(spec: Column) -> Column:
    """The package that an import names: its first segment, two with a scope."""
    return F.regexp_extract(spec, "^(@[^/]+/[^/]+|[^/]+)", 1)


def _tidy(p: Column) -> Column:
    p = F.regexp_replace(F.concat(F.lit("/"), p), "/{2,}", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))


def call_path(x: Column) -> Column:
    """The path of an HTTP call without origin, query and hash; interpolations become :param."""
    x = F.regexp_replace(x, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    x = F.regexp_replace(x, "^\\$\\{[^}]*\\}", "")
    x = F.regexp_replace(x, "[?#].*$", "")
    return _tidy(F.regexp_replace(x, "\\$\\{[^}]*\\}", ":param"))


def route_path(x: Column) -> Column:
    """A declared route with all its kinds of parameters as :param."""
    x = F.regexp_replace(x, "\\{[^}]*\\}|<[^>]*>|:[A-Za-z_]\\w*(?:\\([^)]*\\))?\\??|\\*+", ":param")
    return _tidy(x)


def route_group(x: Column) -> Column:
    """The first segment that says something."""
    named = F.filter(F.split(x, "/"), lambda s: (s != "") & ~s.isin(GENERIC_SEGMENTS) & ~F.startswith(s, F.lit(":")))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("root"))
