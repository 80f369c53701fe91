"""Queries of what repositories are, each customer a repository and each of its orders a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import project

from .catalog import query, read

_NAMES = ["package.json", "api/package.json", "requirements.txt", "x/pyproject.toml", "go.mod", "build.gradle.kts", "build.gradle", "Gemfile", ".yarnrc.yml", "pnpm-workspace.yaml", "bin/run.sh", "jobs/a.py", "Dockerfile.dev", ".github/workflows/ci.yml", "src/a.ts", "notes.md", "README"]
_N = len(_NAMES)


def _files(spark, d):
    """The name by the order's key; manifests name yarn, something unknown or nothing, and are private or not."""
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (k % _N).cast("int") + 1)
    field = F.when(k % 4 == 0, '"packageManager": "yarn@4.1", ').when(k % 4 == 1, '"packageManager": "vlt@1", ').otherwise("")
    content = F.concat(F.lit("{"), field, F.when(k % 3 == 0, F.lit('"private" : false}')).otherwise(F.lit('"private": true}')))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("repository"), name.alias("path"), content.alias("content"), k.alias("k"))


_F = f"SELECT o_custkey AS repository, {_NAMES}[o_orderkey % {_N} + 1] AS path, o_orderkey AS k, string_split({_NAMES}[o_orderkey % {_N} + 1], '/')[-1] AS base FROM orders"


@query(
    "e14_package_managers",
    f"""WITH f AS ({_F}), n AS (SELECT repository, min(CASE WHEN base = 'package.json' THEN (path <> 'package.json', path) END) AS m, min(CASE WHEN base = 'package.json' AND k % 4 = 0 THEN (path <> 'package.json', path) END) AS y,
      min(path) FILTER (base = 'pnpm-workspace.yaml') AS p, min(path) FILTER (base = '.yarnrc.yml') AS r FROM f GROUP BY 1),
    node AS (SELECT repository, CASE WHEN y IS NOT NULL THEN 'yarn' WHEN p IS NOT NULL THEN 'pnpm' WHEN r IS NOT NULL THEN 'yarn' ELSE 'npm' END AS manager, CASE WHEN y IS NOT NULL THEN y[2] WHEN p IS NOT NULL THEN p WHEN r IS NOT NULL THEN r ELSE m[2] END AS evidence FROM n WHERE m IS NOT NULL),
    o AS (SELECT DISTINCT repository, CASE base WHEN 'requirements.txt' THEN 'pip' WHEN 'pyproject.toml' THEN 'poetry' WHEN 'go.mod' THEN 'go modules' WHEN 'Gemfile' THEN 'bundler' ELSE 'gradle' END AS manager, path FROM f WHERE base IN ('requirements.txt', 'pyproject.toml', 'go.mod', 'Gemfile', 'build.gradle', 'build.gradle.kts'))
    SELECT * FROM node UNION ALL SELECT repository, manager, string_agg(path, ',' ORDER BY path) FROM o GROUP BY 1, 2""",
)
def e14_managers(spark, d):
    return project.package_managers(_files(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


_LIST = "CASE WHEN {} THEN '{}' END"


@query(
    "e15_project_types",
    f"""WITH f AS ({_F}), g AS (SELECT repository, bool_or(path LIKE 'bin/%') AS cli, bool_or(path LIKE 'jobs/%') AS worker, bool_or(path = 'package.json' AND k % 3 = 0) AS library, bool_or(path = 'pnpm-workspace.yaml') OR count(*) FILTER (base = 'package.json') > 2 AS monorepo, bool_or(path = 'Dockerfile.dev') AS docker, bool_or(path LIKE '.github/%') AS ci FROM f GROUP BY 1),
    t AS (SELECT *, concat_ws(',', {", ".join(_LIST.format(c, n) for c, n in (("repository % 5 = 0 OR repository % 7 = 0", "backend-api"), ("repository % 3 = 0", "frontend-web"), ("cli", "cli"), ("worker", "background-worker"), ("library", "library")))}) AS types FROM g)
    SELECT repository, CASE types WHEN '' THEN 'unclassified' ELSE types END AS types, monorepo, docker, ci FROM t""",
)
def e15_types(spark, d):
    files = _files(spark, d)
    own = files.select("repository").distinct()
    named = own.withColumn("name", F.explode(F.array(F.when(F.col("repository") % 5 == 0, "Flask").otherwise("none"), F.when(F.col("repository") % 3 == 0, "React").otherwise("none"))))
    return project.project_types(files, named, own.where("repository % 7 = 0")).withColumn("types", F.array_join("types", ","))
