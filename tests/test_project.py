"""Managers and kinds of projects, repository by repository."""

import pytest
from quarry.operators import project

pytestmark = pytest.mark.usefixtures("few_partitions")


def test_managers_by_field_by_file_and_by_default(spark):
    rows = [
        ("a", "web/package.json", '{"packageManager": "bun@1"}'), ("a", "package.json", "{broken"), ("a", "pnpm-workspace.yaml", ""), ("a", "x/requirements.txt", None), ("a", "requirements.txt", ""),
        ("b", "package.json", '{"packageManager": "other@1"}'), ("b", "deep/.yarnrc", ""), ("b", "build.gradle", ""), ("b", "m/build.gradle.kts", ""), ("c", "p/package.json", None), ("d", "README", "x"), (None, "go.mod", ""),
    ]
    f = spark.createDataFrame(rows, "repository string, path string, content string")
    got = {(r["repository"], r["manager"]): r["evidence"] for r in project.package_managers(f).collect()}
    assert got == {
        ("a", "bun"): ["web/package.json"], ("a", "pip"): ["requirements.txt"], ("b", "yarn"): ["deep/.yarnrc"], ("b", "gradle"): ["build.gradle", "m/build.gradle.kts"], ("c", "npm"): ["p/package.json"], (None, "go modules"): ["go.mod"],
    }
    assert {(r["repository"], r["runner"]) for r in project.node_managers(f).collect()} == {("a", "bun run"), ("b", "yarn"), ("c", "npm run")}


def test_kinds_of_project(spark):
    rows = [("a", "src/cli/x.ts", ""), ("a", "package.json", '{"private": false}'), ("b", "p/package.json", '{"private": false}'), ("b", "q/package.json", ""), ("b", "package.json", None), ("c", ".travis.yml", ""), ("d", "docker-compose.dev.yml", ""), ("d", "workers/w.py", "")]
    f = spark.createDataFrame(rows, "repository string, path string, content string")
    known = spark.createDataFrame([("a", "React"), ("d", "Koa"), ("e", "Flask")], "repository string, name string")
    routes = spark.createDataFrame([("d", "/x")], "repository string, path string")
    got = {r["repository"]: (r["types"], r["monorepo"], r["docker"], r["ci"]) for r in project.project_types(f, known, routes).collect()}
    assert got == {
        "a": (["frontend-web", "cli", "library"], False, False, False), "b": (["unclassified"], True, False, False), "c": (["unclassified"], False, False, True), "d": (["backend-api", "background-worker"], False, True, False),
    }
