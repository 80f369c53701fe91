"""Documentation that follows from a repository's files alone: fifteen sections of facts.

Each section is a list of lines; every list has a limit of its own, which is the feature's, and an order that makes it
the same in each run.  A section without facts says so in one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import paths, text
from quarry.sources.checkpoints import cut

from . import extract

#: The sections' names in their order, and what each says where there is nothing to list.
SECTIONS: list[tuple[str, str, str]] = [
    ("overview", "Overview", "Nothing is known of the languages."),
    ("architecture", "Architecture", "There are no folders."),
    ("folder-structure", "Folder structure", "There are no folders."),
    ("installation", "Installation", "No manifest was found, so there is no command to name."),
    ("environment-variables", "Environment variables", "No code reads an environment variable."),
    ("configuration", "Configuration", "No settings file was found."),
    ("authentication", "Authentication", "No library for authentication was found."),
    ("authorization", "Authorization", "No route was found, so none can be guarded."),
    ("api", "API", "No route was found."),
    ("database", "Database", "No library for a database was found."),
    ("workflows", "Workflows", "No route was found to start a workflow from."),
    ("external-services", "External services", "No library for an external service was found."),
    ("deployment", "Deployment", "Neither containers nor pipelines nor build scripts were found."),
    ("testing", "Testing", "Neither a test library nor a test script was found."),
    ("troubleshooting", "Troubleshooting", "Facts say nothing of it; begin at the modules under Architecture."),
]
#: Lines of a section at most, where it has a limit.
MOST = {"languages": 10, "directories": 30, "folders": 60, "config": 40, "routes": 200, "groups": 10, "in group": 12, "build": 20, "tests": 12}

CONFIG = "(?:^|/)(?:\\.env\\.(?:example|sample|template)|[\\w.-]+\\.config\\.[cm]?[jt]s|tsconfig[\\w.-]*\\.json|\\.[\\w-]+rc(?:\\.(?:json|js|ya?ml))?|pyproject\\.toml|setup\\.cfg|tox\\.ini|application\\.(?:ya?ml|properties)|appsettings[\\w.]*\\.json)$"
CONTAINER = "(?:^|/)(?:[\\w.-]*Dockerfile[\\w.-]*|(?:docker-)?compose[\\w.-]*\\.ya?ml)$"
PIPELINE = "^\\.github/workflows/|(?:^|/)(?:\\.gitlab-ci\\.yml|Jenkinsfile|azure-pipelines\\.yml)$|(?:^|/)\\.circleci/"
TEST_SCRIPT, BUILD_SCRIPT = "(?i)test|spec|e2e|cover|lint|typecheck", "(?i)^(?:build|compile|package|deploy|release|start)"


def _code(c: str | Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(section: str, part: int, df: DataFrame, line: Column, *order: str | Column, most: int | None = None) -> DataFrame:
    """(section, part, at, line) of the first ``most`` rows."""
    rows = df.select(F.struct(*order).alias("k"), line.alias("line"))
    if most is not None:
        rows = rows.orderBy("k", "line").limit(most)
    at = F.row_number().over(Window.orderBy("k", "line"))
    return rows.withColumn("at", at).select(F.lit(section).alias("section"), F.lit(part).alias("part"), "at", "line")


def directories(files: DataFrame) -> DataFrame:
    """(path, files, lines) of all folders that hold a file."""
    folder = paths.dirname(F.col("path"))
    return files.groupBy(F.when(folder.isin("", "."), "/").otherwise(folder).alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(text.count_lines(F.col("content")), F.lit(0))).alias("lines"))


def documentation(files: DataFrame) -> DataFrame:
    """(position, section, title, body): all sections from files (path, language, content).

    Null contents hold no facts, but the file counts; a null language is left out of the languages.  No files give
    fifteen sections that say so.
    """
    read = files.where("content is not null")
    # what several sections ask for is made once: else each would read and parse all files again, the manifests' readers by the dozen
    manifests = cut(read.where(F.col("path").rlike(extract.MANIFESTS)))
    n = files.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"))
    share = n.withColumn("share", F.round(F.col("bytes") * 100 / F.greatest(F.lit(1), F.sum("bytes").over(Window.partitionBy())), 1))
    folders, routes, scripts = cut(directories(files)), cut(extract.routes(read)), cut(extract.scripts(manifests))
    stack = cut(extract.stack(manifests).withColumn("evidence", F.array_join(F.array_sort("evidence"), ", ")))
    flags, pins = extract.project_flags(files), extract.runtimes(manifests)
    names = files.select("path")
    guarded = routes.agg(F.count_if("has_auth").alias("g"), F.count(F.lit(1)).alias("n")).where("n > 0")
    grouped = routes.withColumn("grp", paths.route_group(F.col("path")))
    first = grouped.groupBy("grp").agg(F.min(F.struct("file_path", "line")).alias("m")).orderBy("m", "grp").limit(MOST["groups"])
    inside = grouped.join(first, "grp").withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("file_path", "line", "method", "path"))).where(F.col("r") <= MOST["in group"])

    def fact(section: str, part: int, group: str) -> DataFrame:
        own = stack.where(F.col("grp") == group)
        return _lines(section, part, own, _join("- ", F.col("name"), ": ", F.col("evidence")), "name")

    def at(c: str, line: str) -> Column:
        return _join("`", F.col(c), ":", F.col(line).cast("string"), "`")

    command = _join("- ", _code("name"), " in ", _code("path"), ": ", text.one_line(F.coalesce("command", F.lit("")), 90))
    parts = [
        _lines("overview", 1, share, _join("- ", F.col("language"), ": ", F.col("files").cast("string"), " files, ", F.col("share").cast("string"), " %"), F.col("share") * -1, "language", most=MOST["languages"]),
        fact("overview", 2, "framework"),
        _lines("overview", 3, extract.entry_points(read), _join("- starts at ", _code("path"), ": ", F.col("reason")), "path"),
        _lines("architecture", 1, folders, _join("- ", _code("path"), ": ", F.col("files").cast("string"), " files, ", F.col("lines").cast("string"), " lines"), F.col("files") * -1, "path", most=MOST["directories"]),
        _lines("folder-structure", 1, folders, _join(F.repeat(F.lit("  "), F.least(F.lit(6), F.size(F.split("path", "/")) - 1)), "- ", F.element_at(F.split("path", "/"), -1), "/"), "path", most=MOST["folders"]),
        _lines("installation", 1, pins, _join("- ", F.col("runtime"), " ", F.col("version"), ", see ", _code("path")), "runtime"),
        _lines("installation", 2, flags.where("runner is not null"), _join("- ", F.col("runner"), " install"), "runner"),
        _lines("installation", 3, scripts, command, "path", "name", most=MOST["build"]),
        _lines("environment-variables", 1, extract.env_vars(read), _join("- ", _code("name"), " in ", F.array_join(F.transform(F.slice("found", 1, 3), _code), ", ")), "name"),
        _lines("configuration", 1, names.where(F.col("path").rlike(CONFIG)), _join("- ", _code("path")), "path", most=MOST["config"]),
        fact("authentication", 1, "auth"),
        fact("authorization", 1, "auth"),
        _lines("authorization", 2, guarded, _join(F.col("g").cast("string"), " of ", F.col("n").cast("string"), " routes have a guard near them."), "n"),
        _lines("api", 1, routes, _join("- ", F.col("method"), " ", _code("path"), " at ", at("file_path", "line"), F.when(F.col("has_auth"), ", guarded").otherwise("")), "file_path", "line", "method", "path", most=MOST["routes"]),
        fact("database", 1, "database"),
        _lines("workflows", 1, inside, _join("- ", F.col("grp"), ": ", F.col("method"), " ", _code("path"), " at ", at("file_path", "line")), "m", "grp", "r"),
        fact("external-services", 1, "service"),
        _lines("deployment", 1, names.where(F.col("path").rlike(CONTAINER)), _join("- container: ", _code("path")), "path"),
        _lines("deployment", 2, names.where(F.col("path").rlike(PIPELINE)), _join("- pipeline: ", _code("path")), "path"),
        _lines("deployment", 3, scripts.where(F.col("name").rlike(BUILD_SCRIPT)), command, "path", "name", most=MOST["build"]),
        fact("testing", 1, "test"),
        _lines("testing", 2, scripts.where(F.col("name").rlike(TEST_SCRIPT)), command, "path", "name", most=MOST["tests"]),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    body = every.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n").alias("body"))
    known = files.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(SECTIONS, 1)], "position int, section string, title string, none string")
    return known.join(body, "section", "left").select("position", "section", "title", F.coalesce("body", "none").alias("body"))
