"""What the files of repositories say of each: package managers, runner, kinds of project.

Files are (repository, path, content); everything is grouped by repository, so that one job does all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Managers and the files that show them.
MANAGER_FILES = [
    ("pip", "requirements.txt"), ("poetry", "pyproject.toml"), ("go modules", "go.mod"), ("maven", "pom.xml"), ("gradle", "build.gradle"), ("gradle", "build.gradle.kts"),
    ("cargo", "Cargo.toml"), ("bundler", "Gemfile"), ("composer", "composer.json"), ("NuGet", "packages.config"),
]
#: Managers of Node packages in a manifest's field, and the files that show one without it, in this order.
NODE = ("npm", "yarn", "pnpm", "bun")
NODE_FILES = [("pnpm", ("pnpm-workspace.yaml", "pnpm-workspace.yml")), ("yarn", (".yarnrc", ".yarnrc.yml")), ("bun", ("bunfig.toml",))]
#: Kinds of project and the frameworks that make one.
BACKEND = ("Express", "Fastify", "NestJS", "FastAPI", "Flask", "Django", "Spring Boot", "ASP.NET Core")
FRONTEND = ("React", "Vue", "Angular", "Svelte", "Next.js")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def node_managers(files: DataFrame) -> DataFrame:
    """(repository, manager, runner, evidence) of repositories with a package.json: by its field, else by a file, else npm."""
    field = F.from_json("content", "packageManager string")["packageManager"]
    named = F.when(basename(F.col("path")) == "package.json", F.substring_index(field, "@", 1))
    own = files.select("repository", "path", basename(F.col("path")).alias("base"), F.when(named.isin(*NODE), named).alias("named"))
    # the manifest at the top before others
    order = F.struct(F.col("path") != "package.json", F.col("path"))
    shown = [F.min(F.when(F.col("base").isin(*of), F.col("path"))).alias(m) for m, of in NODE_FILES]
    one = own.groupBy("repository").agg(
        F.min(F.when(F.col("base") == "package.json", order)).alias("manifest"), F.min_by("named", F.when(F.col("named").isNotNull(), order)).alias("named"),
        F.min_by("path", F.when(F.col("named").isNotNull(), order)).alias("said"), *shown,
    ).where("manifest is not null")
    manager, evidence = F.when(F.col("named").isNotNull(), F.col("named")), F.when(F.col("named").isNotNull(), F.col("said"))
    for m, _ in NODE_FILES:
        manager, evidence = manager.when(F.col(m).isNotNull(), m), evidence.when(F.col(m).isNotNull(), F.col(m))
    manager, evidence = manager.otherwise("npm"), evidence.otherwise(F.col("manifest")["path"])
    done = one.select("repository", manager.alias("manager"), evidence.alias("evidence"))
    return done.select("repository", "manager", F.when(F.col("manager") == "yarn", "yarn").otherwise(F.concat("manager", F.lit(" run"))).alias("runner"), F.array("evidence").alias("evidence"))


def package_managers(files: DataFrame) -> DataFrame:
    """(repository, manager, evidence): the managers that files show, with the first file of each kind."""
    rules = F.broadcast(files.sparkSession.createDataFrame(MANAGER_FILES, "manager string, base string"))  # ten rows
    first = files.select("repository", "path", basename(F.col("path")).alias("base")).join(rules, "base").groupBy("repository", "manager", "base").agg(F.min("path").alias("path"))
    others = first.groupBy("repository", "manager").agg(F.array_sort(F.collect_list("path")).alias("evidence"))
    return node_managers(files).select("repository", "manager", "evidence").unionByName(others)


def project_types(files: DataFrame, frameworks: DataFrame, routes: DataFrame) -> DataFrame:
    """(repository, types, monorepo, docker, ci) of every repository.

    ``frameworks`` are (repository, name), ``routes`` (repository, ...), one row a route.  Types come in a fixed order, and
    a repository of none is unclassified.
    """
    has = lambda pattern: F.bool_or(F.col("path").rlike(pattern))
    top = (F.col("path") == "package.json") & F.col("content").rlike("\"private\"\\s*:\\s*false")
    own = files.groupBy("repository").agg(
        has("(?:^|/)(?:cli|bin)/").alias("cli"), has("(?:^|/)(?:workers?|jobs?|consumers?)/").alias("worker"), F.bool_or(F.coalesce(top, F.lit(False))).alias("library"),
        (has("(?:^|/)(?:pnpm-workspace\\.yaml|lerna\\.json|turbo\\.json|nx\\.json)$") | (F.count_if(basename(F.col("path")) == "package.json") > 2)).alias("monorepo"),
        has("(?i)(?:^|/)(?:Dockerfile[\\w.-]*|docker-compose[\\w.-]*\\.ya?ml)$").alias("docker"),
        has("^\\.github/workflows/.+\\.ya?ml$|(?:^|/)(?:\\.gitlab-ci\\.yml|Jenkinsfile|azure-pipelines\\.yml|\\.circleci/config\\.yml|\\.travis\\.yml)$").alias("ci"),
    )
    known = frameworks.groupBy("repository").agg(F.bool_or(F.col("name").isin(*BACKEND)).alias("back"), F.bool_or(F.col("name").isin(*FRONTEND)).alias("front"))
    called = routes.select("repository").distinct().withColumn("routed", F.lit(True))
    all_ = own.join(known, "repository", "left").join(called, "repository", "left").fillna(False, ["back", "front", "routed"])
    kinds = F.array_compact(F.array(
        F.when(F.col("back") | F.col("routed"), "backend-api"), F.when(F.col("front"), "frontend-web"), F.when(F.col("cli"), "cli"), F.when(F.col("worker"), "background-worker"), F.when(F.col("library"), "library"),
    ))
    return all_.select("repository", F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("unclassified"))).alias("types"), "monorepo", "docker", "ci")
