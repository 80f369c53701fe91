"""Scores of a repository from its counters, and what lowers severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import clamp, cvss31, grade, severity_of_score

#: What a finding of each severity weighs.
WEIGHTS = {"critical": 22.0, "high": 11.0, "medium": 4.0, "low": 1.2, "info": 0.2}


def weight(severity: Column) -> Column:
    out = F.lit(1.0)
    for k, v in WEIGHTS.items():
        out = F.when(severity == k, F.lit(v)).otherwise(out)
    return out


def category_mass(findings: DataFrame, key: str) -> DataFrame:
    """The summed weights of each key's findings by category, as columns."""
    return findings.groupBy(key).pivot("category", ["security", "quality", "bug", "performance"]).agg(F.sum(weight(F.col("severity")))).fillna(0.0)


def scores(inputs: DataFrame) -> DataFrame:
    """Five scores with grades for each row of counters.

    Columns: lines, dup_lines, unprotected_routes, dead_files, unused_imports, avg_complexity, high_complexity, symbols,
    test_files, code_files, has_framework, has_ci, and the masses security, quality, bug, performance.
    """
    c = F.col
    k = F.sqrt(F.greatest(c("lines") / 1000, F.lit(0.5)))
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    least = lambda n, x: F.least(F.lit(float(n)), x)
    above = lambda x: F.greatest(F.lit(0.0), x)
    security = clamp(100 - c("security") / k - least(12, c("unprotected_routes")))
    quality = clamp(100 - least(25, 400 * share("dup_lines", "lines")) - c("quality") / k - least(10, c("dead_files")) - least(6, c("unused_imports") / 4))
    complexity = clamp(100 - least(45, above(6 * (c("avg_complexity") - 5))) - least(25, 150 * share("high_complexity", "symbols")))
    testability = clamp(55 + least(45, 180 * share("test_files", "code_files")) - F.when(c("has_framework"), 0).otherwise(20) - F.when(c("has_ci"), 0).otherwise(8) - least(15, above(3 * (c("avg_complexity") - 6))))
    out = inputs.withColumns({"s_security": security, "s_quality": quality, "s_complexity": complexity, "s_testability": testability})
    health = clamp(0.30 * c("s_security") + 0.20 * c("s_quality") + 0.15 * c("s_complexity") + 0.20 * c("s_testability") + 0.10 * clamp(100 - c("bug") / k) + 0.05 * clamp(100 - c("performance") / k))
    out = out.withColumn("s_health", health)
    names = ["security", "quality", "complexity", "testability", "health"]
    return out.withColumns({f"grade_{n}": grade(c(f"s_{n}")) for n in names})


def advisory_severity(rated: Column, vector: Column) -> Column:
    """The publisher's rating, else by the vector's score, else medium."""
    low = F.lower(rated)
    known = F.when(low == "moderate", "medium").when(low.isin(*WEIGHTS), low)
    return F.coalesce(known, F.when(vector.isNotNull(), severity_of_score(cvss31(vector))), F.lit("medium"))


def lowered(severity: Column, imported: Column, production: Column, direct: Column) -> Column:
    """One step lower where the package isn't imported and is for development or indirect; a null ``imported`` isn't known."""
    down = F.when(severity == "critical", "high").when(severity == "high", "medium").when(severity == "medium", "low").otherwise(severity)
    return F.when(~imported & (~production | ~direct), down).otherwise(severity)


def vulnerable_packages(packages: DataFrame, advisories: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """A finding for each vulnerable package: worst severity, advisories, fixes and the greatest fix.

    packages: path, ecosystem, name, version, direct, scope.  advisories: id, ecosystem, name, version, severity, vector,
    fixed, withdrawn.  imported: name.
    """
    from .aggregates import prefer, severity_rank
    from .joins import flag_if_in
    from .sorts import version_key

    one = prefer(packages, ["ecosystem", "name", "version"], F.col("direct").desc(), "path")
    hit = one.join(advisories.where("withdrawn is null").withColumnRenamed("severity", "rated"), ["ecosystem", "name", "version"])
    if imported is None:
        hit = hit.withColumn("imported", F.lit(None).cast("boolean"))
    else:
        hit = flag_if_in(hit, "name", imported.withColumnRenamed("name", "_n"), "_n", "imported")
    base = advisory_severity(F.col("rated"), F.col("vector"))
    hit = hit.withColumn("severity", F.coalesce(lowered(base, F.col("imported"), F.col("scope") != "dev", F.col("direct")), base))
    return hit.groupBy("path", "ecosystem", "name", "version").agg(
        F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.array_sort(F.collect_set("id")).alias("advisories"),
        F.array_sort(F.collect_set("fixed")).alias("fixes"), F.max_by("fixed", F.when(F.col("fixed").isNotNull(), F.struct(version_key(F.col("fixed")), F.col("fixed")))).alias("upgrade"),
    )
