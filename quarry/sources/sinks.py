"""Sinks: tables by key, SARIF, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of the report format by severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Rows appended to a Parquet table."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def with_file_ids(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the id of their file, null without one."""
    return findings.join(files.select(F.col("path").alias("file_path"), F.col("id").alias("file_id")), "file_path", "left")


def _level():
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("severity")), F.lit("warning"))


def _rules():
    """The rules of rows (index, rule_id, title, cwe), by index."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct("index", "rule_id", "title", "cwe"))),
        lambda r: F.struct(r["rule_id"].alias("id"), F.struct(r["title"].alias("text")).alias("shortDescription"), F.struct(F.array_compact(F.array(r["cwe"])).alias("tags")).alias("properties")),
    )


def _result():
    return F.struct(
        F.col("rule_id").alias("ruleId"), F.col("index").alias("ruleIndex"), F.col("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"),
                    F.struct(F.greatest(F.col("start_line"), F.lit(1)).alias("startLine"), F.coalesce("end_line", "start_line").alias("endLine")).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
    )


def sarif(findings: DataFrame, tool: str = "quarry") -> DataFrame:
    """One row with a SARIF 2.1.0 report: rules by first appearance, results with their rule's index.

    Findings go by severity's name, path and line.  The results are gathered into one document, for a repository's
    findings; ``sarif_lines`` is for those of a corpus.
    """
    from quarry.operators.windows import first_seen_index

    from pyspark.sql import Window

    rows = findings.withColumn("place", F.row_number().over(Window.orderBy("severity", "file_path", "start_line", "rule_id")))
    index = first_seen_index(rows, "rule_id", "place")
    about = rows.groupBy("rule_id").agg(F.min_by("title", "place").alias("title"), F.min_by("cwe", "place").alias("cwe"))
    rules = index.join(about, "rule_id").agg(_rules().alias("rules"))
    results = rows.withColumn("level", _level()).join(index, "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", _result().alias("r")))), lambda x: x["r"]).alias("results"))
    return rules.crossJoin(results).select(
        F.to_json(
            F.struct(
                F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"),
                F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))).alias("runs"),
            )
        ).alias("report")
    )


def sarif_lines(findings: DataFrame, tool: str = "quarry") -> DataFrame:
    """(place, line): the lines, by place from 0, of the report that ``sarif`` gives in one row.

    A line for what stands before the results, with all rules; one for each result; one for what follows.  Only the
    rules are gathered; results are sorted in ranges and numbered by the sizes of these.
    """
    from pyspark.sql import Window

    from quarry.operators.windows import first_seen_index

    from .checkpoints import cut

    order = ["severity", "file_path", "start_line", "rule_id", "title", "cwe", "end_line"]
    ranged = cut(findings.select(*order).orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).alias("_part")
    sizes = cut(ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n")))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    rows = ranged.withColumn("_part", part).join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    rows = rows.withColumn("place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1)
    about = cut(rows.groupBy("rule_id").agg(F.min("place").alias("place"), F.min_by("title", "place").alias("title"), F.min_by("cwe", "place").alias("cwe")))
    index = first_seen_index(about, "rule_id", "place").select(F.col("rule_id").alias("_rule"), "index")
    named = lambda df: df.join(index, F.col("rule_id").eqNullSafe(F.col("_rule")))
    line = F.concat(F.when(F.col("place") > 1, ",").otherwise(""), F.to_json(_result()))
    results = named(rows.withColumn("level", _level())).select("place", line.alias("line"))
    driver = F.to_json(F.struct(F.lit(tool).alias("name"), _rules().alias("rules")))
    opening = F.concat(F.lit('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":'), driver, F.lit('},"results":['))
    head = named(about).agg(opening.alias("line")).select(F.lit(0).cast("long").alias("place"), "line")
    tail = sizes.agg((F.coalesce(F.sum("_n"), F.lit(0)) + 1).alias("place")).select("place", F.lit("]}]}").alias("line"))
    return head.unionByName(results).unionByName(tail)


def markdown(sections: DataFrame, title: str, key: str = "doc") -> DataFrame:
    """(key, markdown): a document of its sections (position, title, body) with a table of contents."""
    parts = F.array_sort(F.collect_list(F.struct("position", "title", "body")))
    anchor = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9 -]", ""), " ", "-")
    toc = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("- ["), p["title"], F.lit("](#"), anchor(p["title"]), F.lit(")"))), "\n")
    body = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("## "), p["title"], F.lit("\n\n"), F.trim(p["body"]))), "\n\n")
    return sections.groupBy(key).agg(parts.alias("parts")).select(key, F.concat(F.lit(f"# {title}\n\n"), toc, F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def insight(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, kind, data): each row as a JSON document."""
    return df.select(key, F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("data"))
