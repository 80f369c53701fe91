"""Groupings and roll-ups.  Each takes the columns it works on as parameters and returns a new DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Number of rows for each combination of keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def rollup_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner), totals by outer and the grand total, told apart by level 0, 1 and 2 (A3)."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("gid")).select(
        outer, inner, F.when(F.col("gid") == 0, 0).when(F.col("gid") == 1, 1).otherwise(2).alias("level"), "n"
    )


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """One row for each outer value, with its total and a map from inner value to count."""
    pairs = counts_by(df, outer, inner)
    return pairs.groupBy(outer).agg(
        F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), F.col("n"))))).alias("by_inner")
    )


def grouping_sets(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a, by b and by both in one pass (A9); grouped_by says which."""
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    sets = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("ab"))).alias("grouped_by")
    # the pairs are already few, so each goes to all three sets
    spread = pairs.select(a, b, "n", sets)
    return (
        spread.withColumn(a, F.when(F.col("grouped_by") != "b", F.col(a))).withColumn(b, F.when(F.col("grouped_by") != "a", F.col(b)))
        .groupBy("grouped_by", a, b).agg(F.sum("n").alias("n"))
    )


def totals(df: DataFrame, **sums: str) -> DataFrame:
    """Row count and named sums, zero for an empty input (A5)."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()])


def with_total(df: DataFrame) -> DataFrame:
    """Each row beside the number of all rows."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def distribution(df: DataFrame, value: str, high: float) -> DataFrame:
    """Mean, maximum, count above a bound and count; zeros on empty input."""
    v = F.col(value)
    return df.agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.max(v), F.lit(0)).cast("double").alias("largest"),
        F.count_if(v > high).alias("n_high"), F.count(F.lit(1)).alias("n"),
    )


def half_up(x: Column) -> Column:
    """Rounding with halves upwards, also below zero."""
    return F.floor(x + F.lit(0.5))


def shares(df: DataFrame, key: str, size: str, lines: str) -> DataFrame:
    """Rows, lines and size by key, and the size's share of all in percent with one decimal."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"), F.sum(size).alias("bytes"))
    whole = F.greatest(F.sum("bytes").over(Window.partitionBy()), F.lit(1))
    return by.withColumn("percent", half_up(F.col("bytes") / whole * 1000) / 10)


def histogram_top(df: DataFrame, group: str, kind: str, name: str, size: str, groups: int, names: int) -> DataFrame:
    """For the ``groups`` largest groups: rows, size, the histogram of kinds and the ``names`` largest names."""
    kinds = counts_by(df, group, kind).groupBy(group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), F.col("n"))))).alias("kinds"), F.sum("n").alias("n")
    )
    order = Window.partitionBy(group).orderBy(F.col(size).desc(), name)
    top = (
        df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= names)
        .groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", name))), lambda x: x[name]).alias("top"))
    )
    return (
        kinds.join(df.groupBy(group).agg(F.sum(size).alias("size")), group).join(top, group)
        .orderBy(F.col("n").desc(), group).limit(groups)
    )


def dominant(df: DataFrame, group: str, value: str, weak: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """The most frequent value of each group; weak ones win only alone, ties go by a fixed priority."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(value)), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    n = counts_by(df, group, value)
    return n.groupBy(group).agg(F.max_by(value, F.struct(~F.col(value).isin(list(weak)), F.col("n"), -rank, F.col(value))).alias("dominant"))


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct neighbours in and out of each node, zero where there are none."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    out = e.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    inn = e.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    return out.join(inn, "node", "full_outer").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def edges_between(edges: DataFrame, src: str, dst: str, groups: DataFrame, node: str, group: str, flag: Column, top: int) -> DataFrame:
    """Edges counted between groups of nodes, without those within one, and whether any is flagged; the top ones."""
    a = groups.select(F.col(node).alias("_a"), F.col(group).alias("from_group"))
    b = groups.select(F.col(node).alias("_b"), F.col(group).alias("to_group"))
    return (
        edges.withColumn("_flag", flag).join(a, F.col(src) == F.col("_a")).join(b, F.col(dst) == F.col("_b"))
        .where("from_group <> to_group").groupBy("from_group", "to_group")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("_flag").alias("flagged"))
        .orderBy(F.col("n").desc(), "from_group", "to_group").limit(top)
    )


def precision_recall(df: DataFrame, group: str, actual: Column, predicted: Column) -> DataFrame:
    """Hits, misses, false alarms, precision and recall by group and over all (group null); 1 where undefined."""
    both = df.select(F.col(group).alias("grp"), actual.alias("a"), predicted.alias("p"))
    out = both.rollup("grp").agg(
        F.count_if(F.expr("a and p")).alias("hits"), F.count_if(F.expr("a and not p")).alias("misses"),
        F.count_if(F.expr("not a and p")).alias("false_alarms"), F.grouping_id().alias("gid"),
    )
    ratio = lambda x, y: F.coalesce(F.col(x) / F.expr(f"nullif({y}, 0)"), F.lit(1.0))
    return out.select(
        F.when(F.col("gid") == 1, F.lit("(all)")).otherwise(F.col("grp")).alias("grp"), "hits", "misses", "false_alarms",
        F.round(ratio("hits", "hits + false_alarms"), 6).alias("precision"), F.round(ratio("hits", "hits + misses"), 6).alias("recall"),
    )


def zero_filled(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """A count for each of the given values, zero where none."""
    every = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, {key} string")
    return every.join(counts_by(df, key), key, "left").select("place", key, F.coalesce("n", F.lit(0)).alias("n"))


def capped_lists(df: DataFrame, key: str, value: str, each: int, keys: int) -> DataFrame:
    """For each key its first ``each`` distinct values in order, for the first ``keys`` keys."""
    order = Window.partitionBy(key).orderBy(value)
    return (
        df.select(key, value).distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each)
        .groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("found")).orderBy(key).limit(keys)
    )


def prefer(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


#: Severities from worst to least, as findings have them.
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def severity_rank(c: Column) -> Column:
    """0 for the worst; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c)
    return F.when(at > 0, at - 1).otherwise(len(SEVERITIES))


def worst_by(df: DataFrame, keys: Sequence[str], severity: str, fix: str) -> DataFrame:
    """The worst severity, all distinct fixes and their number, by key."""
    return df.groupBy(*keys).agg(
        F.min_by(severity, severity_rank(F.col(severity))).alias("severity"),
        F.array_sort(F.array_distinct(F.collect_list(fix))).alias("fixes"), F.count(F.lit(1)).alias("n"),
    )


def pair_lines(pairs: DataFrame, start: str, end: str) -> DataFrame:
    """Lines of side a over all duplicate pairs."""
    return pairs.agg(F.coalesce(F.sum(F.col(end) - F.col(start) + 1), F.lit(0)).alias("lines"))


def best_of_two(df: DataFrame, key: str, first: str, second: str, weight: float) -> DataFrame:
    """By key the greater of the best first score and the best second one, weighted."""
    score = lambda c: F.coalesce(F.max(c), F.lit(0.0))
    return df.groupBy(key).agg(F.greatest(score(first), score(second) * weight).alias("score"))


def side_counts(parent: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Each parent row beside the numbers of its rows in other tables."""
    for name, child in children.items():
        n = child.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias(name))
        parent = parent.join(n, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))
    return parent
