"""Ranks, caps, islands, budgets: operators over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], *order: Column, name: str = "rank") -> DataFrame:
    """Rank from 1 within the keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def capped(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """At most ``n`` rows for each key, the first in order."""
    return ranked(df, keys, *order, name="_r").where(F.col("_r") <= n).drop("_r")


def first_seen_index(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, index): keys numbered from 0 by their first ordinal (W5).  The keys alone are ranked, not the rows."""
    first = df.groupBy(key).agg(F.min(ordinal).alias("first"))
    return first.select(key, (F.row_number().over(Window.orderBy("first", key)) - 1).cast("long").alias("index"))


def islands(df: DataFrame, key: str, start: str, end: str, gap: int = 1) -> DataFrame:
    """Overlapping or adjacent intervals of each key merged."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return (
        df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged")).drop("_island")
    )


def gaps(df: DataFrame, key: str, start: str, end: str, least: int = 1) -> DataFrame:
    """What the intervals of each key leave open between them, from ``least`` long."""
    order = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_before", F.max(end).over(order)).where(F.col(start) - F.col("_before") - 1 >= least)
        .select(key, (F.col("_before") + 1).alias("gap_start"), (F.col(start) - 1).alias("gap_end"))
    )


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return capped(df, keys, 1, *order)


def last_n(df: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key, with their place oldest first."""
    down = Window.partitionBy(key).orderBy(F.col(at).desc())
    kept = df.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(at)))


def neighbours(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The value before and after each row."""
    order = Window.partitionBy(key).orderBy(at)
    return df.withColumn("previous", F.lag(value).over(order)).withColumn("following", F.lead(value).over(order))


def batches(df: DataFrame, keys: Sequence[str], size: int, *order: Column) -> DataFrame:
    """Rows of each key numbered into batches of ``size``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(at / size).cast("int"))


def first_fit(df: DataFrame, key: str, ordinal: Column, cost: str, item: str, budget: int) -> DataFrame:
    """Items taken in order as long as each fits what is left; one that doesn't fit is skipped, not the end."""
    items = F.array_sort(F.collect_list(F.struct(ordinal.alias("o"), F.col(cost).cast("long").alias("c"), F.col(item).alias("i"))))
    kind = df.schema[item].dataType.simpleString()
    start = F.expr(f"named_struct('used', 0L, 'taken', cast(array() as array<{kind}>))")

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["c"] <= budget
        return F.when(fits, F.struct((s["used"] + x["c"]).alias("used"), F.concat(s["taken"], F.array(x["i"])).alias("taken"))).otherwise(s)

    return df.groupBy(key).agg(items.alias("items")).select(key, F.aggregate("items", start, step).alias("r")).select(key, "r.used", "r.taken")


def fit_until_overflow(df: DataFrame, key: str, order: Sequence[str], cost: str, budget: int) -> DataFrame:
    """Rows in order up to the first that overflows the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(cost).over(w)).withColumn("_over", F.max((F.col("_used") > budget).cast("int")).over(w)).where("_over = 0").drop("_over", "_used")


def top_batches(df: DataFrame, key: str, n: int, page: int, *order: Column) -> DataFrame:
    """The top ``n`` of each key in pages."""
    return batches(capped(df, [key], n, *order), [key], page, *order)
