"""Top-k, paging and custom orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in order; Spark keeps ``n`` a partition."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, offset: int, limit: int, first: Sequence[Column], then: Sequence[Column]) -> DataFrame:
    """A page by one order, itself sorted by another; ``place`` is the place on the page (T5)."""
    from pyspark.sql import Window

    rows = df.orderBy(*first).offset(offset).limit(limit)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*then)))


def by_list(c: Column, values: Sequence[str]) -> Column:
    """A sort key that follows a list; others come after."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(at > 0, at).otherwise(len(values) + 1)


def two_stage(df: DataFrame, n: int, wide: Sequence[Column], priority: Column, *ties: Column) -> DataFrame:
    """Of the first 3 n rows by ``wide`` the first n by priority."""
    return df.orderBy(*wide).limit(3 * n).withColumn("priority", priority).orderBy(F.col("priority").desc(), *ties).limit(n)


def contributions(parts: Sequence[DataFrame], key: str, n: int) -> DataFrame:
    """Scores (key, score) from several tables added up; the best ``n`` above zero."""
    whole = parts[0].select(key, "score")
    for p in parts[1:]:
        whole = whole.unionByName(p.select(key, "score"))
    return whole.groupBy(key).agg(F.sum("score").alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(n)


def version_key(v: Column) -> Column:
    """An array to compare versions by: numeric segments as numbers, others as text after the numbers."""
    part = F.split(F.regexp_replace(v, "^[vV]", ""), "[.\\-+]")
    return F.transform(part, lambda p: F.struct(F.when(p.rlike("^[0-9]{1,18}$"), p.cast("long")).otherwise(F.lit(-1)).alias("n"), F.when(~p.rlike("^[0-9]{1,18}$"), p).otherwise("").alias("t")))


def greatest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """The greatest version of each key."""
    return df.groupBy(key).agg(F.max_by(version, F.struct(version_key(F.col(version)), F.col(version))).alias("version"))


def flagged_first(df: DataFrame, flag: Column, n: int, *order: Column) -> DataFrame:
    """Flagged rows first, each side in order."""
    return df.withColumn("flagged", flag).orderBy(F.col("flagged").desc(), *order).limit(n)
