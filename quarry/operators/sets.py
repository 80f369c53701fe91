"""Unions, differences and merges of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_ranked(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, ranks, found_by) of several ranked lists (key, rank), merged by key."""
    named = union_all([df.select(key, F.lit(n).alias("list"), "rank") for n, df in parts.items()])
    return named.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "rank")))).alias("ranks"), F.array_sort(F.collect_list("list")).alias("found_by")
    )


def union_unless(first: DataFrame, second: DataFrame, same: Column) -> DataFrame:
    """``first`` and those of ``second`` (aliased a and b in ``same``) that match none of it."""
    return first.unionByName(second.alias("b").join(first.alias("a"), same, "left_anti"), allowMissingColumns=True)


def minus(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``a`` whose keys aren't in ``b``."""
    return a.join(b.select(*keys), list(keys), "left_anti")


def distinct_first(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in order, unlike dropDuplicates always the same one."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def merge_by_precedence(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all parts, of equal keys that of the earliest part."""
    return distinct_first(union_all([p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]), keys, "part")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``new``, and of ``old`` what it doesn't replace."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """All children of the given parents replaced."""
    return new.unionByName(old.join(parents.select(parent).distinct(), parent, "left_anti"))
