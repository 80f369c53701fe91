"""Event-time windows, joins and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """With a watermark where there is a delay and the input is a stream."""
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, *keys: str, value: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts and sums in windows side by side, by key; also the fixed-window rate of requests."""
    sums = [F.count(F.lit(1)).alias("n")] + ([F.round(F.sum(value), 6).alias("total")] if value else [])
    out = late(df, ts, delay).groupBy(F.window(ts, width).alias("w"), *keys).agg(*sums)
    return out.select(F.col("w.start").alias("start"), *keys, *[c for c in out.columns if c not in ("w", *keys)])


def sliding(df: DataFrame, ts: str, width: str, step: str, *keys: str, delay: str | None = None) -> DataFrame:
    """Counts in overlapping windows, by key."""
    out = late(df, ts, delay).groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, key: str, delay: str | None = None) -> DataFrame:
    """Sessions of each key: runs of events with no gap as long as the given one."""
    out = late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def over_limit(df: DataFrame, ts: str, key: str, most: int, width: str = "1 minute", delay: str | None = None) -> DataFrame:
    """Windows in which a key has more events than allowed (the rate limit)."""
    return tumbling(df, ts, width, key, delay=delay).where(F.col("n") > most)


def first_of(df: DataFrame, ts: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Each event once, however often it is delivered; a stream forgets after the delay."""
    return late(df, ts, delay).dropDuplicatesWithinWatermark(keys) if delay and df.isStreaming else df.dropDuplicates(keys)


def enriched(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A stream beside a table."""
    return df.join(table, key, "left")


def stale(df: DataFrame, key: str, ts: str, now, minutes: int = 60) -> DataFrame:
    """Keys whose last sign is older than so many minutes."""
    return df.groupBy(key).agg(F.max(ts).alias("seen")).where(F.col("seen") < now - F.make_dt_interval(mins=F.lit(minutes)))
