"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, in DataFrame operations only.

Targets are token masses by source: proportional to the weights, but never above CAP times what the source has, with
the excess going to the others by weight.  The whole mix is divided into blocks of BLOCK tokens.  Sources get blocks by
highest quotients ``target / (2 k + 1)``, and so do the shards of each source, by their tokens.  A source has a shard
for every SHARD_TOKENS tokens, so a source that holds a third of all rows is worked on by many tasks.  A shard lines
its documents up in a seeded order and cuts the line into blocks; it takes the whole line as often as its quota allows
and then the seeded choice of blocks that the rest asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_JAVA, column, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 128
SHARD_TOKENS = 1 << 20
SEED = 29
#: Shards whose blocks one task lists, 8,192 blocks or a little more each.
SHARDS_A_TASK = 16
#: Up to so many sources their table goes to every task; with more it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Of (source, source_size) the target of each source, its place in code point order (null last) and its weight.

    The resharing ends where all sources below a water level are at their cap and the others share by weight.  In the
    order of cap / weight, the first source that its share fits is the first of these others.
    """
    w = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = by_source.withColumn("idx", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("idx", F.lit(w)).cast("int") + 1)
    )
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (
        placed.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("before", F.coalesce(F.sum("limit").over(up), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("before")) / F.col("rest"))
    )
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("before", "level"))).over(whole)
    # the first in order that fits has the least cap mass before it
    return levels.withColumn("water", water["level"]).select(
        "source", "idx", "weight", "source_size",
        F.least("limit", F.coalesce(F.col("water") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def apportion(df: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """``df`` with ``quota``: the ``seats`` of each group dealt to its rows by highest quotients votes / (2 k + 1).

    Ties go to the smaller key.  No seat is dealt one by one: each row has about its share, and only the quotients
    around it, about twice the rows' number in all, are ranked.
    """
    own = Window.partitionBy(*group)
    near = (
        df.withColumn("_total", F.sum(votes).over(own)).withColumn("_rows", F.count(F.lit(1)).over(own))
        .withColumn("_part", F.when(F.col("_total") > 0, F.col(votes) / F.col("_total")).otherwise(F.lit(0.0)))
        .withColumn("_mid", F.floor(F.col("_part") * F.col(seats) + 0.5))
        .withColumn("_wide", F.ceil(F.col("_part") * F.col("_rows")) + 2)
        .withColumn("_low", F.greatest(F.lit(0).cast("long"), F.col("_mid") - F.col("_wide")))
        .withColumn("_left", F.col(seats) - F.sum("_low").over(own))
    )
    # the rows go along with their quotients, so that no join brings them together again
    tried = near.withColumn("_k", F.explode(F.expr("sequence(_low, _mid + _wide - 1)"))).withColumn(
        "_rank", F.row_number().over(own.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), key, "_k"))
    )
    won = F.sum(F.expr(f"if(_rank <= _left and {votes} > 0, 1L, 0L)"))
    return tried.groupBy(*df.columns, "_low").agg(won.alias("_won")).withColumn("quota", F.col("_low") + F.col("_won")).drop("_low", "_won")


def _dealt(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, int]:
    """The rows of ``docs`` with their shards, the shards with what is dealt to them, and how many shards there are at most."""
    sizes = cut(
        docs.select(
            column(docs, id_col).alias("doc_id"), column(docs, source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(column(docs, text_col), F.lit(WORD_JAVA)), F.lit(0)).cast("long").alias("size"),
        )
    )
    by_source = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    seated = by_source.withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5)).withColumn("all", F.lit(0))
    sources = cut(
        apportion(seated, ["all"], "idx", "target", "seats")
        .select("source", "idx", "source_size", "target", "quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_TOKENS)).alias("shards"))
    )
    there = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("shards"), F.lit(0)).alias("shards")).first()
    small = there["n"] <= BROADCAST_SOURCES
    # one number as the key: Spark's relation of several values or of strings takes 64 MB however small it is
    named = sources.select(F.xxhash64("source").alias("name"), "idx", "source_size", "target", "quota", "shards")
    rows = sizes.withColumn("name", F.xxhash64("source")).join(F.broadcast(named) if small else named, "name").select(
        "doc_id", "source", "size", "idx", "source_size", "target", F.xxhash64(F.lit(seed), "doc_id", "size").alias("draw"), "quota", "shards"
    ).withColumn("shard", F.pmod("draw", "shards"))
    shards = rows.groupBy("idx", "shard").agg(F.sum("size").alias("tokens"), F.max("quota").alias("seats"))
    dealt = (
        apportion(shards, ["idx"], "shard", "tokens", "seats").where("tokens > 0")
        .withColumn("whole", F.least(F.lit(int(cap)), F.floor(F.col("quota") * block / F.col("tokens"))))
        .withColumn("blocks", F.ceil(F.col("tokens") / block))
        .withColumn(
            "chosen",
            F.when(F.col("whole") >= cap, F.lit(0)).otherwise(
                F.least("blocks", F.floor((F.col("quota") * block - F.col("whole") * F.col("tokens")) / block + 0.5))
            ),
        )
    )
    return rows, dealt, int(there["shards"])


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``.

    Null texts have size 0 and are taken 0 times; a null source is a source, the last.  Repeated rows are rows of
    their own.  Sources without words have target 0.  An empty table gives an empty result.  Reruns agree, since every
    order is by seeded hashes of the data.
    """
    rows, dealt, shards = _dealt(docs, id_col, text_col, source_col, weights, share, cap, block, seed)
    # few rows that become many: their number, not their size, has to say how many tasks they are for
    dealt = dealt.repartition(max(1, -(-shards // SHARDS_A_TASK)), "idx", "shard")
    shard = Window.partitionBy("idx", "shard")
    blocks = (
        dealt.select("idx", "shard", "whole", "blocks", "chosen", F.explode(F.expr("sequence(0L, blocks)")).alias("block"))
        .withColumn("rank", F.row_number().over(shard.orderBy(F.col("block") == F.col("blocks"), F.xxhash64(F.lit(seed + 1), "idx", "shard", "block"), "block")))
        .withColumn("in", ((F.col("rank") <= F.col("chosen")) & (F.col("block") < F.col("blocks"))).cast("long"))
        .withColumn("before", F.coalesce(F.sum("in").over(shard.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("idx", "shard", "block", "whole", "in", "before")
    )
    line = shard.orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(line), F.lit(0))).withColumn("to", F.col("at") + F.col("size"))

    def taken_before(place: str, in_: str, before: str):
        return F.col(before) * block + F.col(in_) * F.pmod(F.col(place), F.lit(block))

    def side(x: str) -> DataFrame:
        names = [F.col(c).alias(f"{x}_{c}") for c in ("idx", "shard", "block", "whole", "in", "before")]
        return blocks.select(F.xxhash64("idx", "shard", "block").alias(f"{x}_key"), *names)

    def here(x: str):
        """Equal keys, and what they stand for is equal too; the latter as differences, so that the key stays one number."""
        return F.expr(f"xxhash64(idx, shard, {x}) = {x}_key and idx - {x}_idx = 0 and shard - {x}_shard = 0 and {x} - {x}_block = 0")

    return (
        placed.withColumn("first", F.floor(F.col("at") / block)).withColumn("last", F.floor(F.col("to") / block))
        .join(side("first").hint("merge"), here("first"), "left").join(side("last").hint("merge"), here("last"), "left")
        .select(
            "doc_id", "source", "size", "source_size", "target",
            F.when(F.col("size") > 0, F.col("first_whole") * F.col("size") + taken_before("to", "last_in", "last_before") - taken_before("at", "first_in", "first_before"))
            .otherwise(F.lit(0)).cast("long").alias("taken"),
        )
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its taken words come to its size, rounded half up.

    Rows that share an id are taken alike.  Columns are as they were.
    """
    return _copied(docs, id_col, mix(docs, id_col, text_col, source_col))


def take_whole(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """``docs`` in whole documents whose words come to what the mix deals to each shard.

    A shard's line is taken as often as its quota allows, and then its documents in seeded order as long as the middle of
    the next lies within the rest; so a shard misses its quota by half a document at most.  Rows that share an id are
    taken alike.  Columns are as they were.
    """
    rows, dealt, _ = _dealt(docs, id_col, text_col, source_col, weights, share, cap, block, seed)
    rest = F.when(F.col("whole") >= cap, F.lit(0)).otherwise(F.col("quota") * block - F.col("whole") * F.col("tokens"))
    shards = dealt.select("idx", "shard", "whole", rest.alias("rest"))
    line = Window.partitionBy("idx", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("doc_id", "size", "draw", "idx", "shard").withColumn("at", F.coalesce(F.sum("size").over(line), F.lit(0)))
    times = F.col("whole") + F.when(F.col("at") * 2 + F.col("size") <= F.col("rest") * 2, 1).otherwise(0)
    return _copied(docs, id_col, placed.join(shards.hint("merge"), ["idx", "shard"]).select("doc_id", "size", (times * F.col("size")).alias("taken")))


def _copied(docs: DataFrame, id_col: str, mixed: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the words ``taken`` under its id come to the ``size`` of these rows."""
    copies = (
        mixed.groupBy("doc_id").agg(F.floor(F.sum("taken") / F.greatest(F.lit(1), F.sum("size")) + 0.5).cast("int").alias("n"))
        .where("n > 0").select(F.col("doc_id").alias("__id"), F.col("n").alias("__n"))
    )
    # the document goes along as one value, so that none of its columns' names can clash
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("d"), column(docs, id_col).alias("i"))
    return rows.join(copies.hint("merge"), F.col("i").eqNullSafe(F.col("__id"))).select("d", F.explode(F.expr("sequence(1, __n)"))).select("d.*")
