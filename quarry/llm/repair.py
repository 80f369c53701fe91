"""Conversation structure repair: cheapest edits by Dial's bucket queue, the audit by a walk over tight arcs.

A conversation's rows are a line of positions; a node is a position and what stands before it (nothing, s, u or a).  Arcs
are the edits of the row at a position (Keep, Rerole, Delete) and Insert, which stays at the position.  Distances to the
end are found from the end backwards with a queue of buckets, one for each distance, since costs are small integers.  Then
a walk from the start takes, of the arcs that lie on a cheapest path, the one with the least letter; from a node a letter
leads to one node only, so that gives the least audit.

Rows are put in order by one range sort over conversation and turn, so that a long conversation lies in many partitions,
and are cut into blocks of at most BLOCK rows.  A block's costs from each of four states to each of four are a small matrix,
which are put together per conversation; with the distances at its end known, each block is walked by itself.  Only the
digest of the repaired conversation, one string by definition, needs the rows in sequence: one task reads a conversation as
a stream and holds its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What stands before a position: nothing, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
#: log2 of the rows of a block.
BLOCK_BITS = 12
NEXT = (USER, USER, ASSISTANT, USER)  # the role that may follow besides an opening system
FOLLOWS = {USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,), SYSTEM: (NOTHING,)}
INFINITE = 1 << 60
#: Cost of closing the conversation from each state: nothing, or the inserts that are missing.
CLOSING = (0, 2 * INSERT, INSERT, 0)
SPACES = " \t\n\x0b\x0c\r"


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(conv_id:turn) % 20 chooses; nulls count as one space."""
    rows = df.select(column(df, conv_col).cast("long").alias("conv_id"), column(df, turn_col).cast("long").alias("turn"), *[F.coalesce(column(df, c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("times"))
    return rows.where("times > 0").select("conv_id", "turn", "role", "text", F.explode(F.expr("array_repeat(0, times)"))).drop("col")


def distances(codes: list[int], out: Iterable[int]) -> list[int]:
    """Cost from each node (4 * position + state) to the end, where position len(codes) has the costs ``out``.

    A code is 4 * fault + role (a state, or 0 for any other role).
    """
    n = len(codes)
    dist = [INFINITE] * (4 * n + 4)
    buckets: list[list[int]] = []

    def reach(node: int, d: int) -> None:
        if d < dist[node]:
            dist[node] = d
            while len(buckets) <= d - base:
                buckets.append([])
            buckets[d - base].append(node)

    out = list(out)
    base = min(out)
    for state, d in enumerate(out):
        if d < INFINITE:
            reach(4 * n + state, d)
    at = 0
    while at < len(buckets):
        bucket = buckets[at]
        d = base + at
        i = 0
        while i < len(bucket):  # zero costs put nodes into the bucket that is being emptied
            node = bucket[i]
            i += 1
            if dist[node] < d:
                continue
            pos, state = divmod(node, 4)
            if pos < n and state >= USER:
                for s in FOLLOWS[state]:
                    reach(4 * pos + s, d + INSERT)
            if pos:
                fault, role = divmod(codes[pos - 1], 4)
                before = 4 * pos - 4
                reach(before + state, d + DELETE)
                if fault in (SOUND, CUT_OFF) and state:
                    more = TRUNCATED if fault == CUT_OFF else 0
                    for s in FOLLOWS[state]:
                        if role == state:
                            reach(before + s, d + KEEP + more)
                        if state >= USER:
                            reach(before + s, d + REROLE + more)
        buckets[at] = []
        at += 1
    return dist


def walk(codes: list[int], dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least letters of a cheapest path from ``state`` at position 0, and the state it ends in."""
    n, letters, pos = len(codes), [], 0
    while pos < n:
        d = dist[4 * pos + state]
        fault, role = divmod(codes[pos], 4)
        step = 4 * pos + 4
        more = TRUNCATED if fault == CUT_OFF else 0
        follows = NEXT[state]
        if d == DELETE + dist[step + state]:
            letters.append("D")
            pos += 1
        elif d == INSERT + dist[4 * pos + follows]:
            letters.append("I")
            state = follows
        elif role and state in FOLLOWS[role] and d == KEEP + more + dist[step + role]:
            letters.append("K")
            state, pos = role, pos + 1
        else:
            letters.append("R")
            state, pos = follows, pos + 1
    while last and state in (SYSTEM, USER):
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, which rises in the order of conversation, turn (nulls first), role and text."""
    keys = ["c", "turn", "role", "text", "salt"]
    salted = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), "turn", "role", "text", F.monotonically_increasing_id().alias("salt"))
    return salted.repartitionByRange(*keys).sortWithinPartitions(*keys).select("c", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))


def _role(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(NOTHING)


def _blocks(rows: DataFrame) -> DataFrame:
    """(c, block, codes): the rows' roles and first faults, at most 2**BLOCK_BITS a block, in order."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(
        "c", "at", F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256).alias("said"), _role(F.col("role")).alias("r"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("short"),
    )
    first = narrow.groupBy("c", "said").agg(F.min("at").alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(F.col("short"), CUT_OFF).otherwise(SOUND)
    coded = narrow.join(first, ["c", "said"]).select("c", "at", (4 * fault + F.col("r")).alias("code"))
    return (
        coded.groupBy("c", F.shiftright("at", BLOCK_BITS).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("x")).select("c", "block", F.col("x.code").alias("codes"))
    )


def _matrices(blocks: DataFrame) -> DataFrame:
    """(c, block, m, facts): costs from each state before the block to each after it; faults, ends and illegal neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms, facts = [], []
            for codes in b.column(2).to_pylist():
                m = [distances(codes, [0 if s == t else INFINITE for s in range(4)])[:4] for t in range(4)]
                ms.append([m[t][s] for s in range(4) for t in range(4)])
                roles, faults = [x % 4 for x in codes], [x // 4 for x in codes]
                facts.append([faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), sum(map(illegal, roles, roles[1:])), roles[0], roles[-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ms, pa.list_(pa.int64())), pa.array(facts, pa.list_(pa.int64()))], names=["c", "block", "m", "facts"])

    return blocks.mapInArrow(run, "c string, block long, m array<long>, facts array<long>")


def illegal(a: int, b: int) -> bool:
    return (a, b) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _joined(matrices: DataFrame) -> DataFrame:
    """(c, facts, ends): per conversation its faults and cost, and the costs to the end behind each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts, ends = [], []
            for parts in b.column(1).to_pylist():
                out, back = list(CLOSING), []
                for p in reversed(parts):
                    back.append({"block": p["block"], "out": out, "last": not back})
                    out = [min(p["m"][4 * s + t] + out[t] for t in range(4)) for s in range(4)]
                ends.append(back)
                own = [sum(p["facts"][i] for p in parts) for i in range(4)]
                own[3] += sum(illegal(p["facts"][5], q["facts"][4]) for p, q in zip(parts, parts[1:], strict=False))
                facts.append([*own, out[NOTHING]])
            kind = pa.list_(pa.struct([("block", pa.int64()), ("out", pa.list_(pa.int64())), ("last", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(facts, pa.list_(pa.int64())), pa.array(ends, kind)], names=["c", "facts", "ends"])

    grouped = matrices.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "m", "facts"))).alias("parts"))
    return grouped.mapInArrow(run, "c string, facts array<long>, ends array<struct<block:long,out:array<long>,last:boolean>>")


def _walked(blocks: DataFrame, joined: DataFrame) -> DataFrame:
    """(c, block, audits, exits): the letters and the last state for each first state; of a single block for nothing before."""
    ends = joined.select("c", (F.size("ends") > 1).alias("many"), F.explode("ends").alias("e")).select("c", "many", "e.block", "e.out", "e.last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            audits, exits = [], []
            for codes, out, last, many in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                dist = distances(codes, out)
                found = [walk(codes, dist, s, last) for s in (range(4) if many else (NOTHING,))]
                audits.append([f[0] for f in found])
                exits.append([f[1] for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], names=["c", "block", "audits", "exits"])

    return blocks.join(ends, ["c", "block"]).select("c", "block", "codes", "out", "last", "many").mapInArrow(run, "c string, block long, audits array<string>, exits array<int>")


class _Repaired:
    """A conversation read as a stream: its audits by block first, then its rows."""

    def __init__(self):
        self.facts, self.parts, self.entry, self.audit, self.at, self.state, self.digest, self.rows = None, [], NOTHING, "", 0, NOTHING, hashlib.sha256(), 0

    def add_block(self, audits: list[str], exits: list[int]) -> None:
        self.parts.append(audits[self.entry])
        self.entry = exits[self.entry]

    def _say(self, line: str) -> None:
        self.digest.update(("\n" if self.rows else "").encode() + line.encode())
        self.rows += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self._say(("user:", "assistant:")[self.state - USER])
            self.at += 1

    def add_row(self, role: str, text: str) -> None:
        if not self.at and not self.audit:
            self.audit = "".join(self.parts)
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.state = NEXT[self.state]
            role = ("user", "assistant")[self.state - USER]
        elif letter == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        if letter != "D":
            self._say(f"{role}:{text}")

    def end(self) -> tuple:
        self._inserts()
        return (*self.facts, self.audit, self.digest.hexdigest())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _streamed(rows: DataFrame) -> DataFrame:
    """RESULT from (c, kind, at, facts, audits, exits, role, text), of which every conversation is a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, done = None, None, []
        names = [f.split(" ")[0] for f in RESULT.split(", ")]

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return batch

        for b in batches:
            for c, kind, facts, audits, exits, role, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7)), strict=True):
                if c != now:
                    if own is not None:
                        done.append((int(now) if now else None, *own.end()))
                    now, own = c, _Repaired()
                if kind == 0:
                    own.facts = facts
                elif kind == 1:
                    own.add_block(audits, exits)
                else:
                    own.add_row(role, text)
            if len(done) >= 1024:
                yield flush()
        if own is not None:
            done.append((int(now) if now else None, *own.end()))
        if done:
            yield flush()

    order = ["c", "kind", "at"]
    return rows.repartition("c").sortWithinPartitions(*order).select("c", "kind", "at", "facts", "audits", "exits", "role", "text").mapInArrow(run, RESULT)


def repair(df: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """RESULT for each conversation of ``df`` (conv_id, turn, role, text), and zeros for those only in ``conversations``.

    Rows go by turn, nulls first, equal turns by role and text; repeated rows are rows of their own, all but the first of
    which are duplicates.  A null conversation id is a conversation of its own.  Roles count by their first character;
    those other than s, u and a have to be reroled or deleted, as an empty role.  An empty table gives an empty result.  Extra columns
    are ignored.
    """
    rows = cut(_ordered(df))
    blocks = cut(_blocks(rows))
    joined = cut(_joined(_matrices(blocks)))
    audits = _walked(blocks, joined)
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("c").agg(F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"))
    every = (df if conversations is None else conversations).select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("c")).distinct()
    facts = F.concat(F.array(F.coalesce("gaps", F.lit(0).cast("long"))), F.coalesce("facts", F.expr("array(0L, 0L, 0L, 0L, 0L)")))
    heads = every.join(gaps, "c", "left").join(joined.select("c", "facts"), "c", "left").select("c", facts.alias("facts"))
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda d, kind, **has: d.select("c", F.lit(kind).alias("kind"), *[has.get(n, none(t)).alias(n) for n, t in (("at", "long"), ("facts", "array<long>"), ("audits", "array<string>"), ("exits", "array<int>"), ("role", "string"), ("text", "string"))])
    return _streamed(
        shape(heads, 0, facts=F.col("facts")).unionByName(shape(audits, 1, at=F.col("block"), audits=F.col("audits"), exits=F.col("exits"))).unionByName(shape(rows, 2, at=F.col("at"), role=F.col("role"), text=F.col("text")))
    )


def damage_and_repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every conversation of ``df`` damaged as ``damage`` says and repaired; those that lose all rows come out with zeros."""
    return repair(damage(df, conv_col, turn_col, role_col, text_col), df.select(column(df, conv_col).cast("long").alias("conv_id")))
