"""N-gram Jaccard join by T-occurrence search, with connected classes instead of all pairs.

A document's set holds its distinct shingles as 64-bit hashes, by default of three words.  Two sets link when
``100 * |intersection| >= percent * |union|``, by default 90, which is
``(100 - percent) * (|a| + |b|) >= (100 + percent) * |a symmetric difference b|``.

How a link is found, without ever pairing all members of a group of copies:

1. Equal sets are one class (keyed by a digest of the set); only classes go on.
2. DivideSkip: a set's inverted lists are divided into short and long ones.  A partner has ``T`` of a set's n elements,
   ``T = ceil(percent * n / 100)``.  The short lists are those of the ``n - T + OCCURRENCES`` rarest elements (by count
   sketches of the whole corpus' words and shingles, of fixed size), so that a partner stands in OCCURRENCES of them or more.  The
   members of a list become pairs only where their sizes and marks (bits of which linked sets differ in few) allow a
   link; what is left of a query's lists is merged by a heap and what occurs less often is dropped.  The long lists are never read in full: what
   they add to the T occurrences is found by binary probes, of a query's elements in the candidate's sorted set.
3. A short list that turns out to have more than SMALL members is not merged either, but gets a centre, its least
   member, and every other member is probed against the centre, once for all the lists they share.  (A pair in
   fewer than OCCURRENCES merged lists shares such a list.)  Sets that differ from a centre by little are written as
   their difference from what most members have (an element that most differences hold is struck from all, or
   added).  Two members with differences of sizes p and q and o elements common to both differ by ``p + q - 2o``; so
   the search goes on over inverted lists of the differences, which are short where the texts are alike, again with a
   required overlap, prefixes and a bound by position.  The link holds exactly when
   ``k(a) + k(b) <= 2 (100 + percent) o`` with ``k = (100 + percent) * |difference| - (100 - percent) * |set|``: pairs
   that need no overlap at all link through the member of least k, one link each.
4. Members far from the centre get another centre, up to ROUNDS times.  Lists with MERGED members or fewer left are merged
   as well.  Members of longer ones (texts that share a passage, but little else) are searched among themselves by the true lengths of their lists, the shortest first, so that the
   lists of the passage are among the long ones.  As the Jaccard distance is a metric, a centre's class takes everything
   within FAR, and a member leaves the list only when within NEAR, no link between different classes is lost (FAR -
   NEAR is the distance that links allow).
5. Links are joined to components by label propagation with pointer jumping.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .common import column, cut, id_text, merge_slices, release

#: Counters of the sketch of word counts that orders shingles by rarity, and the rows it is moved in.  Its size is fixed:
#: 2 MB where broadcast.  A shingle is as rare as the product of its words' counts is small.
SKETCH_BITS = 21
SLICES = 16
#: Counters of the sketch of shingle counts, which tells passages that many documents share: a shingle whose counter is
#: well above the mean comes after all others, whatever its words.
HOT_BITS, HOT_SLICES = 21, 8
#: A set's sketch has the parity of the number of its hashes in each part; the parts are a power of two, at least LEAST_PARTS
#: and four to eight for each hash.  Sketches differ in no more bits than the sets in elements.
LEAST_PARTS = 512
#: Members of a short list from which on centres are used; in smaller lists all pairs are looked at.
SMALL = 8
#: Rounds of centres at most; when the lists that are left hold no more than PAIRS pairs for each of their members, only those
#: of more than MERGED members get centres.
#: Lists that then have MERGED members or fewer are merged; members of longer ones are searched by the true lengths of
#: their lists.
ROUNDS = 2
MERGED = 256
PAIRS = 32
#: Short lists that linked sets share at least (T less the number of long lists).
OCCURRENCES = 3
NEAR = 0.4
#: Most words of 64 bits in a mark, by which the members of a list are compared before they become pairs, and words compared at once.
MARK_WORDS = 32
BLOCK = 1 << 20
#: Members of a centre's class that are probed in one group.
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, and the percentage of the union that the intersection of linked sets has at least."""

    words: int = 3
    percent: int = 90

    @property
    def apart(self) -> float:
        """The Jaccard distance that links allow."""
        return 1 - self.percent / 100

    @property
    def near(self) -> float:
        return max(NEAR, self.apart)

    @property
    def far(self) -> float:
        return self.near + self.apart

    def short(self, n: int) -> int:
        """How many of a set's lists are short ones: with so many, every partner stands in OCCURRENCES of them."""
        return min(n, n - -(-self.percent * n // 100) + OCCURRENCES)

    def short_sql(self, n: str) -> str:
        return f"least({n}, {n} - ceil({self.percent} * {n} / 100D) + {OCCURRENCES})"

    def needed(self, n: str) -> str:
        """SQL for the occurrences in short lists that a set's partners have at least; its other lists are the long ones."""
        return f"least({OCCURRENCES}, ceil({self.percent} * {n} / 100D))"


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    data, offsets = w.buffers(texts)
    starts, _, hashes = w.words(data, offsets, lower=True)
    first = w.word_offsets(starts, offsets)
    every = w.shingles(hashes, k) if len(hashes) >= k else hashes[:0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield np.array([w.sequence_hash(hashes[a:b])], w.U64)
        else:
            yield every[:0]


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> w.U64(64 - SKETCH_BITS)).astype(np.int64)


def _hot_counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> w.U64(64 - HOT_BITS)).astype(np.int64)


def _ranked_sets(texts: pa.Array, k: int, bits: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The set of each text, and the order of its elements by rarity, the same wherever an element stands."""
    data, offsets = w.buffers(texts)
    starts, _, hashes = w.words(data, offsets, lower=True)
    first = w.word_offsets(starts, offsets)
    if len(hashes) >= k:
        every, weight = w.shingles(hashes, k), bits[_counter(hashes)].astype(np.int64)
        weight = sum(weight[i : len(weight) - k + 1 + i] for i in range(k))
        order = hot[_hot_counter(every)].astype(w.U64) << w.U64(60) | weight.astype(w.U64) << w.U64(52) | every >> w.U64(12)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            s, at = np.unique(every[a : b - k + 1], return_index=True)
            yield s, order[a : b - k + 1][at]
        elif b > a:
            yield np.array([w.sequence_hash(hashes[a:b])], w.U64), np.zeros(1, w.U64)
        else:
            yield hashes[:0], hashes[:0]


def _digest(s: np.ndarray) -> int:
    """The class of a set: the mixed sum of its mixed members, as a signed 64-bit number."""
    return int(w.mix(np.array([w.mix(s ^ w.U64(0x5851F42D4C957F2D)).sum(dtype=w.U64) + w.U64(len(s))], w.U64)).view(np.int64)[0])


def _parities(s: np.ndarray) -> bytes:
    parts = max(LEAST_PARTS, 1 << (4 * len(s) - 1).bit_length())
    counts = np.bincount((s >> w.U64(20)).astype(np.int64) & (parts - 1), minlength=parts)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _summaries(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end the partition's parts of the sketches."""
    sketch, hot = np.zeros(1 << SKETCH_BITS, np.uint32), np.zeros(1 << HOT_BITS, np.uint32)
    names = ["doc_id", "row", "n", "sid", "hist", "slice", "counts"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    some = False
    for batch in w.per_batch(batches):
        n, sid, hist = [], [], []
        for s in _sets(batch.column(1), rule.words):
            d = _digest(s)
            n.append(len(s))
            sid.append(d)
            hist.append(_parities(s))
        data, offsets = w.buffers(batch.column(1))
        hashes = w.words(data, offsets, lower=True)[2]
        np.add.at(sketch, _counter(hashes), 1)
        if len(hashes) >= rule.words:  # windows across two texts do no harm here
            np.add.at(hot, _hot_counter(w.shingles(hashes, rule.words)), 1)
        some = True
        k = len(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x, t) for x, t in zip((n, sid, hist, [None] * k, [None] * k), types, strict=True)]], names=names)
    if some:
        parts = [zlib.compress(x.tobytes(), 1) for x in (*np.split(sketch, SLICES), *np.split(hot, HOT_SLICES))]
        none = [None] * len(parts)
        columns = zip((none, none, none, none, none, list(range(len(parts))), parts), (pa.int64(), pa.int64(), *types), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=names)


def _rarity(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each counter of the words' sketch the bit length of its count, and for each of the shingles' how far it is above the mean."""
    parts = summaries.where("slice is not null").select("slice", F.col("counts").alias("part"))
    got = merge_slices(parts, np.add, np.uint32)

    def whole(first: int, slices: int, bits: int) -> np.ndarray:
        empty = np.zeros((1 << bits) // slices, np.uint32)
        return np.concatenate([got.get(first + i, empty) for i in range(slices)]).astype(float)

    words, hot = whole(0, SLICES, SKETCH_BITS), whole(SLICES, HOT_SLICES, HOT_BITS)
    above = np.floor(2 * np.log2((hot + 1) / (1.5 * (hot.mean() + 8)))) + 1
    return np.ceil(np.log2(words + 1)).astype(np.uint8), np.clip(above, 0, 15).astype(np.uint8)


class _Seen:
    """The digests met of late; a digest that was forgotten only costs another row, which a distinct() drops."""

    def __init__(self, most: int = 1 << 16):
        self.most, self.held = most, set()

    def add(self, digest: int) -> bool:
        """True where the digest is new."""
        if digest in self.held:
            return False
        if len(self.held) >= self.most:
            self.held.clear()
        self.held.add(digest)
        return True


def _short_lists(docs: DataFrame, rarity: tuple[np.ndarray, np.ndarray], rule: Rule) -> DataFrame:
    """(shingle, class): the rarest shingles of every class, so many that it shares OCCURRENCES of them with any partner."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, hot), seen = shared.value, _Seen()
        for batch in w.per_batch(batches):
            keys, ids = [], []
            for s, rank in _ranked_sets(batch.column(1), rule.words, bits, hot):
                n = len(s)
                if not n or not seen.add(d := _digest(s)):
                    continue
                size = rule.short(n)
                keys.append(s[np.argpartition(rank, size - 1)[:size]] if size < n else s)
                ids.append(np.full(len(keys[-1]), d, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["h", "sid"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, sid long")


def _shortest_lists(sets: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(h, sid, n) of the sets' shortest lists among themselves, so many as ``Rule.short`` has it; lists of one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, x in zip(batch.column(0), batch.column(1), strict=True):
                s = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), sid.as_py()))], names=["h", "sid"])

    each = sets.mapInArrow(run, "h long, sid long")
    k = each.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    own = Window.partitionBy("sid")
    return (
        each.join(k, "h").join(sizes, "sid")
        .withColumn("place", F.row_number().over(own.orderBy("k", "h"))).withColumn("all", F.count("*").over(own))
        # a set's other lists, which hold it alone, are the shortest
        .where(f"place <= {rule.short_sql('n')} - (n - all)").select("h", "sid", "n")
    )


def _fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (a row each, in words of 64 bits) of ``width`` words, from longer ones."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _marks(sizes: DataFrame, rule: Rule) -> DataFrame:
    """(sid, mark): each set's sketch, folded to at least four bits for each element that linked sets of this size may differ in.

    Sets without common elements differ in about half of these bits, linked ones in a quarter at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for n, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                most = rule.apart / (2 - rule.apart) * 2 * n
                width = min(MARK_WORDS, 1 << max(0, int(4 * most) // 64).bit_length())
                marks.append(_fold(np.frombuffer(x.as_buffer(), w.U64)[None], width).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["sid", "mark"])

    return sizes.select("sid", "n", "hist").mapInArrow(run, "sid long, mark binary")


def _near_marks(ids: np.ndarray, n: np.ndarray, marks: list[bytes], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs among the members of one list whose sizes and marks allow a link; in blocks, so that a long list is no matter."""
    width = np.array([len(x) // 8 for x in marks])
    of = {int(k): np.flatnonzero(width == k) for k in np.unique(width)}
    words = {k: np.frombuffer(b"".join(marks[i] for i in at), w.U64).reshape(-1, k) for k, at in of.items()}
    limit, least = rule.apart / (2 - rule.apart), rule.percent / 100
    for k, at in of.items():
        for other, to in of.items():
            if other < k:
                continue
            folded = _fold(words[other], k)
            step = max(1, BLOCK // (len(to) * k))
            for i in range(0, len(at), step):
                x, m = at[i : i + step, None], n[at[i : i + step], None]
                ok = np.minimum(m, n[to]) >= least * np.maximum(m, n[to]) - 1e-6
                ok &= ids[x] < ids[to] if other == k else ids[x] != ids[to]
                ok &= np.bitwise_count(words[k][i : i + step, None] ^ folded).sum(axis=2) <= limit * (m + n[to]) + 1e-6
                p, q = np.nonzero(ok)
                yield at[i + p], to[q]


def _meetings(lists: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(sid, h, other, needed): pairs, sid the lesser, that stand together in a list of ``lists`` and that sizes and marks allow.

    A list goes to one task once; its members' marks are compared there, and only what may be a link becomes a row.
    Sets with fewer lists than they need occurrences have no partner.
    """
    own = Window.partitionBy("sid")
    marked = (
        lists.select("h", "sid", "n").withColumn("needed", F.expr(rule.needed("n")).cast("int")).withColumn("has", F.count("*").over(own))
        .where("has >= needed").join(_marks(sizes, rule), "sid").select("h", "sid", "n", "needed", "mark")
    )
    dealt = marked.repartition("h").sortWithinPartitions("h")

    def ends(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of whole lists."""
        rows = pa.Table.from_batches(parts).combine_chunks()
        h, sid, n, needed = (rows.column(i).to_numpy() for i in range(4))
        marks = rows.column(4).to_pylist()
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(first.tolist(), np.append(first[1:], len(h)).tolist(), strict=True):
            if b - a < 2:
                continue
            for x, y in _near_marks(sid[a:b], n[a:b], marks[a:b], rule):
                if len(x):
                    x, y = x + a, y + a
                    x, y = np.where(sid[x] < sid[y], x, y), np.where(sid[x] < sid[y], y, x)
                    found.append((sid[x], h[x], sid[y], needed[x]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=out)

    out = pa.schema([("sid", pa.int64()), ("h", pa.int64()), ("other", pa.int64()), ("needed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a list may go on in the next batch: its members wait for it
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            h = batch.column(0).to_numpy()
            if not len(h):
                continue
            last = int(np.searchsorted(h, h[-1]))
            if last or (waiting and waiting[-1].column(0)[0].as_py() != h[0]):
                yield from ends([*waiting, batch.slice(0, last)])
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield from ends(waiting)

    return dealt.mapInArrow(run, "sid long, h long, other long, needed int")


def _occurrences(lists: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (c, sid), c the lesser, that stand together in as many of ``lists`` (h, sid, n) as a link between them needs.

    Every query gets the members of its lists that may be partners, list by list in the order of their ids; a heap merges
    them, and equal ids that follow one another are the occurrences.
    """
    met = _meetings(lists, sizes, rule).repartition("sid").sortWithinPartitions("sid", "h", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, needed, merged = None, 1, []
        found: list[tuple[int, int]] = []

        def ends() -> None:
            for candidate, times in groupby(heapq.merge(*merged)):
                if sum(1 for _ in times) >= needed:
                    found.append((query, candidate))

        last = None
        for batch in batches:
            for q, h, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != query:
                    ends()
                    query, needed, merged, last = q, t, [], None
                if h != last:
                    merged.append([])
                    last = h
                merged[-1].append(b)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        ends()
        if found:
            yield _pairs(found)

    def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["c", "sid"])

    return met.mapInArrow(run, "c long, sid long")


def _within(pairs: DataFrame, sizes: DataFrame, distance: float) -> DataFrame:
    """Pairs (c, sid) that may be within the Jaccard distance by their sketches; none is lost."""
    limit = distance / (2 - distance)
    both = pairs.join(sizes.select("sid", "n", "hist"), "sid").join(sizes.select(F.col("sid").alias("c"), F.col("n").alias("cn"), F.col("hist").alias("chist")), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            most = limit * (n + m) + 1e-6
            ok = [_least_difference(a, b) <= x for a, b, x in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["c", "sid"]).filter(pa.array(ok, pa.bool_()))

    return both.select("c", "sid", "n", "cn", "hist", "chist").mapInArrow(run, "c long, sid long")


def _places(ids: pa.Array, bits: int) -> np.ndarray:
    """Bits of the map for ids; null is as good as 0 here."""
    x = np.asarray(ids.cast(pa.int64()).fill_null(0), np.int64).view(w.U64)
    return (w.mix(x + w.U64(1)) >> w.U64(64 - bits)).astype(np.int64)


def _candidate_sets(docs: DataFrame, ids: DataFrame, rule: Rule, bits: int = 23) -> DataFrame:
    """(sid, elements), one row a class, of the classes in ``ids`` (sid, doc: the least id of its rows).

    A bit map of those ids, of fixed size (1 MB) and put together on the executors, says which texts to look at; the
    join on the class then is exact.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = _places(batch.column(0), bits)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = np.split(table, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts])], names=["slice", "part"])

    got = merge_slices(ids.select("doc").mapInArrow(marks, "slice int, part binary"), np.bitwise_or, np.uint8)
    empty = np.zeros((1 << (bits - 3)) // SLICES, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(np.concatenate([got.get(i, empty) for i in range(SLICES)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, _Seen()
        for whole_batch in batches:
            at = _places(whole_batch.column(0), bits)
            chosen = whole_batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for batch in w.per_batch([chosen]):
                sids, sets = [], []
                for s in _sets(batch.column(1), rule.words):
                    if len(s) and seen.add(d := _digest(s)):
                        sids.append(d)
                        sets.append(s.tobytes())
                if sids:
                    yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "elements"])

    found = docs.select("doc_id", "text").mapInArrow(run, "sid long, elements binary")
    return found.join(ids.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])


def _probe(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """For pairs (c, sid) the sizes, the size of the symmetric difference and the difference itself, with part and groups.

    The members of one centre are dealt out in groups of about CHUNK, and the centre's set goes to each group.  The
    difference has the elements that the centre lacks first, since these are the rarer.
    """
    groups = pairs.groupBy("c").agg(F.count("*").alias("k")).select("c", F.ceil(F.col("k") / CHUNK).cast("int").alias("groups"))
    member = (
        pairs.join(groups, "c").select("c", F.pmod(F.xxhash64("sid"), F.col("groups")).cast("int").alias("part"), "sid", "groups")
        .join(sets, "sid").select("c", "part", "sid", "elements", F.lit(1).alias("kind"), "groups")
    )
    centre = (
        groups.join(sets.withColumnRenamed("sid", "c"), "c")
        .select("c", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("c").alias("sid"), "elements", F.lit(0).alias("kind"), "groups")
    )
    dealt = member.unionByName(centre).repartition("c", "part").sortWithinPartitions("c", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, w.U64)
        for batch in batches:
            out: list[tuple] = []
            for c, part, sid, x, kind, groups in zip(*(batch.column(i).to_pylist() if i != 3 else batch.column(i) for i in range(6)), strict=True):
                s = np.frombuffer(x.as_buffer(), w.U64)
                if kind == 0:
                    own = s.copy()
                    continue
                at = np.searchsorted(own, s)  # the binary probes
                hit = own[np.minimum(at, len(own) - 1)] == s
                common = int(hit.sum())
                size = len(s) + len(own) - 2 * common
                near = size <= rule.far / (2 - rule.far) * (len(s) + len(own)) + 1e-6
                if near:
                    missing = np.ones(len(own), bool)
                    missing[at[hit]] = False
                    out.append((c, part, groups, sid, len(s), len(own), size, np.concatenate([s[~hit], own[missing]]).view(np.int64)))
                else:
                    out.append((c, part, groups, sid, len(s), len(own), size, None))
            if out:
                cols = list(zip(*out, strict=True))
                names = ["c", "part", "groups", "sid", "n", "cn", "size", "diff"]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:7]], pa.array(list(cols[7]), pa.list_(pa.int64()))], names=names)

    return dealt.mapInArrow(run, "c long, part long, groups long, sid long, n long, cn long, size long, diff array<long>")


def _links_by_difference(near: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) among the members of every centre's class, from their differences; the centre itself is a member."""
    overlap = 2 * (100 + rule.percent)
    # what belongs to a centre goes to each of the groups that its members are dealt out in, so that no class meets in one task
    of = lambda df: df.withColumn("part", F.explode(F.expr("sequence(0L, groups - 1)"))).drop("groups")
    sizes = near.groupBy("c").agg(F.count("*").alias("m"), F.max("groups").alias("groups"), F.max("cn").alias("n"))
    usual = (
        near.select("c", F.explode("diff").alias("x")).groupBy("c", "x").agg(F.count("*").alias("k")).where("k > 1")
        .join(sizes.select("c", "m", "groups"), "c").where("2 * k > m + 1").groupBy("c", "groups").agg(F.collect_list("x").alias("usual"))
    )
    centres = sizes.select("c", F.pmod(F.xxhash64("c"), F.col("groups")).alias("part"), "groups", F.col("c").alias("sid"), "n", F.lit(0).cast("long").alias("size"), F.array().cast("array<long>").alias("diff"))
    members = (
        near.select("c", "part", "groups", "sid", "n", "size", "diff").unionByName(centres).join(of(usual).hint("merge"), ["c", "part"], "left")
        .withColumn("diff", F.when(F.col("usual").isNull(), F.col("diff")).otherwise(F.concat(F.array_except("diff", "usual"), F.array_except("usual", "diff"))))
        .withColumn("size", F.size("diff").cast("long")).drop("usual")
        .withColumn("k", (100 + rule.percent) * F.col("size") - (100 - rule.percent) * F.col("n"))
    )
    members = cut(members)  # used five times below
    least = members.groupBy("c").agg(F.min("k").alias("low"), F.min_by("sid", F.struct("k", "sid")).alias("hub"), F.max("groups").alias("groups"))
    placed = members.drop("groups").join(of(least).hint("merge"), ["c", "part"])
    plain = placed.where("k + low <= 0 and sid <> hub").select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    # the prefix of a difference has its shortest lists: first the elements that no other member's has, which need no list
    each = (
        placed.withColumn("zero", F.expr("k + low <= 0"))
        .withColumn("required", F.greatest(F.lit(1), F.ceil((F.col("k") + F.col("low")) / overlap)))
        .where("size >= required").select("c", "sid", "size", "k", "zero", "required", F.explode("diff").alias("h"))
    )
    met = each.groupBy("c", "h").agg(F.count("*").alias("times"), F.bool_or(~F.col("zero")).alias("open")).where("times > 1 and open").drop("open")
    own = Window.partitionBy("c", "sid")
    rest = (
        each.join(met.hint("merge"), ["c", "h"])
        .withColumn("place", F.row_number().over(own.orderBy("times", "h"))).withColumn("all", F.count("*").over(own))
        .withColumn("left", F.expr("all - place + 1"))  # elements from here on that others have too
        .where("left >= required").select("c", "h", "sid", "k", "zero", "left")
    )
    x, y = (rest.select("c", "h", *[F.col(f).alias(f"{f}_{s}") for f in ("sid", "k", "zero", "left")]) for s in "ab")
    pairs = (
        x.where("not zero_a").join(y.hint("merge"), ["c", "h"])
        .where(f"(zero_b or sid_a < sid_b) and {overlap} * least(left_a, left_b) >= k_a + k_b")
        .select("c", "sid_a", "sid_b").distinct()
    )
    side = lambda s: members.select("c", F.col("sid").alias(f"sid_{s}"), F.col("k").alias(f"k_{s}"), F.col("diff").alias(f"diff_{s}"))
    checked = (
        pairs.join(side("a").hint("merge"), ["c", "sid_a"]).join(side("b").hint("merge"), ["c", "sid_b"])
        .where(f"k_a + k_b <= {overlap} * size(array_intersect(diff_a, diff_b))")
        .select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))
    )
    return plain.unionByName(checked)


# Joins on two values are hinted to be by sort and merge: a broadcast relation of several values takes 64 MB of the driver
# and of every executor, however small it is.


def links(docs: DataFrame, summaries: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between classes, enough to connect whatever is connected by links; each is a true link."""
    sizes = cut(summaries.where("slice is null and n > 0").groupBy("sid").agg(F.max("n").alias("n"), F.max("hist").alias("hist"), F.min("doc_id").alias("doc")))
    # the filter that the joins imply stands here, so that both uses of the lists have one plan and one exchange
    lists = _short_lists(docs, _rarity(summaries), rule).where("h is not null and sid is not null").distinct()
    shared = lists.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    every = cut(lists.join(shared, "h").join(sizes.select("sid", "n"), "sid").select("h", "sid", "n", "k"))
    del lists, shared
    release(docs.sparkSession)

    def probed(pairs: DataFrame, distance: float) -> DataFrame:
        pairs = cut(_within(pairs, sizes, distance))
        ids = pairs.select("c").unionByName(pairs.select(F.col("sid").alias("c"))).distinct().withColumnRenamed("c", "sid")
        sets = cut(_candidate_sets(docs, ids.join(sizes.select("sid", "doc"), "sid"), rule))
        out = cut(_probe(pairs, sets, rule))
        del pairs, ids, sets
        release(docs.sparkSession)
        return out

    def true_links(p: DataFrame) -> DataFrame:
        return p.where(f"{100 - rule.percent} * (n + cn) >= {100 + rule.percent} * size").select(F.col("c").alias("a"), F.col("sid").alias("b"))

    few = every.where(F.col("k") <= SMALL).select("h", "sid", "n")
    active = every.where(F.col("k") > SMALL).select("h", "sid", "n")
    found = []
    for _ in range(ROUNDS):
        k = active.groupBy("h").agg(F.count("*").alias("k"))
        pairs_left = k.agg(F.sum("k"), F.sum(F.col("k") * (F.col("k") - 1) / 2), F.max("k")).first()
        if not pairs_left[0]:
            break
        if pairs_left[1] <= PAIRS * pairs_left[0]:
            # few pairs on the whole: only the lists that are too long to be merged get centres
            if pairs_left[2] <= MERGED:
                break
            sized = active.join(k, "h")
            few = few.unionByName(sized.where(F.col("k") <= MERGED).drop("k"))
            active = cut(sized.where(F.col("k") > MERGED).drop("k"))
        centre = active.groupBy("h").agg(F.min("sid").alias("c"), F.min_by("n", "sid").alias("cn"))
        ratio = f"least(n, cn) >= {1 - rule.far}D * greatest(n, cn) - 1e-6D"
        pairs = active.join(centre, "h").where(f"sid <> c and {ratio}").select("c", "sid").distinct()
        measured = probed(pairs, rule.far)
        found.append(cut(_links_by_difference(measured.where("diff is not null"), rule)))  # one plan a round, not one of all
        covered = measured.where(f"size <= {rule.near / (2 - rule.near)} * (n + cn)").select("c", "sid")
        done = active.join(centre.select("h", "c"), "h").join(covered.hint("merge"), ["c", "sid"], "left_semi").select("h", "sid")
        done = done.unionByName(centre.select("h", F.col("c").alias("sid")))
        left = active.join(done.hint("merge"), ["h", "sid"], "left_anti")
        many = left.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
        active = cut(left.join(many, "h"))
        del pairs, measured, covered, done, left, many, centre
        release(docs.sparkSession)
    k = active.groupBy("h").agg(F.count("*").alias("k"))
    sized = active.join(k, "h")
    pairs = _occurrences(few.unionByName(sized.where(F.col("k") <= MERGED).drop("k")), sizes, rule)
    left = cut(sized.where(F.col("k") > MERGED).select("sid", "n").distinct())
    if not left.isEmpty():
        sets = cut(_candidate_sets(docs, left.join(sizes.select("sid", "doc"), "sid").select("sid", "doc"), rule))
        pairs = pairs.unionByName(_occurrences(_shortest_lists(sets, left, rule), sizes, rule)).distinct()
    found.append(true_links(probed(pairs, rule.apart)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    out = cut(out.distinct())
    del found, few, active, every, sized, pairs
    release(docs.sparkSession)
    return out


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sid, component) of all ``nodes`` (sid, doc) that an edge touches: the least doc of the connected nodes.

    Labels go along the edges and then jump to the label of the label, until none changes.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    touched = both.select(F.col("a").alias("sid")).distinct()
    label = cut(nodes.join(touched, "sid").select("sid", F.col("doc").alias("doc"), F.col("sid").alias("root")))
    while True:
        near = (
            both.join(label.withColumnRenamed("sid", "b"), "b").groupBy("a")
            .agg(F.min(F.struct("doc", "root")).alias("best")).withColumnRenamed("a", "sid")
        )
        moved = label.join(near, "sid").select("sid", F.least(F.struct("doc", "root"), F.col("best")).alias("best"), F.col("root").alias("old"))
        moved = moved.select("sid", "best.doc", "best.root", "old")
        jump = label.select(F.col("sid").alias("root"), F.struct("doc", F.col("root").alias("r")).alias("next"))
        new = cut(
            moved.join(jump, "root").select("sid", F.least(F.struct("doc", F.col("root").alias("r")), F.col("next")).alias("x"), "old")
            .select("sid", F.col("x.doc").alias("doc"), F.col("x.r").alias("root"), "old")
        )
        changed = new.where("root <> old").limit(1).count()
        label = new.select("sid", "doc", "root")
        if not changed:
            return label.select("sid", F.col("doc").alias("component_id"))


def _classes(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    own = id_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "row")
    summaries = cut(own.mapInArrow(lambda it: _summaries(it, rule), "doc_id long, row long, n long, sid long, hist binary, slice int, counts binary"))
    rows = summaries.where("slice is null").select("doc_id", "row", "n", "sid")
    groups = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.count("*").alias("k"))
    linked = components(links(own, summaries, rule), groups.select("sid", "doc"))
    # only classes of several rows or with links are joined; each goes out in copies, so that a large one is spread
    salt = 16
    of = (
        groups.join(linked, "sid", "left").where("k > 1 or component_id is not null")
        .select("sid", F.coalesce("component_id", "doc").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"))
    )
    return (
        rows.withColumn("salt", F.when(F.col("n") > 0, F.pmod(F.xxhash64("doc_id", "row"), F.lit(salt)).cast("int")))
        .join(of.hint("merge"), ["sid", "salt"], "left")
        .select("doc_id", "row", "sid", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Null and wordless texts have no shingles and link with nothing; texts of fewer words than a shingle have one.
    Repeated rows and equal texts are members of one class.  An empty table gives an empty result.  Extra columns are
    ignored.
    """
    return _classes(docs, id_col, text_col, Rule(words, percent)).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the document of the least id of each class; columns as they were.

    Wordless and null texts link with nothing and stay.  Of rows equal in id and text one stays, unless wordless.
    """
    own = cut(_classes(docs, id_col, text_col, Rule(words, percent)))
    chosen = (
        own.where("n_shingles > 0 and component_id <=> doc_id").groupBy("doc_id", "sid")
        .agg(F.min("row").alias("__row"), F.count("*").alias("__k")).select(F.col("doc_id").alias("__id"), "__row", "__k")
    )
    bare = own.where("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.lit(1).cast("long").alias("__k")).distinct()
    kept = chosen.unionByName(bare)
    # the document goes along as one value, so that none of its columns' names can clash
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("d"), column(docs, id_col).cast("long").alias("i"), F.xxhash64(column(docs, text_col).cast("string")).alias("x"))
    rows = rows.join(kept.hint("merge"), F.col("i").eqNullSafe(F.col("__id")) & (F.col("x") == F.col("__row")))
    if chosen.where("__k > 1").isEmpty():
        return rows.select("d.*")
    # rows that come several times are numbered by id and text; the others keep out of it
    order = Window.partitionBy("__id", "__row").orderBy("__row")
    many = rows.where("__k > 1").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return rows.where("__k = 1").unionByName(many).select("d.*")
