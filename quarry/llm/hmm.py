"""A hidden Markov language model: Baum-Welch over all training texts, exact scoring by the scaled forward recursion.

States emit classes, and a class emits its words.  The HEAD most frequent training words are classes of their own; every
other word belongs to one of TAILS classes by its last two bytes.  A text is a walk of states, one a token with the end
as the last, so its probability is ``sum over walks`` of transitions times class emissions, times for each token the
probability of the word in its class.  The last factor doesn't depend on the walk: 1 for a head word, else
``(c + 0.1) / (N_class + 0.1 * (V_class + 1))`` from the counts of all training texts, so every text has a probability
above 0 and those of all words sum to 1 but for the share that stands for words not seen.

Counting: each partition counts its words, a sum by word follows (skewed words are added up before).  The DICTIONARY most
frequent words go to every task, a table of fixed size; counts of the others reach the texts by a join on the word.
Baum-Welch: each partition adds up the expected transitions and emissions of its texts, arrays of fixed size which are
added up by slices; the new parameters come from the sums.

The recursion is run over many texts at a time.  A text is cut into chunks; for each chunk the product of its matrices is
computed (all chunks in step), forward and backward vectors go over the chunks of a text, and then through all chunks in step
again.  Products are scaled at each token, their logarithms added up: the likelihood is exact, whatever the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import cut, id_text, merge_slices

STATES = 4
ITERATIONS = 4
HEAD = 1 << 15
TAILS = 256
DICTIONARY = 1 << 18
CHUNK = 48
SLICES = 8
SEED = 41
SMOOTH = 0.1
#: The class of the end, and that of tail k.
END, TAIL = 0, 1


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a batch's texts, the tail class of each, and for each text the index of its first word."""
    data, offsets = w.buffers(batch.column(1))
    starts, ends, hashes = w.words(data, offsets, lower=True)
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    last, before = (np.where((x >= 65) & (x <= 90), x + 32, x) for x in (last, before))
    return hashes.view(np.int64), (w.mix((last * 256 + before).astype(w.U64)) % w.U64(TAILS)).astype(np.int64), w.word_offsets(starts, offsets)


def _is_training(ids: pa.Array) -> np.ndarray:
    """Whether crc32 of each id as text leaves a remainder by ten; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 10 != 0 for x in ids.to_pylist()], bool)


def word_counts(own: DataFrame) -> DataFrame:
    """(h, tail, n): every word of the training texts and how often it comes; h null: ends, that is texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = ends = 0

        def merged() -> tuple:
            h, t, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, at = np.unique(h, return_index=True, return_inverse=True)
            return u, t[first], np.bincount(at, n, minlength=len(u)).astype(np.int64)

        def out(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], names=["h", "tail", "n"])

        for batch in w.per_batch(batches):
            train = _is_training(batch.column(0))
            batch = batch.filter(pa.array(train))
            ends += len(batch)
            h, t, _ = _tokens(batch)
            if not len(h):
                continue
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, t[first], n))
            size += len(u)
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(merged())
        if ends:
            yield out(([None], [0], [ends]))

    return own.mapInArrow(count, "h long, tail long, n long").groupBy("h").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words (sorted hashes), their counts and classes, and the sums over all words."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    types: int
    ends: int
    tail_tokens: np.ndarray
    tail_types: np.ndarray

    @property
    def n_classes(self) -> int:
        return TAIL + TAILS + HEAD

    def look_up(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count (-1: not in the dictionary), class and place in the dictionary of each word."""
        if not len(self.hashes):
            return np.full(len(h), -1), TAIL + tail, np.zeros(len(h), np.int64)
        u, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, u), len(self.hashes) - 1)
        found = (self.hashes[at] == u)[back]
        at = at[back]
        kind = self.classes[at]
        return np.where(found, self.counts[at], -1), np.where(found & (kind >= 0), kind, TAIL + tail), at


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collects the DICTIONARY most frequent words, and the sums of the tail classes."""
    whole = counts.where("h is not null").agg(F.sum("n"), F.count("*")).first()
    ends = counts.where("h is null").agg(F.sum("n")).first()[0] or 0
    # the cut lets the partitions' best meet on an executor, and the driver get the DICTIONARY alone
    top = cut(counts.where("h is not null").orderBy(F.col("n").desc(), "h").limit(DICTIONARY)).toPandas()
    top = top.sort_values(["n", "h"], ascending=[False, True], kind="stable")
    classes = np.full(len(top), -1)
    classes[: min(HEAD, len(top))] = TAIL + TAILS + np.arange(min(HEAD, len(top)))
    order = np.argsort(top["h"].to_numpy(np.int64))
    h, n, t = (top[c].to_numpy(np.int64) for c in ("h", "n", "tail"))
    tails = counts.where("h is not null").groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tail_tokens, tail_types = np.zeros(TAILS), np.zeros(TAILS)
    for r in tails:
        tail_tokens[r["tail"]], tail_types[r["tail"]] = r["n"], r["v"]
    head = classes >= 0  # head words are classes of their own and leave the tails
    tail_tokens -= np.bincount(t[head], n[head], minlength=TAILS)
    tail_types -= np.bincount(t[head], minlength=TAILS)
    return Vocabulary(h[order], n[order], classes[order], (whole[0] or 0) + ends, (whole[1] or 0) + (1 if ends else 0), ends, tail_tokens, tail_types)


@dataclass
class Parameters:
    """Distribution before the first token, transitions, and emissions by class and state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def initial(v: Vocabulary) -> Parameters:
    """Sticky states whose emissions are those of the counts, each class turned towards some state by a seeded draw."""
    rng = np.random.default_rng(SEED)
    mass = np.zeros(v.n_classes)
    mass[END] = v.ends + SMOOTH
    mass[TAIL : TAIL + TAILS] = v.tail_tokens + SMOOTH
    known = v.classes >= 0
    mass[v.classes[known]] = v.counts[known]
    # words with the same rough ending tend to belong together, so the tilt is drawn by class
    tilt = rng.gamma(1.0, size=(v.n_classes, STATES)) + 0.2
    emit = mass[:, None] * tilt
    move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1)) if STATES > 1 else np.ones((1, 1))
    if STATES > 1:
        np.fill_diagonal(move, 0.9)
    return Parameters(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def _chunks(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' classes laid out by chunk (longest chunks first), chunk lengths, and each chunk's text and number."""
    text, number, rows, sizes = [], [], [], []
    for i, c in enumerate(classes):
        for k in range(0, len(c), CHUNK):
            text.append(i)
            number.append(k // CHUNK)
            rows.append(c[k : k + CHUNK])
            sizes.append(len(rows[-1]))
    sizes = np.array(sizes)
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((len(rows), CHUNK), np.int64)
    for at, r in enumerate(order):
        grid[at, : sizes[r]] = rows[r]
    return grid, sizes[order], np.array(text)[order], np.array(number)[order]


def forward(classes: list[np.ndarray], p: Parameters, expect: bool = False):
    """Log likelihood (natural) of each text's class sequence; with ``expect`` also the expected counts of all texts."""
    k, n = STATES, len(classes)
    grid, sizes, text, number = _chunks(classes)
    m = len(grid)
    active = np.searchsorted(-sizes, -np.arange(1, CHUNK + 1), "right")  # chunks that have a token at each step
    product, scale = np.tile(np.eye(k), (m, 1, 1)), np.zeros(m)
    for t in range(CHUNK):
        a = active[t]
        if not a:
            break
        x = (product[:a].reshape(-1, k) @ p.move).reshape(a, k, k) * p.emit[grid[:a, t]][:, None, :]
        s = x.sum((1, 2))
        product[:a] = x / s[:, None, None]
        scale[:a] += np.log(s)
    # over the chunks of each text: the vector before a chunk, and after the last one the likelihood
    most = int(number.max()) + 1
    by = np.full((n, most), -1)
    by[text, number] = np.arange(m)
    before = np.zeros((m, k))
    vector, log = np.tile(p.start, (n, 1)), np.zeros(n)
    order = np.argsort(-(by >= 0).sum(1), kind="stable")
    by = by[order]
    have = (by >= 0).sum(0)
    vector = vector[order]
    total = log[order]
    for c in range(most):
        at = by[: have[c], c]
        before[at] = vector[: have[c]]
        x = np.einsum("ni,nij->nj", vector[: have[c]], product[at])
        s = x.sum(1)
        vector[: have[c]] = x / s[:, None]
        total[: have[c]] += np.log(s) + scale[at]
    log[order] = total
    if not expect:
        return log
    after = np.ones((m, k))  # the backward vector at each chunk's end, up to a factor
    back = np.ones((n, k))
    for c in range(most - 1, -1, -1):
        at = by[: have[c], c]
        after[at] = back[: have[c]]
        x = np.einsum("nij,nj->ni", product[at], back[: have[c]])
        back[: have[c]] = x / x.sum(1)[:, None]
    first = by[:, 0]
    start = vector_start = p.start * back  # the distribution before the first token, given the text
    start = (vector_start / vector_start.sum(1)[:, None]).sum(0)
    del first
    alphas = np.zeros((CHUNK + 1, m, k))
    alphas[0] = before
    for t in range(CHUNK):
        a = active[t]
        if not a:
            break
        x = (alphas[t, :a] @ p.move) * p.emit[grid[:a, t]]
        alphas[t + 1, :a] = x / x.sum(1)[:, None]
    beta, moves, emits = after.copy(), np.zeros((k, k)), np.zeros((len(p.emit), k))
    for t in range(CHUNK - 1, -1, -1):
        a = active[t]
        if not a:
            continue
        seen = p.emit[grid[:a, t]] * beta[:a]
        pair = alphas[t, :a] @ p.move * seen
        norm = pair.sum(1)[:, None]
        gamma = pair / norm
        moves += p.move * (alphas[t, :a].T @ (seen / norm))
        for j in range(k):
            emits[:, j] += np.bincount(grid[:a, t], gamma[:, j], minlength=len(emits))
        x = seen @ p.move.T
        beta[:a] = x / x.sum(1)[:, None]
    return log, start, moves, emits


def _encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Each text's classes as 16-bit numbers, the sums over its dictionary words, and its other words with their counts."""
    rare_type = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("tail", pa.int32())]))
    below = v.tokens + SMOOTH * (v.types + 1)
    end = np.log10((v.ends + SMOOTH) / below)
    base_of = np.log10((v.counts + SMOOTH) / below)
    for batch in w.per_batch(batches):
        h, tail, first = _tokens(batch)
        count, kind, at = v.look_up(h, tail)
        found = count >= 0
        base = np.where(found, base_of[at] if len(base_of) else 0.0, 0.0)
        # of a word of a tail class, its probability there
        in_tail = np.flatnonzero(found & (kind < TAIL + TAILS))
        own = np.zeros(len(h))
        own[in_tail] = np.log10((count[in_tail] + SMOOTH) / (v.tail_tokens + SMOOTH * (v.tail_types + 1))[tail[in_tail]])
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (base, own)]
        base, own = (x[first[1:]] - x[first[:-1]] for x in sums)
        known = np.concatenate([[0], np.cumsum(found)])
        known = known[first[1:]] - known[first[:-1]] + (v.ends > 0)
        rare, classes, kind = [], [], kind.astype(np.uint16)
        missing = np.flatnonzero(~found)
        cuts = np.searchsorted(missing, first)
        for i in range(len(batch)):
            classes.append(kind[first[i] : first[i + 1]].tobytes())
            m = missing[cuts[i] : cuts[i + 1]]
            u, j, n = np.unique(h[m], return_index=True, return_counts=True)
            rare.append([{"h": x, "n": y, "tail": z} for x, y, z in zip(u.tolist(), n.tolist(), tail[m[j]].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2), pa.array(~_is_training(batch.column(0))), pa.array(np.diff(first) + 1, pa.int64()), pa.array(known, pa.int64()),
                pa.array(base + end, pa.float64()), pa.array(own, pa.float64()), pa.array(rare, rare_type), pa.array(classes, pa.binary()),
            ],
            names=["doc_id", "row", "held_out", "n_tokens", "n_known", "base", "own", "rare", "classes"],
        )


ENCODED = "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, own double, rare array<struct<h:long,n:int,tail:int>>, classes binary"
#: Texts and tokens that the recursion takes at a time.
TEXTS, TOKENS = 1024, 400_000


def _sequences(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, class sequences with the end) of groups of texts."""
    group: list[np.ndarray] = []
    at = size = 0
    for i, x in enumerate(column.to_pylist()):
        seq = np.append(np.frombuffer(x, np.uint16).astype(np.int64), END)
        if group and (len(group) == TEXTS or size + len(seq) > TOKENS):
            yield at, group
            at, group, size = i, [], 0
        group.append(seq)
        size += len(seq)
    if group:
        yield at, group


def train(encoded: DataFrame, v: Vocabulary, iterations: int = ITERATIONS) -> Parameters:
    """Baum-Welch over the classes of all training texts; each iteration is a pass over them."""
    sc = encoded.sparkSession.sparkContext
    p, n_classes = initial(v), v.n_classes
    own = encoded.where("not held_out").select("classes")

    for _ in range(iterations):
        shared = sc.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            par = shared.value
            start, moves, emits, some = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((n_classes, STATES)), False
            for batch in batches:
                for _, group in _sequences(batch.column(0)):
                    _, s, m, e = forward(group, par, expect=True)
                    start, moves, some = start + s, moves + m, True
                    emits += e
            if some:
                parts = [x.astype(np.float64).tobytes() for x in np.array_split(emits, SLICES)] + [np.concatenate([start, moves.ravel()]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES + 1), pa.int32()), pa.array([zlib.compress(x, 1) for x in parts])], names=["slice", "part"])

        got = merge_slices(own.mapInArrow(expect, "slice int, part binary"), np.add, np.float64)
        shared.unpersist()
        if not got:
            break
        emits = np.concatenate([got[i] for i in range(SLICES)]).reshape(-1, STATES) + SMOOTH / STATES
        start, moves = got[SLICES][:STATES] + 1e-3, got[SLICES][STATES:].reshape(STATES, STATES) + 1e-3
        p = Parameters(start / start.sum(), moves / moves.sum(1)[:, None], emits / emits.sum(0))
    return p


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Null texts count as empty: one token, the end.  Without training texts every token is unknown.  Rows equal in id
    and text are scored alike, each a row of its own.  An empty table gives an empty result.  Extra columns are ignored.
    """
    own = id_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "row")
    counts = cut(word_counts(own))
    v = vocabulary(counts)
    sc = own.sparkSession.sparkContext
    words = sc.broadcast(v)
    encoded = cut(own.mapInArrow(lambda batches: _encoded(batches, words.value), ENCODED))
    shared = sc.broadcast(train(encoded, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            log = np.zeros(len(batch))
            for at, group in _sequences(batch.column(7)):
                log[at : at + len(group)] = forward(group, shared.value)
            score = log / np.log(10.0) + np.asarray(batch.column(6))
            names = ["doc_id", "row", "held_out", "n_tokens", "n_known", "base", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(score)], names=names)

    scored = encoded.select("doc_id", "row", "held_out", "n_tokens", "n_known", "base", "own", "classes").mapInArrow(
        run, "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    # words that aren't in the dictionary get their counts by a join; none of them is frequent
    below = v.tokens + SMOOTH * (v.types + 1)
    tails = F.array(*[F.lit(float(x)) for x in v.tail_tokens + SMOOTH * (v.tail_types + 1)])
    rare = encoded.select("doc_id", "row", F.explode("rare").alias("w")).distinct().select("doc_id", "row", "w.h", F.col("w.n").alias("k"), F.col("w.tail").alias("t"))
    found = (
        rare.join(counts.where("h is not null").select("h", "n"), "h", "left")
        .groupBy("doc_id", "row").agg(
            F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + SMOOTH) / float(below))).alias("b"),
            F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + SMOOTH) / F.element_at(tails, F.col("t") + 1))).alias("s"),
            F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("m"),
        ).withColumnsRenamed({"doc_id": "d", "row": "r"})
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("m")).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )
