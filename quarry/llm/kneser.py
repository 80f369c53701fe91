"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Trained on all labelled trusted documents (quality 1, not toxic) but a quarter, by a seeded hash, which is held out.  Counts are
dealt by the n-gram's hash: counts of trigrams, counts of what follows each context, and numbers of distinct
continuations, each a grouping or join of the one before.

The log probability of a text is a sum over its n-grams of one number each, so that no token needs to meet more than one
table.  With p(w|uv) = share(uvw) + rest(uv) p(w|v), and so down to words, whose floor any word has:

    log p(w|uv) = log(1 + share(uvw) / (rest(uv) p(w|v))) + log rest(uv)
                + log(1 + share(vw) / (rest(v) p(w))) + log rest(v) + log(p(w) / floor) + log floor

and what is not in the model adds nothing.  These numbers are dealt by the n-gram's hash; the n-grams of the documents go to them,
in rounds of documents, packed to blocks, and the sums come back by document.

A document's perplexity is compared with a quantile of its language: that of the trusted documents of this language
that were held out.  Languages with fewer than LEAST of these use the quantile over all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .common import WORD_JAVA, bounded_batches, column, cut, release

QUANTILE = 0.99
#: The quantile is widened by this factor, so that documents just beyond the trusted ones stay.
MARGIN = 1.1
LEAST = 50
HELD_OUT = 4
SEED = 53
START, END = 0x1234567, 0x89ABCDE
#: Documents are scored in rounds of about so many tokens, ROUNDS at most (each reads all rows, and splits and sends its own).
ROUND_TOKENS, ROUNDS = 1_000_000, 16
#: Numbers of the model that one task holds, about.
SHARD = 500_000
#: So many trusted ids are broadcast; more are joined.
FEW = 1_000_000


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return w.mix(a * w.U64(0x9E3779B97F4A7C15) + w.mix(b))


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """u, v, w of every token of all texts (two starts before each text, an end after it) and the first index of each text."""
    data, offsets = w.buffers(texts)
    starts, _, hashes = w.words(data, offsets, lower=True)
    first = w.word_offsets(starts, offsets)
    n = len(first) - 1
    # each text's words between two starts and an end
    size = np.diff(first)
    begin = first[:-1] + 3 * np.arange(n)
    total = np.full(len(hashes) + 3 * n, START, w.U64)
    total[np.arange(len(hashes)) + np.repeat(3 * np.arange(n) + 2, size)] = hashes
    total[begin + size + 2] = END
    at = np.arange(len(hashes) + n) + np.repeat(2 * np.arange(n) + 2, size + 1)
    return total[at - 2], total[at - 1], total[at], np.append(first[:-1] + np.arange(n), len(at))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(u, v, w, n) of the texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.per_batch(batches):
            u, v, x, _ = _ngrams(batch.column(batch.schema.get_field_index("text")))
            if len(u):
                yield pa.RecordBatch.from_arrays([_signed(u), _signed(v), _signed(x)], names=["u", "v", "w"])

    # dealt by context once, for this grouping and for the sums over each context
    rows = docs.select("doc_id", "text").mapInArrow(run, "u long, v long, w long")
    return rows.repartition("u", "v").groupBy("u", "v", "w").agg(F.count("*").alias("n"))


def _discounts(counts: DataFrame, n: str) -> tuple[float, float, float]:
    """The three discounts of an order, from how many n-grams come once, twice, three and four times."""
    row = counts.agg(*[F.sum(F.when(F.col(n) == k, 1).otherwise(0)).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in row)
    if not n1 or not n2:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def _order(grams: DataFrame, context: list[str], n: str) -> tuple[DataFrame, DataFrame]:
    """Discounted shares of the n-grams, and the mass that each context leaves to the order below."""
    d = _discounts(grams, n)
    off = F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])
    own = Window.partitionBy(*context)
    of = grams.withColumn("_off", off).withColumn("_all", F.sum(n).over(own))
    shares = of.withColumn("share", (F.col(n) - F.col("_off")) / F.col("_all"))
    rest = grams.withColumn("_off", off).groupBy(*context).agg((F.sum("_off") / F.sum(n)).alias("rest"))
    return shares.drop("_off", "_all"), rest


@dataclass
class Table:
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], values[order].astype(np.float32))

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        # sorted queries walk through the table instead of jumping about in it
        order = np.argsort(keys)
        q = keys[order]
        at = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        out = np.empty(len(keys))
        out[order] = np.where(self.keys[at] == q, self.values[at], default)
        return out


@dataclass
class Model:
    """Shares by trigram, bigram and word; masses left by contexts of two words and of one; the floor for any word."""

    tri: Table
    rest2: Table
    bi: Table
    rest1: Table
    uni: Table
    floor: float

    def log10(self, u: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each token the log10 probability after its two predecessors."""
        uv, vx = _pair(u, v), _pair(v, x)
        p = self.uni.get(x, 0.0) + self.floor
        p = self.bi.get(vx, 0.0) + self.rest1.get(v, 1.0) * p
        p = self.tri.get(_pair(uv, x), 0.0) + self.rest2.get(uv, 1.0) * p
        return np.log10(np.maximum(p, 1e-30))


def _collect(df: DataFrame, keys: list[str], value: str) -> Table:
    """A bounded table as arrays; the keys are hashed and packed on the executors, so that the driver gets 16 bytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.asarray(b.column(i), np.int64).view(w.U64) for i in range(len(keys))]
            key = cols[0]
            for c in cols[1:]:
                key = _pair(key, c)
            values = np.asarray(b.column(len(keys))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()]), pa.array([values.tobytes()])], names=["k", "v"])

    rows = df.select(*keys, F.col(value).cast("double").alias("value")).mapInArrow(run, "k binary, v binary").collect()
    key, values = (np.frombuffer(b"".join(bytes(r[i]) for r in rows), t) for i, t in ((0, w.U64), (1, np.float64)))
    return Table.of(key, values)


def train(docs: DataFrame) -> Model:
    """The model of all texts of ``docs`` (doc_id, text) in one place, for a few texts; ``weights`` is the same for many."""
    spark = docs.sparkSession
    # each order's counts are done with before those of the next are made
    tri = cut(trigram_counts(docs))
    share3, rest2 = _order(tri, ["u", "v"], "n")
    tables3 = _collect(share3, ["u", "v", "w"], "share"), _collect(rest2, ["u", "v"], "rest")
    bi = cut(tri.groupBy("v", "w").agg(F.count("*").alias("n")))
    del tri, share3, rest2
    release(spark)
    share2, rest1 = _order(bi, ["v"], "n")
    tables2 = _collect(share2, ["v", "w"], "share"), _collect(rest1, ["v"], "rest")
    uni = cut(bi.groupBy("w").agg(F.count("*").alias("n")))
    del bi, share2, rest1
    release(spark)
    d = _discounts(uni, "n")
    words = _collect(uni, ["w"], "n")
    n = words.values.astype(float)
    off = np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))
    total = max(n.sum(), 1.0)
    floor = (off.sum() / total if len(n) else 1.0) / (len(n) + 1)
    return Model(*tables3, *tables2, Table.of(words.keys, (n - off) / total), floor)


def _word_keys(x: np.ndarray) -> np.ndarray:
    return w.mix(x + w.U64(0x2545F4914F6CDD1D))


def _keyed(df: DataFrame, grams: list[str], value: str) -> DataFrame:
    """(key, weight) of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.asarray(b.column(i), np.int64).view(w.U64) for i in range(len(grams))]
            key = _word_keys(cols[0]) if len(cols) == 1 else _pair(*cols[:2])
            for c in cols[2:]:
                key = _pair(key, c)
            yield pa.RecordBatch.from_arrays([_signed(key), b.column(len(grams))], names=["key", "weight"])

    return df.select(*grams, F.expr(value).cast("double").alias("weight")).mapInArrow(run, "key long, weight double")


def weights(docs: DataFrame) -> tuple[DataFrame, float]:
    """(shard, keys, weights), packed and dealt by shard, of the model of all texts of ``docs`` (doc_id, text); and its floor.

    A key may come twice, as an n-gram and as a context; its weights are added.
    """
    spark = docs.sparkSession

    def off(n: str, d: tuple[float, float, float]) -> str:
        return f"CASE {n} WHEN 1 THEN {d[0]!r}D WHEN 2 THEN {d[1]!r}D ELSE {d[2]!r}D END"

    # the shuffles of each count go before those of the next are made
    tri = cut(trigram_counts(docs))
    release(spark)
    bi = cut(tri.groupBy("v", "w").agg(F.count("*").alias("n")))
    release(spark)
    uni = cut(bi.groupBy("w").agg(F.count("*").alias("n")))
    release(spark)
    d3, d2, d1 = (_discounts(x, "n") for x in (tri, bi, uni))
    one = uni.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.expr(f"sum({off('n', d1)})").alias("off")).first()
    total = max(float(one["n"] or 0), 1.0)
    floor = (one["off"] / total if one["k"] else 1.0) / (one["k"] + 1)
    words = uni.select("w", F.expr(f"(n - {off('n', d1)}) / {total!r}D + {floor!r}D").alias("p1"))
    after1 = bi.groupBy("v").agg(F.expr(f"sum({off('n', d2)})").alias("off"), F.sum("n").alias("every"))
    after2 = tri.groupBy("u", "v").agg(F.expr(f"sum({off('n', d3)})").alias("off"), F.sum("n").alias("every"))
    # share / rest is (n - its discount) / (all discounts of the context)
    pairs = cut(
        bi.join(after1.hint("merge"), "v").join(words.hint("merge"), "w")
        .select("v", "w", F.expr(f"(n - {off('n', d2)}) / off / p1").alias("gain"), F.expr(f"(n - {off('n', d2)}) / every + off / every * p1").alias("p2"))
    )
    release(spark)
    triples = tri.join(after2.hint("merge"), ["u", "v"]).select("v", "w", "u", F.expr(f"(n - {off('n', d3)}) / off").alias("gain"))
    triples = triples.join(pairs.select("v", "w", "p2").hint("merge"), ["v", "w"])
    every = _keyed(words, ["w"], f"log10(p1 / {floor!r}D)")
    for part in (
        _keyed(after1, ["v"], "log10(off / every)"), _keyed(pairs, ["v", "w"], "log10(1 + gain)"),
        _keyed(after2, ["u", "v"], "log10(off / every)"), _keyed(triples, ["u", "v", "w"], "log10(1 + gain / p2)"),
    ):
        every = every.unionByName(part)
    size = 2 * sum(x.count() for x in (bi, uni)) + 2 * tri.count()
    bits = max(4, (size // SHARD).bit_length())
    shard = F.shiftrightunsigned("key", 64 - bits).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column(0))
            order = np.argsort(at, kind="stable")
            keys, values = np.asarray(b.column(1))[order], np.asarray(b.column(2))[order]
            first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0)) if len(at) else []
            ends = np.append(first[1:], len(at)) if len(at) else []
            rows = [(int(at[order[i]]), keys[i:j].tobytes(), values[i:j].tobytes()) for i, j in zip(first, ends, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "weights"])

    dealt = every.select(shard.alias("shard"), "key", "weight").repartition(1 << bits, "shard").mapInArrow(pack, "shard int, keys binary, weights binary")
    packed = dealt.repartition(1 << bits, "shard").checkpoint(eager=True)  # keeps how it is dealt, so that the documents' n-grams come to it
    del tri, bi, uni, words, after1, after2, pairs, triples, every, dealt
    release(spark)
    return packed.withMetadata("shard", {"bits": bits}), floor


def log_probabilities(own: DataFrame, model: DataFrame, floor: float, rounds: int = 1) -> DataFrame:
    """(row, logprob) of each ``row`` of ``own`` (row, text, n_tokens): rows that share a number are equal, and so are their sums."""
    spark = own.sparkSession
    bits = model.schema["shard"].metadata["bits"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.per_batch(batches):
            u, v, x, first = _ngrams(batch.column(1))
            doc = np.repeat(np.arange(len(batch), dtype=np.uint16), np.diff(first))
            uv = _pair(u, v)
            # words stand as what is told and as what tells: a text's words, and once its start and its end
            end = np.append(x[first[1:] - 1], v[first[:-1]])
            lone = np.tile(np.arange(len(batch), dtype=np.uint16), 2)
            inner = np.ones(len(x), bool)
            inner[first[1:] - 1] = False
            last = first[1:] - 1
            keys = np.concatenate([_word_keys(x[inner]), _word_keys(end), uv, _pair(v[last], x[last]), _pair(uv, x)])
            docs = np.concatenate([doc[inner], lone, doc, doc[last], doc])
            order = np.argsort(keys)
            keys, docs = keys[order], docs[order]
            at = np.searchsorted(keys >> w.U64(64 - bits), np.arange((1 << bits) + 1, dtype=w.U64))
            ids = np.asarray(batch.column(0), np.int64)
            rows = [(k, ids.tobytes(), keys[i:j].tobytes(), docs[i:j].tobytes()) for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if j > i]
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "ids", "keys", "docs"])

    def meet(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Sums by document of the numbers of one shard."""
        read = lambda table, name, kind: [np.frombuffer(b.as_buffer(), kind) for b in table.column(name)]
        keys = np.concatenate([np.zeros(0, w.U64), *read(known, "keys", w.U64)])
        keys, place = np.unique(keys, return_inverse=True)
        values = np.bincount(place, np.concatenate([np.zeros(0), *read(known, "weights", np.float64)]), len(keys))
        row, total = [], []
        for ids, q, docs in zip(read(asked, "ids", np.int64), read(asked, "keys", w.U64), read(asked, "docs", np.uint16), strict=True):
            if not len(keys):
                break
            at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            hit = keys[at] == q
            sums = np.bincount(docs[hit], values[at[hit]], len(ids))
            some = np.flatnonzero(sums)
            row.append(ids[some])
            total.append(sums[some])
        return pa.table({"row": np.concatenate([np.zeros(0, np.int64), *row]), "part": np.concatenate([np.zeros(0), *total])})

    out = None
    for r in range(rounds):
        some = own.where(F.pmod("row", F.lit(rounds)) == r)
        asked = some.select("row", "text").mapInArrow(send, "shard int, ids binary, keys binary, docs binary")
        parts = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(meet, "row long, part double")
        base = some.select("row", (F.col("n_tokens") * F.lit(float(np.log10(floor)))).alias("part"), F.lit(1).alias("k"))
        sums = base.unionByName(parts.withColumn("k", F.lit(0))).groupBy("row").agg((F.sum("part") / F.sum("k")).alias("logprob"))
        sums = cut(sums)
        release(spark)
        out = sums if out is None else out.unionByName(sums)
    return out


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(doc_id, lang, n_tokens, logprob, perplexity, threshold, kept) for each row of ``docs``.

    Null texts count as empty: one token, the end.  A null language is a language.  Repeated rows are judged alike.
    Without trusted documents nothing is rejected.  An empty table gives an empty result.  Extra columns are ignored.
    """
    own = docs.select(
        column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"), column(docs, lang_col).cast("string").alias("lang")
    )
    good = F.col("quality") == 1
    if "toxic" in labels.columns:
        good = good & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    trusted = labels.where(good & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    draw = F.xxhash64(F.lit(SEED), "doc_id")
    held_out = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(HELD_OUT)) == 0
    bounded_batches(docs.sparkSession)
    own = own.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD_JAVA)), F.lit(0)).cast("long") + 1)
    chosen = trusted.where(~held_out)
    chosen = F.broadcast(chosen) if trusted.count() <= FEW else chosen
    model, floor = weights(own.join(chosen, "doc_id", "left_semi"))
    sizes = cut(own.select("doc_id", "lang", "row", "n_tokens"))
    tokens = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    logs = log_probabilities(own, model, floor, min(ROUNDS, 1 + tokens // ROUND_TOKENS))
    ppl = F.pow(F.lit(10.0), F.least(-F.col("logprob") / F.col("n_tokens"), F.lit(300.0)))
    scored = cut(sizes.join(logs, "row").select("doc_id", "lang", "n_tokens", "logprob", ppl.alias("perplexity")))
    del model, sizes, logs
    held = scored.join(trusted.where(held_out), "doc_id", "left_semi")
    q = F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(10_000))
    limits = cut(held.groupBy(F.col("lang").alias("l")).agg((q * MARGIN).alias("own"), F.count("*").alias("k")))
    whole = held.agg((q * MARGIN).alias("x")).first()["x"]
    fallback = F.lit(float("inf") if whole is None else float(whole))
    small = limits.count() <= 50_000
    # one number as the key: a broadcast relation of strings takes 64 MB however small it is
    table = limits.where(F.col("k") >= LEAST).select(F.xxhash64("l").alias("l"), "own")
    out = scored.join(F.broadcast(table) if small else table, F.xxhash64("lang") == F.col("l"), "left").withColumn("threshold", F.coalesce("own", fallback))
    return out.select("doc_id", "lang", "n_tokens", "logprob", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
