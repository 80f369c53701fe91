"""Quality rules: rule statistics of every text, and isolation forests over them.

There is a forest for each group of rules, one of what the text is made of and one of how it repeats and breaks, so that
a text that is odd in one group isn't hidden among ordinary values of the other.  They are grown on the driver
from a bounded sample of rows (``SAMPLE_ROWS``, the rows with the smallest seeded hash); each one's cut-off is calibrated on
all labelled rows, good and bad.  Scoring runs where the statistics are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import column, cut, id_text

#: Rows that the forest is grown from, at most; each tree takes TREE_ROWS of them.
SAMPLE_ROWS = 8192
TREE_ROWS = 256
TREES = 100
SEED = 17
#: Of the labelled good rows that pass the base rules, the share that a forest's cut-off may reject (or FEW rows, where they are
#: so few that the share is less); the share of bad ones that has to be caught for each share of good ones lost; and the
#: bins that cut-offs are chosen from.
GOOD_LOSS, FEW = 0.003, 2
WORTH = 10
BINS = 4096

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_seen", "n_lines", "n_alpha", "n_digits", "n_distinct"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)

_SYMBOL, _ALPHA, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
# letters outside ASCII, one a code point, by its first byte: all but U+0080 to U+00BF (C2), U+2000 to U+2FFF (E2: punctuation,
# arrows, drawings) and from U+10000 on (F0 and above, most of all pictures)
_ALPHA[0xC3:0xF0] = True
_ALPHA[0xE2] = False
_DIGIT[48:58] = True


def _statistics(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = w.buffers(texts)
    n = len(offsets) - 1
    starts, ends, hashes = w.words(data, offsets, lower=False)
    first = w.word_offsets(starts, offsets)
    count = np.diff(first)
    points = w.code_points(data)
    within = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(points[ends] - points[starts], out=within[1:])

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    text_of = np.repeat(np.arange(n), count)
    # the lines that hold a word, as hashes over their words' bytes and the bytes between
    breaks = np.flatnonzero(data == 10)
    line_from = np.union1d(offsets[:-1], breaks + 1)
    line_from = line_from[line_from < len(data)]
    dup_lines = np.zeros(n, np.int64)
    if len(starts):
        line_of_word = np.searchsorted(line_from, starts, "right") - 1
        lines = np.unique(line_of_word)
        owner = np.searchsorted(offsets, line_from[lines], "right") - 1
        stop = np.append(line_from, len(data))[lines + 1]
        stop = np.minimum(stop, offsets[owner + 1])
        stop = np.where((stop > line_from[lines]) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop)
        raw = data.tobytes()
        seen: set = set()
        current = -1
        for k, a, b in zip(owner.tolist(), line_from[lines].tolist(), stop.tolist(), strict=True):
            if k != current:
                seen, current = set(), k
            line = raw[a:b]
            if line in seen:
                dup_lines[k] += 1
            else:
                seen.add(line)
    repeat, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(starts):
        order = np.lexsort((hashes, text_of))
        h, t = hashes[order], text_of[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        distinct = np.bincount(t[fresh], minlength=n)
    if len(starts) >= 3:
        s = w.shingle3(hashes)
        whole = text_of[:-2] == text_of[2:]
        at = np.flatnonzero(whole)
        s, t = s[at], text_of[at]
        order = np.lexsort((s, t))
        s, t = s[order], t[order]
        same = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[hit + k] = True
        repeat = np.bincount(text_of[covered], minlength=n)
    return [
        count, within[first[1:]] - within[first[:-1]], per_text(_SYMBOL[data]), dup_lines, repeat,
        points[offsets[1:]] - points[offsets[:-1]], per_text(data == 10) + 1, per_text(_ALPHA[data]), per_text(_DIGIT[data]), distinct,
    ]


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of rule statistics for each row of ``docs``; null and empty texts have zeros (and one line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.per_batch(batches):
            stats = _statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in stats]], names=["doc_id", *STATS])

    own = id_text(docs, id_col, text_col)
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STATS_SCHEMA)


def features(x: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What each forest sees of the statistics.

    Of what a text is made: mean word length, symbols a word, share of letters.  Of how it repeats and breaks: shares of
    digits, of repeated lines and of words in repeated windows, distinct words for their expected growth (with the
    square root of the length), and words a line.
    """
    n = np.maximum(x["n_words"], 1).astype(float)
    chars = np.maximum(x["n_chars_seen"], 1).astype(float)
    lines = np.maximum(x["n_lines"], 1).astype(float)
    return [
        np.stack([x["word_chars"] / n, x["n_symbols"] / n, x["n_alpha"] / chars], axis=1),
        np.stack([x["n_digits"] / chars, x["n_dup_lines"] / lines, x["n_repeat_words"] / n, x["n_distinct"] / np.sqrt(n), np.log(n / lines)], axis=1),
    ]


@dataclass
class Forest:
    """Trees as flat arrays: split feature (-1 at leaves), split value, left child (right is next), path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    norm: float
    cutoff: float = 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 is anomalous, below one half ordinary."""
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = self.left[at] + (x[inner, f[inner]] >= self.value[at])
            total += self.length[node]
        return 2.0 ** (-total / (len(self.roots) * self.norm))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """An isolation forest; without rows, one whose only leaf finds nothing anomalous."""
    rng = np.random.default_rng(seed)
    feature, value, left, length, roots = [], [], [], [], []
    size = min(rows, len(x))
    deepest = math.ceil(math.log2(max(size, 2)))

    def node() -> int:
        for column_, default in ((feature, -1), (value, 0.0), (left, 0), (length, 0.0)):
            column_.append(default)
        return len(feature) - 1

    for _ in range(trees if size else 1):
        roots.append(node())
        todo = [(roots[-1], x[rng.choice(len(x), size, replace=False)] if size else x, 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            usable = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(usable):
                length[at] = depth + _expected(len(part))
                continue
            f = int(rng.choice(usable))
            v = rng.uniform(low[f], high[f])
            v = v if v > low[f] else high[f]
            feature[at], value[at] = f, v
            left[at] = node()
            node()
            right = part[:, f] >= v
            todo += [(left[at], part[~right], depth + 1), (left[at] + 1, part[right], depth + 1)]
    return Forest(np.array(feature), np.array(value), np.array(left), np.array(length), np.array(roots), max(_expected(size), 1e-9))


def _failed_base(n_words, n_repeat):
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


@dataclass
class Forests:
    """The forest of each group of rules."""

    forests: list[Forest]

    def score(self, x: dict[str, np.ndarray]) -> list[np.ndarray]:
        return [f.score(v) for f, v in zip(self.forests, features(x), strict=True)]

    def ordinary(self, scores: list[np.ndarray]) -> np.ndarray:
        """Whether no forest finds a row anomalous."""
        return np.logical_and.reduce([v < f.cutoff for f, v in zip(self.forests, scores, strict=True)])


def _scored(batches: Iterator[pa.RecordBatch], forests: Forests) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = {c: np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in STATS}
        scores = forests.score(x)
        failed = _failed_base(x["n_words"], x["n_repeat_words"])
        kept = ~failed & forests.ordinary(scores)
        names = [*batch.schema.names, *ANOMALIES, "base_failed", "kept"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in scores], pa.array(failed), pa.array(kept)], names=names)


#: The score of each forest, in their order.
ANOMALIES = ["anomaly", "anomaly_structure"]


def apply_forests(stats: DataFrame, forests: Forests) -> DataFrame:
    return stats.mapInArrow(lambda it: _scored(it, forests), STATS_SCHEMA + "".join(f", {c} double" for c in ANOMALIES) + ", base_failed boolean, kept boolean")


def cut_off(bins: list[tuple[int, int, int]]) -> float:
    """The cut-off from (bin, good rows, bad rows): of those that lose GOOD_LOSS (or FEW) of the good rows at most, the one whose
    caught share of the bad rows exceeds WORTH times its lost share of the good ones by most; 2 (never) where none does.

    Without bad rows it is the least that loses no more; without good rows nothing is rejected.
    """
    all_good, all_bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not all_good:
        return 2.0
    best, chosen, good, bad = 0.0, 2.0, 0, 0
    for k, g, b in sorted(bins, reverse=True):
        good, bad = good + g, bad + b
        if good > max(FEW, GOOD_LOSS * all_good):
            return chosen if all_bad else (k + 1) / BINS
        gain = bad / all_bad - WORTH * good / all_good if all_bad else 0.0
        if gain > best:
            best, chosen = gain, k / BINS
    return chosen


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> Forests:
    """Grow the forests from a bounded sample of ``stats`` and set their cut-offs from all labelled rows that pass the base rules."""
    passing = stats.where(~((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    # cut, so that the partitions' smallest rows meet on an executor and not on the driver
    sample = cut(passing.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), *STATS).limit(SAMPLE_ROWS)).toPandas()
    forests = Forests([grow(x) for x in features({c: sample[c].to_numpy(np.int64) for c in STATS})])
    judged = (
        labels.select(column(labels, id_col).cast("long").alias("doc_id"), column(labels, quality_col).alias("q"))
        .where("q is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("q").cast("int")).alias("q"))
    )
    scored = cut(apply_forests(passing.drop("q"), forests).select("doc_id", *ANOMALIES).join(judged, "doc_id"))
    good, bad = (F.sum(F.when(x, 1).otherwise(0)) for x in (F.col("q") == 1, F.col("q") != 1))
    for forest, name in zip(forests.forests, ANOMALIES, strict=True):
        bins = scored.groupBy(F.floor(F.col(name) * BINS).alias("bin")).agg(good.alias("good"), bad.alias("bad")).collect()
        forest.cutoff = cut_off([tuple(r) for r in bins])
    return forests


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, anomaly scores and verdict of every row of ``docs``.

    Null texts count as empty and fail the base rules.  Repeated rows are judged one by one and alike.  An empty
    table gives an empty result.  Extra columns are ignored.
    """
    stats = cut(rule_statistics(docs, id_col, text_col))
    return apply_forests(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject; columns as they were, whatever their names.

    Null and empty texts fail the base rules and go.  Repeated rows stay or go alike.  An empty table gives an empty one,
    and without labels the base rules alone reject.  The statistics are computed twice, once to fit and once beside the rows, which costs less than moving the texts.
    """
    forests = fit(cut(rule_statistics(docs, id_col, text_col)), labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.per_batch(batches, text_col):
            x = dict(zip(STATS, _statistics(batch.column(at)), strict=True))
            kept = ~_failed_base(x["n_words"], x["n_repeat_words"]) & forests.ordinary(forests.score(x))
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
