"""Centroid clustering with the exponion search.

Vectors are integers.  Each keeps an upper bound of the distance to its own centroid and a lower bound of the distance to
the next one.  Where the bounds can't tell, only centroids inside a ball around its current centroid are compared: with
``u`` the distance to it and ``s`` the distance from it to its nearest neighbour, all those within ``2 * u + s``, which are
a prefix of that centroid's list of the others sorted by distance.  The two nearest are always in that ball, and the radius
is inclusive, so a tie at its edge is seen.  Distances that decide are exact integers; bounds are floats, kept on the safe
side by a relative slack.

The state of a round (vector in the narrowest integer type, cluster, bounds) goes to the checkpoint folder; centroids are
summed in the tasks and then by Spark, and only ``k`` sums come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut

K, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Components below this leave every squared distance within 64 bits; larger ones are computed with Python's integers.
PLAIN = 1 << 27
#: Relative slack of the bounds, far above the rounding of a square root and a few sums.
SLACK = 1e-9
LONG_MAX = (1 << 63) - 1

STATE = "vec_id long, v binary, cluster int, upper double, lower double, distance long"


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of exactly ``size`` finite components, each x as floor(scale * x)."""
    x = F.transform(column(df, vec_col), lambda v: v.cast("double"))
    return (
        df.select(column(df, id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where((F.size("x") == size) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
        .select("vec_id", F.transform("x", lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-(2.0**62))), F.lit(2.0**62))).cast("long")).alias("v"))
    )


def _narrow(x: np.ndarray) -> bytes:
    """A vector in the narrowest of 1, 2, 4 or 8 bytes a component; the length tells which."""
    low, high = int(x.min()), int(x.max())
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def _wide(packed: pa.Array, size: int) -> np.ndarray:
    rows = [np.frombuffer(b, f"<i{len(b) // size}") for b in packed.to_pylist()]
    return np.array(rows, np.int64).reshape(len(rows), size)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; of 64-bit integers where they fit, else of Python's."""
    d = x - c
    return (d * d).sum(axis=-1)


def _exact(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    large = max(np.abs(x).max(initial=0), max((abs(int(v)) for v in centroids.flat), default=0)) >= PLAIN
    return (x.astype(object), centroids.astype(object)) if large else (x, centroids.astype(np.int64))


class Search:
    """One assignment of vectors to ``centroids``, after these have moved by ``moved``."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray):
        k = len(centroids)
        gaps = np.array([[float(squared(a.astype(object), b.astype(object))) ** 0.5 for b in centroids] for a in centroids])
        np.fill_diagonal(gaps, -1.0)
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]  # the others, nearest first
        self.sorted = np.take_along_axis(gaps, self.order, 1)
        self.nearest = self.sorted[:, 0] if k > 1 else np.full(k, np.inf)
        self.centroids, self.moved = centroids, moved
        self.drift = np.array([max([m for j, m in enumerate(moved) if j != i], default=0.0) for i in range(k)])
        self.compared = 0

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The new cluster and bounds of each row of ``x``."""
        x, centroids = _exact(x, self.centroids)
        cluster = cluster.copy()
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = lower * (1 - SLACK) - self.drift[cluster] * (1 + SLACK)
        safe = np.maximum(lower, self.nearest[cluster] * ((1 - SLACK) / 2))
        open_ = np.flatnonzero(~(upper < safe))
        own = squared(x[open_], centroids[cluster[open_]])
        self.compared += len(open_)
        upper[open_] = np.sqrt(own.astype(float)) * (1 + SLACK)
        still = ~(upper[open_] < safe[open_])
        open_, own = open_[still], own[still]
        before = cluster[open_]
        for c in np.unique(before):
            rows = open_[before == c]
            best, name = own[before == c], np.full(len(rows), c)
            second = np.full(len(rows), np.inf)
            reach = (2 * upper[rows] + self.nearest[c]) * (1 + SLACK)
            inside = np.searchsorted(self.sorted[c], reach, "right")
            for p in range(int(inside.max(initial=0))):
                at = np.flatnonzero(inside > p)
                other = self.order[c, p]
                d = squared(x[rows[at]], centroids[other])
                self.compared += len(at)
                wins = (d < best[at]) | ((d == best[at]) & (other < name[at]))
                wins = wins.astype(bool)
                second[at] = np.minimum(second[at], np.where(wins, best[at], d).astype(float))
                best[at[wins]], name[at[wins]] = d[wins], other
            cluster[rows] = name
            upper[rows] = np.sqrt(best.astype(float)) * (1 + SLACK)
            lower[rows] = np.sqrt(second) * (1 - SLACK)
        return cluster, upper, lower


def _start(rows: DataFrame, size: int) -> DataFrame:
    """The first state: everything at centroid 0, with bounds that tell nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, size)
            cols = [b.column(0), pa.array([_narrow(r) for r in x], pa.binary()), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, np.inf)), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return rows.mapInArrow(run, STATE)


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, size: int, last: bool) -> DataFrame:
    search = Search(centroids, moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _wide(b.column(1), size)
            cluster, upper, lower = search.assign(x, b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy())
            distance = np.zeros(len(x), np.int64)
            if last:
                a, c = _exact(x, centroids)
                distance = np.array([min(int(d), LONG_MAX) for d in squared(a, c[cluster])], np.int64)
            cols = [b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """(rows, component sums) of each cluster; a task adds up its rows first, so k * size sums leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for b in batches:
            x, cluster = _wide(b.column(1), size), b.column(2).to_numpy()
            for c in np.unique(cluster):
                own = x[cluster == c]
                own = own.astype(object) if np.abs(own).max(initial=0) >= 1 << 40 else own
                sums = [int(s) for s in own.sum(axis=0)]
                count[int(c)] = count.get(int(c), 0) + len(own)
                total[int(c)] = [p + s for p, s in zip(total.get(int(c), [0] * size), sums, strict=True)]
        if count:
            arrays = [pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([[Decimal(v) for v in total[c]] for c in count], pa.list_(pa.decimal128(38, 0)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "n", "sums"])

    parts = state.select("vec_id", "v", "cluster").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.collect():  # at most k * size rows
        n, sums = out.setdefault(r["cluster"], (r["n"], [0] * size))
        sums[r["pos"]] = int(r["s"])
    return out


def cluster(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = 1,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:id``; equal hashes go by the components,
    vectors without an id come last.  With fewer than ``k`` vectors there are as many centroids.  Vectors that are null, of
    another length, or hold a null or non-finite component take no part; repeated rows count each; equal distances go to
    the smaller centroid.  Components are held within 2**62 after scaling, and distances and sums beyond 64 bits come out
    as the largest long.  An empty table gives an empty result.  Extra columns are ignored.
    """
    rows = integers(df, id_col, vec_col, size, scale)
    state = cut(_start(rows, size))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select(digest.alias("d"), "v").orderBy(F.col("d").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in chosen], dtype=object).reshape(len(chosen), size)
    if not len(chosen):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    moved = np.zeros(len(chosen))
    for _ in range(rounds):
        state = cut(_round(state, centroids, moved, size, False))
        after = centroids.copy()
        for c, (n, sums) in _sums(state, size).items():
            after[c] = [s // n for s in sums]
        moved = np.array([float(squared(a, b)) ** 0.5 * (1 + SLACK) for a, b in zip(centroids, after, strict=True)])
        centroids = after
    state = cut(_round(state, centroids, moved, size, True))
    held = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    names = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    return state.select(
        "vec_id", "cluster", "distance", pick([min(held.get(i, 0), LONG_MAX) for i in range(len(names))], "long").alias("cluster_inertia"),
        F.lit(min(sum(held.values()), LONG_MAX)).cast("long").alias("inertia"), pick(names, "string").alias("centroid_sha256"),
    )
