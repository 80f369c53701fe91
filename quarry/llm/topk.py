"""Exact top-k by integer inner product, with segment statistics as bounds from coarse to fine.

Each vector is cut into 2, 4, ... segments.  With the mean and deviation of each, the inner product of two vectors is at
most ``sum(length * (mean * mean' + dev * dev'))`` (which is the lower bound of their distance, written for products).
Vectors whose bound is below the k-th best score so far are dropped, at each resolution, and only for the survivors the
product itself is computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Rows in a block of vectors and of queries; each pair of blocks is one group.
ROWS, QUERIES = 8192, 1024
SEGMENTS = (2, 4, 8, 16)


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x); rows that are null or hold a null or non-finite x take no part."""
    x = F.transform(column(df, vec_col), lambda v: v.cast("double"))
    return (
        df.select(column(df, id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
        .select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v"))
    )


def _matrix(values: pd.Series) -> np.ndarray:
    """Rows padded with zeros to a power of two; the padding adds nothing to a product."""
    width = max([16, *(len(v) for v in values)])
    width = 1 << (width - 1).bit_length()
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    parts = x.reshape(len(x), n, -1)
    size = np.sqrt(parts.shape[2])
    return parts.mean(2) * size, parts.std(2) * size


def search(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(place of the query, vector, score) of the k best of the block for each query; ties to the smaller id.

    One row of the query's id and vector is the query itself.
    """
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    # of equal vectors only the k + 1 with the least ids can be asked for (one may be the query itself)
    order = np.lexsort((ids, *x.T[::-1]))
    same = np.ones(len(order), bool)
    same[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
    start = np.flatnonzero(same)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    chosen = np.sort(order[nth <= k])
    chosen = chosen[np.argsort(ids[chosen], kind="stable")]
    ids, x = ids[chosen], x[chosen]
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width < 2.0**52
    xf, qf = (x.astype(float), q.astype(float)) if exact else (x, q)
    xd, qd = x.astype(float), q.astype(float)
    stats = [(*_segments(xd, n), *_segments(qd, n)) for n in SEGMENTS]
    slack = 1e-9 * (np.linalg.norm(xd, axis=1).max(initial=0) + 1) * (np.linalg.norm(qd, axis=1) + 1)
    out = []
    m0, d0, n0, e0 = stats[0]
    coarse = n0 @ m0.T + e0 @ d0.T  # queries x vectors of this block
    for i in range(len(q)):
        bound = coarse[i] + slack[i]
        own = np.flatnonzero(ids == qid[i])
        own = own[(x[own] == q[i]).all(1)][:1]
        bound[own] = -np.inf
        want = min(k, len(ids) - len(own))
        if want <= 0:
            continue
        seed = np.argpartition(-bound, want - 1)[:want]
        floor = int(min(xf[seed] @ qf[i]))
        alive = np.flatnonzero(bound >= floor)
        for m, d, n, e in stats[1:]:
            if len(alive) <= 4 * want:
                break
            alive = alive[m[alive] @ n[i] + d[alive] @ e[i] + slack[i] >= floor]
        score = (xf[alive] @ qf[i]).astype(np.int64)
        best = np.lexsort((ids[alive], -score))[:want]
        out += [(i, int(ids[alive[j]]), int(score[j])) for j in best]
    return out


def top_k(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = QUERY_EVERY, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by ``every``.

    A row is no candidate for itself; other rows of its id are.  Shorter vectors count as padded with zeros.  Null ids and
    vectors that are null or not finite take no part; fewer than k other rows give fewer results; an empty table gives
    none.  Equal scores go to the smaller id; repeated rows are results of their own and, where their id is divisible,
    queries of their own.  Extra columns are ignored.
    """
    rows = cut(vectors(df, id_col, vec_col, scale))
    n = rows.count()
    blocks, asked = -(-n // ROWS) or 1, rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    asks = -(-asked.count() // QUERIES) or 1
    grid = lambda c, other: F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(c)
    left = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), grid("ask", asks), "vec_id", "v", F.lit(0).cast("long").alias("times"), F.lit(False).alias("is_query"))
    right = asked.select(grid("block", blocks), F.pmod(F.xxhash64("vec_id", "v"), F.lit(asks)).cast("int").alias("ask"), "vec_id", "v", "times", F.lit(True).alias("is_query"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        found = search(x["vec_id"].to_numpy(np.int64), _matrix(x["v"]), q["vec_id"].to_numpy(np.int64), _matrix(q["v"]), k) if len(q) and len(x) else []
        at = [f[0] for f in found]
        query = pd.DataFrame({"query_id": q["vec_id"].to_numpy(np.int64)[at], "row": q["row"].to_numpy(np.int64)[at], "times": q["times"].to_numpy(np.int64)[at]})
        return query.assign(vec_id=[f[1] for f in found], score=[f[2] for f in found]).astype("int64")

    part = (
        left.unionByName(right.select("block", "ask", "vec_id", "v", "times", "is_query")).withColumn("row", F.xxhash64("v"))
        .groupBy("block", "ask").applyInPandas(run, "query_id long, row long, times long, vec_id long, score long")
    )
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))), 1, k)
    return (
        part.groupBy("query_id", "row", "times").agg(best.alias("best"))
        .withColumn("nth", F.explode(F.expr("sequence(1L, times)"))).select("query_id", F.posexplode("best").alias("at", "b"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.low")).alias("score"))
    )
