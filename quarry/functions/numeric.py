"""Vectors, scores and ratings as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """The inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 if either is zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def fit_unit(v: Column, n: int) -> Column:
    """A vector cut or padded to n, then of length 1; a zero vector stays."""
    cut = F.slice(F.transform(v, lambda x: x.cast("double")), 1, n)
    full = F.concat(cut, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n) - F.size(v))))
    length = F.sqrt(F.aggregate(full, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length == 0, full).otherwise(F.transform(full, lambda x: x / length))


def vector_literal(v: Column) -> Column:
    """A vector as text with six decimals, 0 for what isn't finite."""
    one = lambda x: F.format_string("%.6f", F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x.cast("double")))
    return F.concat(F.lit("["), F.array_join(F.transform(v, one), ","), F.lit("]"))


def rank_share(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    """What a rank adds to a fused score; nothing if it has none."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def half_up(x: Column) -> Column:
    """Rounding with halves upwards."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within bounds, rounded half up."""
    return half_up(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def grade(score: Column) -> Column:
    """A to F by fixed cut-offs."""
    return F.when(score >= 90, "A").when(score >= 78, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")


def cvss31(vector: Column) -> Column:
    """The base score of a CVSS 3.0 or 3.1 vector, null if a metric is missing (N6); weights as the standard has them."""
    from .text import let

    def weight(m: Column, key: str, values: dict[str, float]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), m[key])

    def parts(m: Column) -> Column:
        changed = m["S"] == "C"
        pr = F.when(changed, weight(m, "PR", {"N": 0.85, "L": 0.68, "H": 0.5})).otherwise(weight(m, "PR", {"N": 0.85, "L": 0.62, "H": 0.27}))
        exploit = 8.22 * weight(m, "AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}) * weight(m, "AC", {"L": 0.77, "H": 0.44}) * pr * weight(m, "UI", {"N": 0.85, "R": 0.62})
        c, i, a = (1 - weight(m, k, {"H": 0.56, "L": 0.22, "N": 0.0}) for k in "CIA")
        known = m["S"].isin("C", "U") & (exploit + c + i + a).isNotNull()
        return F.when(known, F.struct(changed.alias("changed"), exploit.alias("exploit"), (1 - c * i * a).alias("iss")))

    def whole(p: Column) -> Column:
        impact = F.when(p["changed"], 7.52 * (p["iss"] - 0.029) - 3.25 * F.pow(p["iss"] - 0.02, F.lit(15.0))).otherwise(6.42 * p["iss"])
        return let(impact, lambda x: F.when(x <= 0, F.lit(0).cast("long")).otherwise(F.round(F.least(F.lit(10.0), F.when(p["changed"], 1.08).otherwise(1.0) * (x + p["exploit"])) * 100_000).cast("long")))

    # rounded up to a tenth by whole numbers, as the standard does it
    up = lambda n: F.when(F.pmod(n, F.lit(10_000)) == 0, n / 100_000).otherwise((F.floor(n / 10_000) + 1) / 10)
    metrics = F.str_to_map(F.regexp_replace(vector, "^CVSS:3\\.[01]/", ""), F.lit("/"), F.lit(":"))
    return let(metrics, lambda m: let(parts(m), lambda p: F.when(p.isNotNull(), let(whole(p), up))))


def severity_of_score(score: Column) -> Column:
    """critical, high, medium or low by score; medium without one."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("medium")


def hashed_embedding(df: DataFrame, id_col: str, terms: Column, size: int = 1536) -> DataFrame:
    """(id, index, weight): a sparse unit vector of hashed terms and pairs of terms.

    A term counts 1 and a pair of neighbours a half; the hash's lower part gives the index, its top bit the sign, and a
    count c weighs 1 + ln c.
    """
    from .text import fnv1a

    t = df.select(id_col, terms.alias("t"))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat(a, F.lit("~"), b)))
    one = t.select(id_col, F.explode("t").alias("term"), F.lit(1.0).alias("unit"))
    two = t.select(id_col, F.explode(pairs).alias("term"), F.lit(0.5).alias("unit"))
    tf = one.unionByName(two).groupBy(id_col, "term", "unit").agg(F.count(F.lit(1)).alias("tf")).withColumn("h", fnv1a(F.col("term")))
    sign = F.when(F.col("h") >= 2**31, -1.0).otherwise(1.0)
    cells = tf.groupBy(id_col, F.pmod("h", F.lit(size)).alias("index")).agg(F.sum(sign * F.col("unit") * (1 + F.log("tf"))).alias("x"))
    from pyspark.sql import Window

    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(id_col)))
    return cells.select(id_col, "index", F.when(norm > 0, F.col("x") / norm).otherwise(0.0).alias("weight"))


def embedding_by(provider, size: int):
    """A column function from texts to vectors by ``provider(texts) -> vectors``, called once an Arrow batch.

    Null texts get null and aren't sent.  A vector of another length than ``size`` ends the job.  The provider goes to the
    executors, so it opens its connections when it is called.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(x: pd.Series) -> pd.Series:
        some = x.dropna()
        vectors = [[float(v) for v in vector] for vector in provider(some.tolist())] if len(some) else []
        if len(vectors) != len(some) or any(len(v) != size for v in vectors):
            raise ValueError(f"the provider gave other than {len(some)} vectors of {size}")
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        for i, v in zip(some.index, vectors, strict=True):
            out.at[i] = v
        return out

    return embed
