"""Dense retrieval over lists of near vectors, approximately by a few lists or exactly by their bounds.

Centroids are fitted by k-means on a bounded sample; every vector goes to the list of its nearest centroid.  A query looks
into the lists nearest to it.  A list's radius bounds how near any of its vectors can be to a query, so the exact search
looks on into those lists only that could still hold a better one than the k-th best so far.  Vectors are of length 1, so
cosine and distance say the same; zero vectors, whose cosine is 0 with all, are a list of their own.

Below the index's folder, all Parquet: ``centroids`` (list, c), ``vectors/list=`` (id, v), ``radii`` (list, n, radius) and ``columns``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import numeric as num
from quarry.sources.checkpoints import cut

#: Vectors that the centroids are fitted on at most, and lists at most.
SAMPLE, LISTS = 50_000, 256
#: Vectors and queries that meet in one group.
ROWS, ASKS = 8192, 2048
#: Vectors whose exact answers say how many lists to look into.
TRIALS = 200
ZERO = -1
SLACK = 1e-9


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, 1))


class VectorIndex:
    """The index under a folder that all executors see.  ``size`` is the length that vectors are cut or padded to."""

    def __init__(self, spark: SparkSession, path: str, size: int):
        self.spark, self.path, self.size = spark, path.rstrip("/"), size

    # -- building ------------------------------------------------------------------------------------------------------

    def _unit(self, df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """(id, v): unit vectors; null vectors, and those with a component that is null or not finite, take no part."""
        own = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
        own = own.where(F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        return own.select("id", num.fit_unit(F.col("x"), self.size).alias("v"))

    def build(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> None:
        """Fit the centroids on at most about ``sample`` vectors, chosen by a hash of their ids, and put every vector into its list."""
        own = cut(self._unit(df, id_col, vec_col))
        some = own.where(F.exists("v", lambda x: x != 0))
        n = some.count()
        lists = min(lists or int(n**0.5) or 1, LISTS)
        chosen = some if n <= sample else some.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
        centres = KMeans(k=lists, seed=7, maxIter=8, initSteps=1).fit(chosen.select(array_to_vector("v").alias("features"))).clusterCenters() if lists > 1 and n > 1 else [np.ones(self.size)]
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "list int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        own.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")  # what the columns are if there is no vector
        self._put(own, "overwrite")

    def add(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """More vectors into the lists that there are; ids are to be new."""
        self._put(cut(self._unit(df, id_col, vec_col)), "append")

    def _centroids(self) -> np.ndarray:
        return np.array([r["c"] for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()])  # LISTS at most

    def _put(self, unit: DataFrame, mode: str) -> None:
        centres = self._centroids()
        kind = unit.schema["id"].dataType.simpleString()

        def place(frames):
            half = (centres**2).sum(1) / 2
            for f in frames:
                v = _matrix(f["v"])
                if not len(v):
                    continue
                at = (v @ centres.T - half).argmax(1)
                far = np.sqrt(((v - centres[at]) ** 2).sum(1))
                zero = ~v.any(1)
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "list": np.where(zero, ZERO, at).astype("int32"), "far": np.where(zero, 0.0, far)})

        placed = cut(unit.mapInPandas(place, f"id {kind}, v array<double>, list int, far double"))
        placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).coalesce(1).write.mode(mode).parquet(f"{self.path}/radii")
        placed.drop("far").repartitionByRange("list", "id").write.mode(mode).partitionBy("list").parquet(f"{self.path}/vectors")

    # -- searching -----------------------------------------------------------------------------------------------------

    def vectors(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns.add("list", T.IntegerType())).parquet(f"{self.path}/vectors")

    def _lists(self) -> dict[int, tuple[int, float]]:
        rows = self.spark.read.parquet(f"{self.path}/radii").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
        return {r["list"]: (r["n"], r["radius"]) for r in rows}

    def _nearest(self, queries: DataFrame, most: int | None) -> DataFrame:
        """(query_id, q, list, best): the lists a query looks into and the highest cosine each can give; of all, the nearest ``most``."""
        centres, lists = self._centroids(), self._lists()
        named = sorted(k for k in lists if k != ZERO)
        own, radius = centres[named], np.array([lists[k][1] for k in named])
        kind = queries.schema["query_id"].dataType.simpleString()

        def place(frames):
            for f in frames:
                for qid, v in zip(f["query_id"], f["v"], strict=True):
                    if ZERO in lists:
                        yield pd.DataFrame({"query_id": [qid], "q": [v], "list": np.array([ZERO], "int32"), "best": [0.0], "place": np.zeros(1, "int32")})
                    if not named:
                        continue
                    q = np.asarray(v)
                    gap = np.sqrt(((own - q) ** 2).sum(1))
                    near = np.maximum(gap - radius - SLACK, 0)
                    best = 1 - near**2 / 2 + SLACK if q.any() else np.full(len(named), SLACK)
                    order = np.argsort(gap, kind="stable")
                    rank = np.empty(len(named), "int32")
                    rank[order] = np.arange(1, len(named) + 1)
                    yield pd.DataFrame({"query_id": [qid] * len(named), "q": [v] * len(named), "list": np.array(named, "int32"), "best": best, "place": rank}).iloc[order[: most or None]]

        return queries.mapInPandas(place, f"query_id {kind}, q array<double>, list int, best double, place int")

    def _scored(self, asks: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score): the k best of the lists asked, for each block of vectors and of queries that meet."""
        lists = {i: -(-n // ROWS) for i, (n, _) in self._lists().items()}  # blocks of each list
        asked = {r["list"]: -(-r["n"] // ASKS) for r in asks.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not asked:
            return asks.select("query_id", F.lit(None).cast(self.vectors().schema["id"].dataType).alias("id"), F.lit(0.0).alias("score")).limit(0)
        of = lambda counts: F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("list"))
        block, part = (lambda c, n: F.pmod(F.xxhash64(c), n)), (lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
        left = self.vectors().where(F.col("list").isin(list(asked))).select("list", "id", "v", block("id", of(lists)).cast("int").alias("block"), part(of(asked)).alias("part"))
        right = asks.select("list", "query_id", "q", block("query_id", of(asked)).cast("int").alias("part"), part(of(lists)).alias("block"))

        def meet(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(v) or not len(q):
                return pd.DataFrame({"query_id": q["query_id"][:0], "id": v["id"][:0], "score": pd.Series([], dtype=float)})
            v = v.sort_values("id", kind="stable")
            ids = v["id"].to_numpy()
            scores = np.round(_matrix(q["q"]) @ _matrix(v["v"]).T, 12)
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            return pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), at.shape[1]), "id": ids[at].ravel(), "score": np.take_along_axis(scores, at, 1).ravel()})

        schema = f"query_id {asks.schema['query_id'].dataType.simpleString()}, id {self.vectors().schema['id'].dataType.simpleString()}, score double"
        keys = ["list", "block", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)

    @staticmethod
    def _top(hits: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _asked(self, queries: DataFrame) -> DataFrame:
        own = queries.select(F.col("query_id").alias("query_id"), F.col("vector").alias("vector"))
        return cut(self._unit(own, "query_id", "vector").withColumnRenamed("id", "query_id"))

    def probes_for(self, k: int, goal: float = 0.95, trials: int = TRIALS) -> int:
        """How many lists to look into to find the ``goal`` of the k most similar, from exact answers for about ``trials`` of the vectors.

        The trials are chosen by a hash of the ids; each exact answer's list has a place in its query's order, and the
        number is that quantile of the places.
        """
        n = sum(n for n, _ in self._lists().values())
        share = F.lit(min(1 << 20, int(trials / max(1, n) * (1 << 20)) + 1))
        tried = cut(self.vectors().where((F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 20)) < share) & (F.col("list") != ZERO)).select(F.col("id").alias("query_id"), F.col("v").alias("vector")))
        exact = self.search_exactly(tried, k).select("query_id", "id").join(self.vectors().select("id", "list"), "id")
        places = self._nearest(tried.withColumnRenamed("vector", "v"), None).select("query_id", "list", "place")
        found = exact.join(places, ["query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # LISTS rows at most
        wanted, so_far = goal * sum(r["n"] for r in found), 0
        for r in found:
            so_far += r["n"]
            if so_far >= wanted:
                return max(1, r["place"])
        return 1

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query_id, id, score, rank): the k most similar vectors of the ``probes`` nearest lists, for any number of queries (query_id, vector)."""
        return self._top(self._scored(cut(self._nearest(self._asked(queries), probes)), k), k)

    def search_exactly(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """The k most similar of all vectors; ties go to the smaller id.  ``probes`` is where it begins, not where it ends."""
        every = cut(self._nearest(self._asked(queries), None))
        first = cut(self._top(self._scored(every.where(F.col("place") <= probes), k), k))
        floor = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = every.where(F.col("place") > probes).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("best") >= F.col("floor")))
        return self._top(first.drop("rank").unionByName(self._scored(cut(rest.drop("floor")), k)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, found, wanted, recall) of two results (query_id, id)."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
