"""The vector index against all similarities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieve, vectorindex
from quarry.operators.vectorindex import VectorIndex, recall

pytestmark = pytest.mark.usefixtures("few_partitions")


def plain(rows, queries, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    kept = [(i, unit(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in queries:
        scores = sorted(((-round(float(unit(v) @ w), 9), i) for i, w in kept))[:k]
        out |= {(q, i): (-s, r + 1) for r, (s, i) in enumerate(scores)}
    return out


def got(df):
    return {(r["query_id"], r["id"]): (round(r["score"], 9) + 0.0, r["rank"]) for r in df.collect()}


def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * rng.normal(size=8)]) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [(3000, [0.0] * 8), (3001, None), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8)]
    queries = [(i, rows[i][1]) for i in range(0, 900, 45)] + [(9000, [0.0] * 8), (9001, [float(x) for x in rng.normal(size=8)])]
    return rows, queries


def frames(spark, rows, queries):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, vector array<double>")


@pytest.mark.parametrize("block", [64])
def test_exact_search_equals_all_similarities_in_blocks_and_after_additions(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vectorindex, "ROWS", block)
    monkeypatch.setattr(vectorindex, "ASKS", 8)
    rows, queries = data()
    v, q = frames(spark, rows, queries)
    index = VectorIndex(spark, f"file://{tmp_path}/ix", 8)
    index.build(v.where("vec_id < 2010"), lists=10, sample=200)
    index.add(v.where("vec_id >= 2010"))
    assert index.vectors().count() == 941  # every vector that takes part is in a list
    assert got(index.search_exactly(q, 7, probes=1)) == plain(rows, queries, 7)
    near = index.search(q, 7, probes=index.probes_for(7, 0.95, 100))
    r = recall(near, index.search_exactly(q, 7)).where("query_id < 9000").agg(F.avg("recall")).first()[0]
    assert r >= 0.9


def test_more_than_a_thousand_queries_are_answered_exactly(spark):
    rows, _ = data()
    rows = rows[:120]
    queries = [(i, rows[i % 120][1]) for i in range(1100)]
    v, q = frames(spark, rows, queries)
    out = retrieve.dense(v, q, 3, "vec_id").select("query_id", F.col("vec_id").alias("id"), "score", "rank")
    assert got(out) == plain(rows, queries, 3)


def test_an_empty_table_and_one_vector(spark, tmp_path):
    v, q = frames(spark, [(1, [1.0, 2.0])], [(0, [2.0, 4.0])])
    for name, rows, want in (("one", v, {(0, 1): (1.0, 1)}), ("none", v.limit(0), {})):
        index = VectorIndex(spark, f"file://{tmp_path}/{name}", 2)
        index.build(rows)
        assert got(index.search_exactly(q, 3)) == want and got(index.search(q, 3)) == want
