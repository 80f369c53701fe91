"""Trigram indexes against scans."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieve
from quarry.operators.filters import line_search
from quarry.operators.trigramindex import LiteralIndex, NameIndex, character_trigrams, symbol_search

pytestmark = pytest.mark.usefixtures("few_partitions")

WORDS = ["License", "licence", "café", "ÄRGER", "foo_bar", "x = 1;", "日本語", "İs", "lic", "ense"]


def docs_of(spark, seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", " "]).join(rng.choice(WORDS) + rng.choice(["", "\n", " "]) for _ in range(rng.randrange(0, 12)))) for i in range(n)]
    return rows + [(n, None), (n + 1, "")], spark.createDataFrame(rows + [(n, None), (n + 1, "")], "doc_id long, text string")


def test_literals_are_found_as_by_a_scan_in_fewer_texts(spark, tmp_path):
    rows, docs = docs_of(spark, 1, 120)
    index = LiteralIndex(spark, f"file://{tmp_path}/ix", buckets=4, blocks=4)
    index.refresh(docs.where("doc_id < 100"))
    index.refresh(docs.where("doc_id <> 7"))
    docs = docs.where("doc_id <> 7")
    for literal in ("license", "ärger", "日本語", "LIC", "zzz", "o_b", "ic", "x = 1;ense"):
        assert index.lines(docs, literal, 1000).collect() == line_search(docs, literal, limit=1000).collect(), literal
    found = {(r["literal"], r["doc"]) for r in index.candidates(spark.createDataFrame([("foo_bar",), ("日本語",), ("zq",)], "literal string")).collect()}
    holding = {(x, i) for i, text in rows if i != 7 for x in ("foo_bar", "日本語") if x in (text or "").lower()}
    assert holding <= found and len(found) < 2 * 120


def test_trigrams_of_characters(spark):
    got = [sorted(r[0]) for r in spark.createDataFrame([("aBcab",), ("ab",), ("",), ("日本語x",)], "s string").select(character_trigrams(F.col("s"))).collect()]
    assert got == [["abc", "bca", "cab"], [], [], sorted(["日本語", "本語x"])]


def test_names_are_ranked_as_without_an_index(spark, tmp_path):
    rng = random.Random(2)
    chunks = spark.createDataFrame([(i, rng.choice(["getUser", "user_list", "Order", None]) if i % 5 else None, f"src/{rng.choice(['user', 'order', 'pay'])}/{i}.ts") for i in range(60)], "chunk_id long, symbol string, path string")
    q = spark.createDataFrame([(0, "user order ab"), (1, "paying")], "query_id int, terms string")
    symbols, paths = (NameIndex(spark, f"file://{tmp_path}/{c}", buckets=2, blocks=2) for c in ("symbol", "path"))
    symbols.refresh(chunks, "chunk_id", "symbol")
    paths.refresh(chunks, "chunk_id", "path")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in symbol_search(symbols, paths, q, 8).collect())
    assert got == sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in retrieve.symbol(chunks, q, 8).collect()) and got
