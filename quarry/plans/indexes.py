"""Queries over stored indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import stems
from quarry.operators.textindex import TextIndex
from quarry.operators.trigramindex import LiteralIndex, NameIndex, symbol_search
from quarry.operators.vectorindex import VectorIndex, recall
from quarry.sources.checkpoints import new_folder

from .catalog import ORACLES, query, read

# -- stemmed words ------------------------------------------------------------------------------------------------------


def _case(w: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') THEN {then}" for s, then in rules) + f" ELSE {w} END"


def _head(w: str, n: int) -> str:
    return f"substr({w}, 1, length({w}) - {n})"


def _if(w: str, suffix: str, pattern: str, instead: str = "") -> str:
    head = _head(w, len(suffix))
    return f"CASE WHEN regexp_matches({head}, '{pattern}') THEN {head} || '{instead}' ELSE {w} END"


def porter_sql(source: str, column: str) -> str:
    """SELECT of ``column`` and its ``stem`` from ``source``, a step of the rules after the other."""
    lost = lambda n: f"CASE WHEN regexp_matches({_head('w', n)}, '[aeiouy]') THEN '+' || {_head('w', n)} ELSE w END"
    short = f"(regexp_matches(x, '{stems.SHORT_END}') AND regexp_matches(x, '{stems.M0}') AND NOT regexp_matches(x, '{stems.M1}'))"
    steps = [
        "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')",
        _case("w", [("sses", _head("w", 2)), ("ies", _head("w", 2)), ("ss", "w"), ("s", _head("w", 1))]),
        _case("w", [("eed", _if("w", "eed", stems.M0, "ee")), ("ed", lost(2)), ("ing", lost(3))]),
        f"CASE WHEN NOT starts_with(w, '+') THEN w ELSE (SELECT CASE WHEN regexp_matches(x, '(at|bl|iz)$') OR {short} THEN x || 'e' WHEN regexp_matches(x, '{stems.DOUBLE_END}') THEN {_head('x', 1)} ELSE x END FROM (SELECT substr(w, 2) AS x)) END",
        f"CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches({_head('w', 1)}, '[aeiouy]') THEN {_head('w', 1)} || 'i' ELSE w END",
        _case("w", [(s, _if("w", s, stems.M0, r)) for s, r in stems.STEP_2]),
        _case("w", [(s, _if("w", s, stems.M0, r)) for s, r in stems.STEP_3]),
        _case("w", [(s, _if("w", s, stems.M1) if s != "ion" else f"CASE WHEN regexp_matches({_head('w', 3)}, '{stems.M1}') AND regexp_matches({_head('w', 3)}, '[st]$') THEN {_head('w', 3)} ELSE w END") for s in stems.STEP_4]),
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({_head('w', 1)}, '{stems.M1}') OR (regexp_matches({_head('w', 1)}, '{stems.M0}') AND NOT regexp_matches({_head('w', 1)}, '{stems.SHORT_END}'))) THEN {_head('w', 1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{stems.M1}') THEN {_head('w', 1)} ELSE w END",
    ]
    inner = f"SELECT DISTINCT {column}, {column} AS w FROM {source}"
    for step in steps:
        inner = f"SELECT {column}, {step} AS w FROM ({inner})"
    return f"SELECT {column}, CASE WHEN regexp_matches({column}, '^[a-z]{{3,}}$') THEN lower(w) ELSE {column} END AS stem FROM ({inner})"


_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: length(x) > 1)"


def _stored_sql(weight: str) -> str:
    return f"""
    WITH w AS (SELECT doc_id, len(l) AS len, unnest(l) AS word FROM (SELECT doc_id, {_WORDS} AS l FROM documents)),
    q AS (SELECT item_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)) AS word FROM (SELECT item_id, {_WORDS} AS l FROM benchmark)),
    s AS MATERIALIZED ({porter_sql("(SELECT word FROM w UNION ALL SELECT word FROM q)", "word")}),
    p AS (SELECT doc_id, len, stem, count(*) AS tf FROM w JOIN s USING (word) GROUP BY ALL),
    a AS (SELECT DISTINCT item_id, stem FROM q JOIN s USING (word)),
    h AS (SELECT item_id, doc_id, sum(CAST(round({weight} * 1000000) AS BIGINT)) AS points FROM p JOIN a USING (stem) GROUP BY ALL)
    SELECT item_id, doc_id, CAST(points / 1000000 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY points DESC, doc_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 20
    """


def _stored(spark, d, by_length: bool):
    """The index is begun with the English texts and then brought up to the whole table, which writes the others only."""
    docs, index = read(spark, d, "documents"), TextIndex(spark, f"{new_folder(spark)}/texts", buckets=16, blocks=64)
    index.refresh(docs.where("lang = 'en'"))
    index = TextIndex(spark, index.path)
    index.refresh(docs)
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.search(asked, 20, by_length=by_length).withColumnRenamed("query_id", "item_id")


@query("r3_stored_index", _stored_sql("(1 + ln(tf))"))
def r3_stored(spark, d):
    return _stored(spark, d, False)


@query("r3_stored_by_length", _stored_sql("((1 + ln(tf)) / (1 + ln(len)))"))
def r3_by_length(spark, d):
    return _stored(spark, d, True)


# -- vectors -------------------------------------------------------------------------------------------------------------


def _vectors(spark, d) -> tuple:
    """The index of all embeddings, and every fiftieth of them as a query."""
    e = read(spark, d, "embeddings")
    index = VectorIndex(spark, f"{new_folder(spark)}/vectors", 64)
    index.build(e)
    return index, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(
    "r2_indexed_exact",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 12) AS s FROM e q JOIN e ON q.vec_id % 50 = 0)
    SELECT query_id, vec_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""",
)
def r2_indexed_exact(spark, d):
    index, asked = _vectors(spark, d)
    return index.search_exactly(asked, 20).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("r2_indexed")
def r2_indexed(spark, d):
    """What the nearest lists give, as many as trials say, beside the share of the exact answer that they hold."""
    index, asked = _vectors(spark, d)
    found = index.search(asked, 20, probes=index.probes_for(20)).select("query_id", F.col("id").alias("id"), "score", "rank")
    share = recall(found, index.search_exactly(asked, 20)).select("query_id", "recall")
    return found.join(share, "query_id").select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank", "recall")


# -- trigrams ------------------------------------------------------------------------------------------------------------


@query("f13_trigram_index", ORACLES["f13_line_search"])
def f13_trigrams(spark, d):
    """The lines that a scan finds, from an index that was begun with the English texts."""
    docs, index = read(spark, d, "documents"), LiteralIndex(spark, f"{new_folder(spark)}/trigrams", buckets=16, blocks=64)
    index.refresh(docs.where("lang = 'en'"))
    index.refresh(docs)
    return index.lines(docs, "license", 100).withColumn("line_no", F.col("line_no").cast("int"))


@query("r4_trigram_index", ORACLES["r4_symbol_topk"])
def r4_trigrams(spark, d):
    parts, folder = read(spark, d, "part"), new_folder(spark)
    symbols, paths = (NameIndex(spark, f"{folder}/{c}", buckets=8, blocks=16) for c in ("p_type", "p_name"))
    symbols.refresh(parts, "p_partkey", "p_type")
    paths.refresh(parts, "p_partkey", "p_name")
    q = spark.createDataFrame([(0, "steel brushed ab")], "query_id int, terms string")
    return symbol_search(symbols, paths, q, 20, "p_partkey").select("p_partkey", F.round("score", 6).alias("score"))
