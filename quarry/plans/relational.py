"""Queries of the relational operators over the star schema and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregates as agg
from quarry.operators import joins, sets, sorts, windows

from .catalog import query, read


def _i(c: str):
    return F.col(c).cast("long").alias(c)


# -- groupings ---------------------------------------------------------------------------------------------------------


@query("a1_group_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def a1(spark, d):
    return agg.counts_by(read(spark, d, "lineitem"), "l_returnflag")


@query("a2_pair_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a2(spark, d):
    return agg.counts_by(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "a3_rollup",
    """SELECT o_orderstatus, o_orderpriority, CAST(CASE grouping_id(o_orderstatus, o_orderpriority) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS level, count(*) AS n
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def a3(spark, d):
    return agg.rollup_counts(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("a4_triple_counts", "SELECT c_nationkey, c_mktsegment, c_acctbal < 0 AS owing, count(*) AS n FROM customer GROUP BY 1, 2, 3")
def a4(spark, d):
    return agg.counts_by(read(spark, d, "customer").withColumn("owing", F.col("c_acctbal") < 0), "c_nationkey", "c_mktsegment", "owing")


@query(
    "a5_totals",
    "SELECT count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, CAST(coalesce(sum(len(string_split(text, chr(10)))), 0) AS BIGINT) AS lines FROM documents",
)
def a5(spark, d):
    docs = read(spark, d, "documents").withColumn("lines", F.size(F.split("text", "\n", -1)))
    return agg.totals(docs, chars="n_chars", lines="lines")


@query("a6_page_with_total", "SELECT o_orderkey, total FROM (SELECT o_orderkey, count(*) OVER () AS total FROM orders) ORDER BY o_orderkey DESC LIMIT 20")
def a6(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey")
    return agg.with_total(orders).orderBy(F.col("o_orderkey").desc()).limit(20)


@query("a7_incoming_counts", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def a7(spark, d):
    return agg.counts_by(read(spark, d, "lineitem"), "l_partkey")


@query(
    "a8_distribution",
    "SELECT round(coalesce(avg(l_quantity), 0), 6) AS mean, coalesce(max(l_quantity), 0) AS largest, count(*) FILTER (l_quantity > 45) AS n_high, count(*) AS n FROM lineitem",
)
def a8(spark, d):
    return agg.distribution(read(spark, d, "lineitem"), "l_quantity", 45).withColumn("mean", F.round("mean", 6))


@query(
    "a9_grouping_sets",
    """SELECT CASE grouping_id(o_orderstatus, o_orderpriority) WHEN 0 THEN 'ab' WHEN 1 THEN 'a' ELSE 'b' END AS grouped_by, o_orderstatus, o_orderpriority, count(*) AS n
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""",
)
def a9(spark, d):
    return agg.grouping_sets(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "a10_language_stats",
    """SELECT lang, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(n_chars) AS BIGINT) AS bytes,
      floor(CAST(sum(n_chars) AS DOUBLE) / greatest(CAST(sum(sum(n_chars)) OVER () AS DOUBLE), 1) * 1000 + 0.5) / 10 AS percent
    FROM documents GROUP BY lang""",
)
def a10(spark, d):
    docs = read(spark, d, "documents").withColumn("lines", F.size(F.split("text", "\n", -1)))
    return agg.shares(docs, "lang", "n_chars", "lines")


@query(
    "a11_directory_summary",
    """WITH g AS (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1),
    t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
    k AS (SELECT source, string_agg(lang || '=' || c, ',' ORDER BY lang) AS kinds FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2) GROUP BY 1)
    SELECT g.source, n, size, kinds, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) AS top
    FROM g JOIN t USING (source) JOIN k USING (source) WHERE r <= 6 GROUP BY g.source, n, size, kinds ORDER BY n DESC, g.source LIMIT 10""",
)
def a11(spark, d):
    out = agg.histogram_top(read(spark, d, "documents"), "source", "lang", "doc_id", "n_chars", 10, 6)
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("source", "n", "size", kinds.alias("kinds"), F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


@query(
    "a12_dominant_role",
    """WITH n AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2)
    SELECT source, lang AS dominant FROM n
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY (lang <> 'en') DESC, c DESC, CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 4 END, lang DESC) = 1""",
)
def a12(spark, d):
    return agg.dominant(read(spark, d, "documents"), "source", "lang", ["en"], ["de", "fr", "es"])


_EDGES = "SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem"


def _edges(spark, d):
    return read(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


@query(
    "a13_degree",
    f"""WITH e AS ({_EDGES}), o AS (SELECT a AS node, count(*) AS fan_out FROM e GROUP BY 1), i AS (SELECT b AS node, count(*) AS fan_in FROM e GROUP BY 1)
    SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM o FULL JOIN i USING (node)""",
)
def a13(spark, d):
    return agg.degrees(_edges(spark, d), "src", "dst")


@query(
    "a14_group_edges",
    """SELECT n1.n_name AS from_group, n2.n_name AS to_group, count(*) AS n, bool_or(o_orderpriority = '1-URGENT') AS flagged
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
    WHERE n1.n_name <> n2.n_name GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 40""",
)
def a14(spark, d):
    edges = (
        read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
        .join(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return agg.edges_between(edges, "s_nationkey", "c_nationkey", read(spark, d, "nation"), "n_nationkey", "n_name", F.col("o_orderpriority") == "1-URGENT", 40)


@query(
    "a17_duplicate_lines",
    """SELECT CAST(coalesce(sum(b - a + 1), 0) AS BIGINT) AS lines FROM (SELECT min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""",
)
def a17(spark, d):
    pairs = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.count("*").alias("n")).where("n > 1")
    return agg.pair_lines(pairs, "a", "b").select(_i("lines"))


@query(
    "a19_precision_recall",
    """WITH x AS (SELECT lang, quality = 0 AS a, n_chars < 900 AS p FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE lang END AS grp, count(*) FILTER (a AND p) AS hits, count(*) FILTER (a AND NOT p) AS misses, count(*) FILTER (NOT a AND p) AS false_alarms
      FROM x GROUP BY ROLLUP (lang))
    SELECT *, round(coalesce(hits / nullif(hits + false_alarms, 0), 1), 6) AS precision, round(coalesce(hits / nullif(hits + misses, 0), 1), 6) AS recall FROM c""",
)
def a19(spark, d):
    both = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return agg.precision_recall(both, "lang", F.col("quality") == 0, F.col("n_chars") < 900)


@query("a20_embedded_count", "SELECT count(*) FILTER (embedding IS NOT NULL) AS n FROM embeddings")
def a20(spark, d):
    return read(spark, d, "embeddings").agg(F.count("embedding").alias("n"))


@query(
    "a22_zero_filled",
    """WITH s AS (SELECT * FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, 'X')) t(place, o_orderstatus))
    SELECT CAST(place AS INTEGER) AS place, s.o_orderstatus, count(o.o_orderkey) AS n FROM s LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus GROUP BY 1, 2""",
)
def a22(spark, d):
    return agg.zero_filled(read(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query(
    "a23_best_of_two",
    "SELECT l_partkey, round(greatest(coalesce(max(l_discount), 0), coalesce(max(l_tax), 0) * 0.7), 6) AS score FROM lineitem GROUP BY 1",
)
def a23(spark, d):
    return agg.best_of_two(read(spark, d, "lineitem"), "l_partkey", "l_discount", "l_tax", 0.7).withColumn("score", F.round("score", 6))


@query(
    "a24_capped_lists",
    """WITH x AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM x)
    SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS found FROM r WHERE r <= 3 GROUP BY 1 ORDER BY 1 LIMIT 200""",
)
def a24(spark, d):
    return agg.capped_lists(read(spark, d, "orders"), "o_custkey", "o_orderpriority", 3, 200).withColumn("found", F.array_join("found", ","))


@query(
    "a26_layers",
    """SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size, string_agg(DISTINCT source, ',' ORDER BY source) AS places FROM documents GROUP BY lang ORDER BY size DESC, lang LIMIT 12""",
)
def a26(spark, d):
    by = read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("places"))
    return sorts.top(by, 12, F.col("size").desc(), "lang")


@query(
    "a27_prefer_direct",
    "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY (l_returnflag = 'N') DESC, l_orderkey, l_linenumber) = 1",
)
def a27(spark, d):
    rows = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return agg.prefer(rows, ["l_partkey", "l_suppkey"], (F.col("l_returnflag") == "N").desc(), "l_orderkey", "l_linenumber").drop("l_returnflag")


@query(
    "a28_worst_severity",
    """WITH x AS (SELECT o_custkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 3 ELSE 4 END AS r, o_orderstatus FROM orders)
    SELECT o_custkey, min_by(severity, r) AS severity, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS fixes, count(*) AS n FROM x GROUP BY 1""",
)
def a28(spark, d):
    sev = F.element_at(F.array(*[F.lit(s) for s in agg.SEVERITIES]), F.substring("o_orderpriority", 1, 1).cast("int"))
    out = agg.worst_by(read(spark, d, "orders").withColumn("severity", sev), ["o_custkey"], "severity", "o_orderstatus")
    return out.withColumn("fixes", F.array_join("fixes", ","))


@query(
    "a30_side_counts",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open FROM customer""",
)
def a30(spark, d):
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return agg.side_counts(read(spark, d, "customer").select("c_custkey"), "c_custkey", orders=orders, open=orders.where("o_orderstatus = 'O'"))


@query("a31_message_counts", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def a31(spark, d):
    return agg.counts_by(read(spark, d, "conversations"), "conv_id")


# -- windows -----------------------------------------------------------------------------------------------------------


@query("w1_rank_in_list", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings")
def w1(spark, d):
    rows = read(spark, d, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).alias("x"))
    return windows.ranked(rows, ["label"], F.col("x").desc(), "vec_id").select("label", "vec_id", _i("rank"))


@query(
    "w2_cap_per_group",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM l WHERE line LIKE '%the%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 8""",
)
def w2(spark, d):
    from quarry.functions.text import explode_lines

    lines = explode_lines(read(spark, d, "documents"), "doc_id", "text").where(F.contains("line", F.lit("the")))
    return windows.capped(lines, ["doc_id"], 8, "line_no").select("doc_id", F.col("line_no").cast("int").alias("line_no"))


@query(
    "w4_repeat_ordinal",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY line_no) AS rank FROM l QUALIFY rank > 1""",
)
def w4(spark, d):
    from quarry.functions.text import explode_lines

    lines = explode_lines(read(spark, d, "documents"), "doc_id", "text").withColumn("t", F.trim("line"))
    return windows.ranked(lines, ["doc_id", "t"], "line_no").where("rank > 1").select("doc_id", F.col("line_no").cast("int").alias("line_no"), _i("rank"))


@query("w5_first_seen_index", "SELECT o_orderpriority, row_number() OVER (ORDER BY f, o_orderpriority) - 1 AS index FROM (SELECT o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1)")
def w5(spark, d):
    return windows.first_seen_index(read(spark, d, "orders"), "o_orderpriority", "o_orderkey")


_IV = """iv AS (SELECT l_suppkey, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, s + CAST(l_quantity AS BIGINT) % 7 AS e, l_orderkey, l_linenumber FROM lineitem)"""


def _intervals(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return read(spark, d, "lineitem").select("l_suppkey", day.alias("s"), (day + F.pmod(F.col("l_quantity").cast("long"), F.lit(7))).alias("e"))


@query(
    "w6_interval_merge",
    f"""WITH {_IV}, m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT l_suppkey, min(s) AS s, max(e) AS e, count(*) AS merged FROM g GROUP BY l_suppkey, g""",
)
def w6(spark, d):
    return windows.islands(_intervals(spark, d), "l_suppkey", "s", "e")


@query(
    "w7_gaps",
    f"""WITH {_IV}, m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv)
    SELECT l_suppkey, b + 1 AS gap_start, s - 1 AS gap_end FROM m WHERE s - b - 1 >= 3""",
)
def w7(spark, d):
    return windows.gaps(_intervals(spark, d), "l_suppkey", "s", "e", 3)


@query("w8_latest_row", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w8(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return windows.latest(rows, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).drop("o_orderdate")


@query(
    "w9_last_messages",
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)""",
)
def w9(spark, d):
    return windows.last_n(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 6).withColumn("place", F.col("place").cast("long"))


@query("w10_share_of_total", "SELECT c_mktsegment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def w10(spark, d):
    from pyspark.sql import Window

    by = agg.counts_by(read(spark, d, "customer"), "c_mktsegment")
    return by.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@query(
    "w11_neighbours",
    "SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def w11(spark, d):
    return windows.neighbours(read(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "previous", "following")


@query("w12_batches", "SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS INTEGER) AS batch FROM orders")
def w12(spark, d):
    return windows.batches(read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 4, "o_orderkey")


@query(
    "w13_first_fit",
    """WITH RECURSIVE x AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
    f AS (
      SELECT o_custkey, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, '' AS taken FROM x WHERE r = 1
      UNION ALL
      SELECT x.o_custkey, x.r, CASE WHEN f.used + cost <= 300000 THEN f.used + cost ELSE f.used END, CASE WHEN f.used + cost <= 300000 THEN f.taken || ',' || o_orderkey ELSE f.taken END
      FROM f JOIN x ON x.o_custkey = f.o_custkey AND x.r = f.r + 1
    )
    SELECT o_custkey, used, substr(taken, 2) AS taken FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC) = 1""",
)
def w13(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("cost"))
    out = windows.first_fit(rows, "o_custkey", F.col("o_orderkey"), "cost", "o_orderkey", 300_000)
    return out.withColumn("taken", F.array_join(F.transform("taken", lambda x: x.cast("string")), ","))


@query(
    "w14_fit_until_overflow",
    """WITH x AS (SELECT o_custkey, o_orderkey, sum(floor(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders),
    y AS (SELECT *, max(CASE WHEN used > 400000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS over FROM x)
    SELECT o_custkey, o_orderkey FROM y WHERE over = 0""",
)
def w14(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("cost"))
    return windows.fit_until_overflow(rows, "o_custkey", ["o_orderkey"], "cost", 400_000).drop("cost")


@query(
    "w15_top_batches",
    """WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
    SELECT o_orderpriority, o_orderkey, CAST((r - 1) // 15 AS INTEGER) AS batch FROM r WHERE r <= 60""",
)
def w15(spark, d):
    rows = read(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return windows.top_batches(rows, "o_orderpriority", 60, 15, F.col("o_totalprice").desc(), "o_orderkey").drop("o_totalprice")


# -- orders, pages -----------------------------------------------------------------------------------------------------


@query(
    "t5_two_stage_page",
    """WITH p AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50)
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_custkey, o_orderkey) AS place FROM p""",
)
def t5(spark, d):
    rows = read(spark, d, "orders")
    first, then = [F.col("o_orderdate").desc(), F.col("o_orderkey")], [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_custkey"), F.col("o_orderkey")]
    return sorts.page(rows, 50, 50, first, then).select("o_orderkey", _i("place"))


@query(
    "t6_custom_order",
    """SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100""",
)
def t6(spark, d):
    from pyspark.sql import Window

    rows = sorts.top(read(spark, d, "orders"), 100, sorts.by_list(F.col("o_orderstatus"), ["P", "O"]), "o_orderkey")
    return rows.select("o_orderkey", F.row_number().over(Window.orderBy(sorts.by_list(F.col("o_orderstatus"), ["P", "O"]), "o_orderkey")).cast("long").alias("place"))


@query("t7_flag_then_name", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY (p_size > 40) DESC, p_name, p_partkey LIMIT 25")
def t7(spark, d):
    rows = read(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("a")))
    return sorts.top(rows, 25, (F.col("p_size") > 40).desc(), "p_name", "p_partkey").select("p_partkey", "p_name")


@query(
    "t8_two_stage_topk",
    """WITH q AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT p_partkey, p_size, coalesce(n, 0) AS n FROM part LEFT JOIN q ON l_partkey = p_partkey ORDER BY p_size DESC, p_partkey LIMIT 60)
    SELECT p_partkey, floor(p_size * CASE WHEN n > 30 THEN 0.4 ELSE 1 END + 0.5) AS priority FROM w ORDER BY priority DESC, p_partkey LIMIT 20""",
)
def t8(spark, d):
    n = agg.counts_by(read(spark, d, "lineitem"), "l_partkey")
    rows = read(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    priority = agg.half_up(F.col("p_size") * F.when(F.col("n") > 30, 0.4).otherwise(1.0)).cast("double")
    return sorts.two_stage(rows, 20, [F.col("p_size").desc(), F.col("p_partkey")], priority, F.col("p_partkey")).select("p_partkey", "priority")


@query(
    "t9_hotspots",
    f"""WITH e AS ({_EDGES}), o AS (SELECT a AS node, count(*) AS n FROM e GROUP BY 1), i AS (SELECT b AS node, count(*) AS n FROM e GROUP BY 1)
    SELECT node, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT * FROM o UNION ALL SELECT * FROM i) GROUP BY 1 ORDER BY degree DESC, node LIMIT 25""",
)
def t9(spark, d):
    deg = agg.degrees(_edges(spark, d), "src", "dst").select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    return sorts.top(deg, 25, F.col("degree").desc(), "node")


@query(
    "t10_contributions",
    """WITH c AS (SELECT o_custkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 5 ELSE 2 END AS score FROM orders
      UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END FROM customer)
    SELECT k, CAST(sum(score) AS BIGINT) AS score FROM c GROUP BY 1 HAVING sum(score) > 0 ORDER BY 2 DESC, k LIMIT 30""",
)
def t10(spark, d):
    o = read(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", 8).when(F.col("o_orderpriority") == "2-HIGH", 5).otherwise(2).alias("score")
    )
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 5000).cast("int").alias("score"))
    return sorts.contributions([o, c], "k", 30)


@query(
    "t12_greatest_version",
    """WITH v AS (SELECT p_brand, (p_size // 10) || '.' || (p_size % 10) || '.' || (p_partkey % 13) AS version, (p_size // 10) * 10000 + (p_size % 10) * 100 + (p_partkey % 13) AS k FROM part)
    SELECT p_brand, max_by(version, k) AS version FROM v GROUP BY 1""",
)
def t12(spark, d):
    v = F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10, F.col("p_partkey") % 13)
    return sorts.greatest_version(read(spark, d, "part").select("p_brand", v.alias("version")), "p_brand", "version")


@query("t13_newest", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def t13(spark, d):
    return sorts.top(read(spark, d, "orders"), 25, F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_orderkey")


@query(
    "t14_flagged_first",
    "SELECT page_id, regexp_matches(url, '(blog|docs)') AS flagged FROM pages ORDER BY flagged DESC, length(url) - length(replace(url, '/', '')), page_id LIMIT 25",
)
def t14(spark, d):
    depth = F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit("")))
    return sorts.flagged_first(read(spark, d, "pages"), F.col("url").rlike("(blog|docs)"), 25, depth, "page_id").select("page_id", "flagged")


@query("t15_smallest", "SELECT lang, min_by(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1")
def t15(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


# -- sets --------------------------------------------------------------------------------------------------------------


@query(
    "u1_bag_union",
    "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS INTEGER) AS size FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT p_partkey, NULL, p_size FROM part",
)
def u1(spark, d):
    parts = [
        read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")),
    ]
    return sets.union_all(parts)


@query(
    "u2_merge_ranked",
    """WITH a AS (SELECT l_partkey AS k, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1 ORDER BY rank LIMIT 50),
    b AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 50),
    m AS (SELECT k, 'count' AS list, rank FROM a UNION ALL SELECT k, 'price', rank FROM b)
    SELECT k, string_agg(list || ':' || rank, ',' ORDER BY list) AS ranks FROM m GROUP BY 1""",
)
def u2(spark, d):
    a = agg.counts_by(read(spark, d, "lineitem"), "l_partkey")
    from pyspark.sql import Window

    def top(df, key, *order):
        best = sorts.top(df, 50, *order)
        return best.select(F.col(key).alias("k"), F.row_number().over(Window.orderBy(*order)).alias("rank"))

    lists = {"count": top(a, "l_partkey", F.col("n").desc(), F.col("l_partkey")), "price": top(read(spark, d, "part"), "p_partkey", F.col("p_retailprice").desc(), F.col("p_partkey"))}
    merged = sets.merge_ranked(lists, "k")
    return merged.select("k", F.array_join(F.transform(F.map_entries("ranks"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("ranks"))


@query(
    "u3_union_unless",
    """SELECT s_nationkey AS nation, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)""",
)
def u3(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    b = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    return sets.union_unless(a, b, F.col("a.nation") == F.col("b.nation"))


@query("u4_removed", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u4(spark, d):
    return sets.minus(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("u5_distinct_first", "SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1")
def u5(spark, d):
    return sets.distinct_first(read(spark, d, "part").select("p_brand", "p_type", "p_partkey"), ["p_brand", "p_type"], "p_partkey")


@query(
    "u6_chunk_dedup",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM l WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, sha256(line) ORDER BY line_no) = 1""",
)
def u6(spark, d):
    from quarry.functions.text import explode_lines

    lines = explode_lines(read(spark, d, "documents"), "doc_id", "text").where("trim(line) <> ''").withColumn("hash", F.sha2("line", 256))
    return sets.distinct_first(lines.drop("line"), ["doc_id", "hash"], "line_no").select("doc_id", F.col("line_no").cast("int").alias("line_no"))


@query(
    "u7_merge_by_precedence",
    """WITH m AS (SELECT s_nationkey AS nation, s_suppkey AS id, 0 AS part FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer)
    SELECT nation, CAST(part AS INTEGER) AS part, min(id) AS id FROM m WHERE (nation, part) IN (SELECT (nation, min(part)) FROM m GROUP BY nation) GROUP BY 1, 2""",
)
def u7(spark, d):
    a = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_suppkey").alias("id"))
    b = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("c_custkey").alias("id"))
    return sets.merge_by_precedence([a, b], ["nation"])


@query(
    "s13_upsert",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, 0.0::DOUBLE FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def s13(spark, d):
    new = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("c_acctbal", F.lit(0.0))
    return sets.upsert(read(spark, d, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey")


# -- joins -------------------------------------------------------------------------------------------------------------


@query(
    "j3_first_candidate",
    """WITH c AS (SELECT c_custkey, unnest([c_custkey * 7, c_custkey * 3, c_custkey + 1]) AS x, generate_subscripts([1, 2, 3], 1) AS ord FROM customer)
    SELECT cu.c_custkey, (SELECT min_by(p_partkey, ord) FROM c JOIN part ON p_partkey = x WHERE c.c_custkey = cu.c_custkey) AS target FROM customer cu""",
)
def j3(spark, d):
    k = F.col("c_custkey")
    return joins.first_candidate(read(spark, d, "customer").select("c_custkey"), "c_custkey", F.array(k * 7, k * 3, k + 1), read(spark, d, "part"), "p_partkey", "p_partkey")


@query("j6_left_lookup", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j6(spark, d):
    cust = read(spark, d, "customer").where("c_acctbal > 0")
    return read(spark, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query(
    "j7_unique_suffix",
    """WITH f AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS p FROM pages),
    s AS (SELECT p, array_to_string(list_slice(string_split(p, '/'), i, len(string_split(p, '/'))), '/') AS s FROM f, LATERAL (SELECT unnest(generate_series(1, len(string_split(p, '/')))) AS i)),
    g AS (SELECT s, count(*) AS n, min(p) AS one, bool_or(p = s) AS exact FROM s GROUP BY 1),
    c AS (SELECT page_id, regexp_replace(regexp_extract(url, '[^/]+/?$', 0), '^(\\./|/)+', '') AS c FROM pages)
    SELECT page_id, CASE WHEN n IS NULL THEN 'missing' WHEN exact THEN 'exact' WHEN n = 1 THEN 'suffix' ELSE 'ambiguous' END AS verdict,
      CASE WHEN n IS NULL THEN NULL WHEN exact THEN c WHEN n = 1 THEN one END AS file FROM c LEFT JOIN g ON c = s""",
)
def j7(spark, d):
    pages = read(spark, d, "pages")
    files = pages.select(F.regexp_replace("url", "^[a-z]+://", "").alias("p")).distinct()
    cites = pages.select("page_id", F.regexp_extract("url", "[^/]+/?$", 0).alias("cite"))
    return joins.unique_suffix(cites, "cite", files, "p").select("page_id", "verdict", "file")


@query(
    "j9_shared_pairs",
    """WITH i AS (SELECT DISTINCT o_custkey AS k, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey), f AS (SELECT p FROM i GROUP BY p HAVING count(*) BETWEEN 2 AND 40), k AS (SELECT * FROM i JOIN f USING (p))
    SELECT a.k AS a, b.k AS b, count(*) AS shared FROM k a JOIN k b ON a.p = b.p AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def j9(spark, d):
    items = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), F.col("l_partkey").alias("p"))
    return joins.shared_count_pairs(items, "k", "p", 3, 2, 40)


@query("j10_lookup", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45")
def j10(spark, d):
    part = read(spark, d, "part").where("p_size > 45").select("p_partkey", "p_brand")
    return read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@query("j11_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS partial FROM customer")
def j11(spark, d):
    return joins.flag_if_in(read(spark, d, "customer").select("c_custkey"), "c_custkey", read(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey", "partial")


@query(
    "j12_carry_forward",
    """WITH p AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS resolved FROM orders GROUP BY 1) SELECT c_custkey AS k, coalesce(resolved, false) AS resolved FROM customer LEFT JOIN p ON k = c_custkey""",
)
def j12(spark, d):
    old = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "F").alias("resolved"))
    return joins.carry_forward(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), old, "k", ["resolved"])


@query("j13_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j13(spark, d):
    return sets.minus(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "j15_two_sided",
    """SELECT l_suppkey, s_name, count(DISTINCT l_partkey) AS parts, count(DISTINCT p_brand) AS brands FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def j15(spark, d):
    e = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    out = e.join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.groupBy("l_suppkey", "s_name").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("p_brand").alias("brands"))


@query("j18_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_partkey) IN (SELECT (o_orderkey, o_custkey) FROM orders)")
def j18(spark, d):
    keys = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"))
    return read(spark, d, "lineitem").join(keys, ["l_orderkey", "l_partkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query(
    "j20_theta_contains",
    """WITH t AS (SELECT DISTINCT lower(n_name) AS term FROM nation UNION SELECT unnest(['the', 'license', 'copyright', 'token']))
    SELECT doc_id, term FROM documents JOIN t ON contains(lower(text), term)""",
)
def j20(spark, d):
    names = read(spark, d, "nation").select(F.lower("n_name").alias("t")).distinct()
    more = spark.createDataFrame([(x,) for x in ("the", "license", "copyright", "token")], "t string")
    docs = read(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return joins.contains_any(docs, "text", names.union(more).distinct(), "t").select("doc_id", "term")


@query(
    "j21_summary",
    """SELECT n_name, count(c_custkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
)
def j21(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    s = read(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return agg.side_counts(read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", customers=c, suppliers=s).drop("n_nationkey")


@query(
    "j22_children",
    """WITH e AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY l_partkey) <= 10),
    k AS (SELECT l_partkey, l_suppkey AS name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) <= 8)
    SELECT o_custkey, l_partkey, p_brand, name FROM e JOIN part ON p_partkey = l_partkey JOIN k USING (l_partkey)""",
)
def j22(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    edges = read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")
    targets = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    kids = lines.select("l_partkey", F.col("l_suppkey").alias("name")).distinct()
    return joins.lookup_children(edges, targets, kids, "o_custkey", "l_partkey", 10, 8).select("o_custkey", "l_partkey", "p_brand", "name")
