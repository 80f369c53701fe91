"""Queries of streams, retrieval, graphs, scores, extraction and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import count_lines
from quarry.operators import detect, extract, filters, graph, retrieve, score
from quarry.sources import sinks
from quarry.streaming import progress, runner, windows

from .catalog import query, read, spread

# -- streams -----------------------------------------------------------------------------------------------------------


@query("s_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def s_tumbling(spark, d):
    return windows.tumbling(read(spark, d, "events"), "ts", "1 hour", "event_type", value="value")


@query(
    "s_sliding",
    """SELECT b - o * INTERVAL 5 MINUTE AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS b, event_type FROM events), range(3) t(o) GROUP BY 1, 2""",
)
def s_sliding(spark, d):
    return windows.sliding(read(spark, d, "events"), "ts", "15 minutes", "5 minutes", "event_type")


@query(
    "s_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
)
def s_session(spark, d):
    return windows.sessions(read(spark, d, "events"), "ts", "6 hours", "user_id")


@query("s_rate_limit", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def s_rate_limit(spark, d):
    return windows.over_limit(read(spark, d, "events"), "ts", "user_id", 1, "1 hour")


@query("s_stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def s_stream_tumbling(spark, d):
    stream = runner.read_parquet_stream(spark, d, "events.parquet")
    return runner.settle(windows.tumbling(stream, "ts", "1 hour", "event_type", delay="1 day"))


@query("s_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def s_stream_dedup(spark, d):
    stream = runner.read_parquet_stream(spark, d, "events.parquet").select("ts", "user_id", "event_type")
    return runner.settle(windows.first_of(stream, "ts", ["user_id", "event_type"], "400 days").select("user_id", "event_type"), "append")


@query("s_stream_static_join", "SELECT event_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id")
def s_stream_static_join(spark, d):
    stream = runner.read_parquet_stream(spark, d, "events.parquet").select("event_id", F.col("user_id").alias("c_custkey"))
    return runner.settle(windows.enriched(stream, read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("event_id", "c_name"), "append")


_STEPS = "SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS step, CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'skipped' ELSE 'completed' END AS status, ts, event_id FROM events"


def _steps(df):
    status = F.when(F.col("event_id") % 4 == 1, "running").when(F.col("event_id") % 4 == 2, "skipped").otherwise("completed")
    return df.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("step"), status.alias("status"), F.struct("ts", "event_id").alias("at"))


@query(
    "s_run_progress",
    f"""WITH l AS (SELECT run_id, step, arg_max(status, (ts, event_id)) AS status FROM ({_STEPS}) GROUP BY 1, 2), d AS (SELECT run_id, count(*) FILTER (status IN ('completed', 'skipped')) AS done FROM l GROUP BY 1)
    SELECT run_id, CAST(done AS INTEGER) AS done, CAST(floor(100 * done / 15 + 0.5) AS INTEGER) AS percent, CASE WHEN done = 15 THEN 'completed' ELSE 'running' END AS state FROM d""",
)
def s_run_progress(spark, d):
    return progress.summary(_steps(read(spark, d, "events")), 15)


@query("s_stale_runs", "SELECT user_id, max(ts) AS seen FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 60 MINUTE")
def s_stale_runs(spark, d):
    return windows.stale(read(spark, d, "events"), "user_id", "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"))


# -- retrieval ---------------------------------------------------------------------------------------------------------


def _one_vector(spark, d):
    return read(spark, d, "embeddings").where("vec_id = 7").select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector"))


@query(
    "r2_vector_topk",
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q)
    SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 20""",
)
def r2(spark, d):
    hits = retrieve.dense(read(spark, d, "embeddings"), _one_vector(spark, d), 20, "vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


_KW = """w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS term FROM documents), i AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE length(term) > 1 GROUP BY 1, 2),
    k AS (SELECT doc_id, sum(1 + ln(tf)) AS s FROM i WHERE term IN ('the', 'license', 'copyright') GROUP BY 1)"""


def _keyword(spark, d, n):
    docs = read(spark, d, "documents")
    q = spark.createDataFrame([(0, "the license: Copyright")], "query_id int, query string")
    return retrieve.keyword(retrieve.inverted_index(docs, "doc_id", "text"), q, n, "doc_id")


@query("r3_keyword_topk", f"WITH {_KW} SELECT doc_id, round(s, 6) AS score FROM k ORDER BY s DESC, doc_id LIMIT 20")
def r3(spark, d):
    return _keyword(spark, d, 20).select("doc_id", F.round("score", 6).alias("score"))


_T = r"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    "r4_symbol_topk",
    f"""WITH t AS (SELECT p_partkey, unnest(['steel', 'brushed']) AS term, {_T.format("p_type")} AS a, {_T.format("p_name")} AS b FROM part),
    q AS (SELECT *, {_T.format("term")} AS t FROM t),
    s AS (SELECT p_partkey, greatest(max(len(list_intersect(a, t)) / len(list_distinct(list_concat(a, t)))), 0.7 * max(len(list_intersect(b, t)) / len(list_distinct(list_concat(b, t))))) AS s FROM q GROUP BY 1)
    SELECT p_partkey, round(s, 6) AS score FROM s WHERE s > 0.1 ORDER BY s DESC, p_partkey LIMIT 20""",
)
def r4(spark, d):
    parts = read(spark, d, "part").select("p_partkey", F.col("p_type").alias("symbol"), F.col("p_name").alias("path"))
    q = spark.createDataFrame([(0, "steel brushed ab")], "query_id int, terms string")
    return retrieve.symbol(parts, q, 20, "p_partkey").select("p_partkey", F.round("score", 6).alias("score"))


@query(
    "r5_rrf",
    f"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id) AS r FROM embeddings, q),
    {_KW}, kr AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM k),
    m AS (SELECT doc_id, 'dense' AS l, r, 1 / (60 + r) AS x FROM v WHERE r <= 60 UNION ALL SELECT doc_id, 'keyword', r, 1 / (60 + r) FROM kr WHERE r <= 60),
    f AS (SELECT doc_id, sum(x) AS fused, count(DISTINCT l) AS found, min(CASE WHEN l = 'dense' THEN r END) AS rd, min(CASE WHEN l = 'keyword' THEN r END) AS rk FROM m GROUP BY 1),
    b AS (SELECT doc_id, rd, rk, fused * CASE WHEN lang = 'en' THEN 1.35 ELSE 1 END * CASE WHEN contains(source, 'src1') THEN 1.5 ELSE 1 END * CASE WHEN doc_id % 10 = 0 THEN 0.75 ELSE 1 END * CASE WHEN found > 1 THEN 1.15 ELSE 1 END AS s FROM f JOIN documents USING (doc_id))
    SELECT doc_id, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 12) DESC, rd NULLS LAST, rk NULLS LAST, doc_id) AS place FROM b QUALIFY place <= 20""",
)
def r5(spark, d):
    dense = retrieve.dense(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _one_vector(spark, d), 60, "doc_id")
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("path"), F.lit(None).cast("string").alias("symbol"), F.col("lang").alias("role"), F.col("lang").alias("language"), (F.col("doc_id") % 10 == 0).alias("is_test"))
    out = retrieve.fuse({"dense": dense, "keyword": _keyword(spark, d, 60)}, docs, 20, ["en"], ["src1"], id_col="doc_id")
    return out.select("doc_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("r7_context")
def r7(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "n_chars")
    lines = docs.withColumn("lines", count_lines(F.col("content")))
    hits = lines.select("path", "lines", F.explode(F.array(*[F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for a, b in ((1, 3), (3, 5), (9, 9))])).alias("x"), (F.col("n_chars") % 97).cast("double").alias("score")).where("x.end_line <= lines")
    return retrieve.context(hits.select("path", "x.start_line", "x.end_line", "score").orderBy(F.col("score").desc(), "path").limit(60), docs)


@query(
    "r8_citations",
    """WITH c AS (SELECT doc_id, doc_id % 9 AS first, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents) SELECT doc_id, first >= 1 AND first <= n AS valid FROM c""",
)
def r8(spark, d):
    docs = read(spark, d, "documents")
    files = docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.size(F.split("text", "\n", -1)).alias("line_count"))
    cites = docs.select("doc_id", F.concat(F.lit("./"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (F.col("doc_id") % 9).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return retrieve.validate_citations(cites, files).select("doc_id", "valid")


# -- graphs ------------------------------------------------------------------------------------------------------------


def _order_edges(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1500).alias("b")).distinct()


@query(
    "g_reachable_all",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + o_orderkey) % 1500 AS b FROM orders), r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT CAST(b AS BIGINT) FROM r JOIN e ON a = node) SELECT node FROM r""",
)
def g_reachable_all(spark, d):
    return graph.reachable(_order_edges(spark, d), "a", "b", spark.createDataFrame([(1,)], "r long"), "r")


@query(
    "g_in_cycles",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + o_orderkey) % 1500 AS b FROM orders),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT e.a, e.b FROM e JOIN r ON r.a = e.b AND r.b = e.a""",
)
def g_in_cycles(spark, d):
    return graph.in_cycles(_order_edges(spark, d), "a", "b")


_BY_STATUS = "SELECT DISTINCT o_orderstatus AS g, o_custkey AS a, (o_custkey * 7 + o_orderkey) % 1500 AS b FROM orders"


@query(
    "g_cycles",
    f"""WITH RECURSIVE e AS ({_BY_STATUS}), r AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON e.g = r.g AND e.a = r.b),
    c AS MATERIALIZED (SELECT x.g, x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.g = x.g AND y.a = x.b AND y.b = x.a GROUP BY 1, 2),
    i AS MATERIALIZED (SELECT e.g, component, e.a, e.b FROM e JOIN c ON c.g = e.g AND c.node = e.a JOIN c d USING (component) WHERE d.g = e.g AND d.node = e.b),
    bfs(g, component, node, far) USING KEY (g, component, node) AS (
      SELECT DISTINCT g, component, component, 0 FROM c
      UNION SELECT i.g, i.component, i.b, min(t.far + 1) FROM bfs t JOIN i ON i.g = t.g AND i.component = t.component AND i.a = t.node
      WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs k WHERE k.g = i.g AND k.component = i.component AND k.node = i.b) GROUP BY 1, 2, 3
    ), back AS MATERIALIZED (SELECT v.g, v.component, v.node, v.far, min(u.node) AS back FROM bfs v JOIN i ON i.g = v.g AND i.component = v.component AND i.b = v.node JOIN bfs u ON u.g = v.g AND u.component = v.component AND u.node = i.a AND u.far = v.far - 1 GROUP BY ALL),
    ends AS (SELECT i.g, i.component, arg_min(t.node, (t.far, t.node)) AS node FROM i JOIN bfs t ON t.g = i.g AND t.component = i.component AND t.node = i.a WHERE i.b = i.component GROUP BY 1, 2),
    path AS (SELECT g, component, node, [node] AS cycle FROM ends UNION ALL SELECT p.g, p.component, b.back, list_prepend(b.back, p.cycle) FROM path p JOIN back b ON b.g = p.g AND b.component = p.component AND b.node = p.node WHERE p.node <> p.component)
    SELECT g AS o_orderstatus, component, (SELECT count(*) FROM c WHERE c.g = p.g AND c.component = p.component) AS size, array_to_string(cycle, '>') AS cycle FROM path p WHERE node = component""",
)
def g_cycles(spark, d):
    o = read(spark, d, "orders").select("o_orderstatus", F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1500).alias("b"))
    return graph.cycles(o.distinct(), "o_orderstatus", "a", "b").withColumn("cycle", F.array_join(F.col("cycle").cast("array<string>"), ">"))


@query(
    "j5_best_route",
    r"""WITH c AS (SELECT page_id AS call_id, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS verb, list_filter(string_split(lower(regexp_replace(url, '^[a-z]+://[^/]*', '')), '/'), lambda s: s <> '') AS cs FROM pages),
    r AS (SELECT 1 AS route_id, 'ALL' AS rv, ['blog', ':id'] AS rs UNION ALL SELECT 2, 'GET', [':a', ':b', 'x'] UNION ALL SELECT 3, 'GET', ['blog', ':id'] UNION ALL SELECT 4, 'POST', ['docs', ':id'] UNION ALL SELECT 5, 'GET', [':x', 'page']),
    p AS (SELECT *, list_slice(cs, len(cs) - len(rs) + 1, len(cs)) AS t, len(list_filter(rs, lambda s: NOT starts_with(s, ':'))) AS lits FROM c, r WHERE len(rs) <= len(cs)),
    h AS (SELECT call_id, route_id, 10 * lits + len(rs) + CASE WHEN verb = rv THEN 3 ELSE 0 END + CASE WHEN len(rs) = len(cs) THEN 2 ELSE 0 END AS score FROM p
      WHERE len(list_filter(generate_series(1, len(rs)), lambda i: rs[i] <> t[i] AND NOT starts_with(rs[i], ':'))) = 0 AND (verb = rv OR verb IS NULL OR rv = 'ALL'))
    SELECT c.call_id, CAST(b.route_id AS INTEGER) AS route_id, CAST(b.score AS INTEGER) AS score FROM c LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY score DESC, route_id) = 1) b USING (call_id)""",
)
def j5(spark, d):
    from quarry.operators.joins import best_route

    verb = F.when(F.col("page_id") % 3 == 0, "GET").when(F.col("page_id") % 3 == 1, "POST")
    calls = read(spark, d, "pages").select(F.col("page_id").alias("call_id"), verb.alias("verb"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    routes = spark.createDataFrame([(1, "ALL", "/blog/:id"), (2, "GET", "/:a/:b/x"), (3, "GET", "/blog/:id"), (4, "POST", "/docs/:id"), (5, "GET", "/:x/page")], "route_id int, verb string, path string")
    return best_route(calls, routes).select("call_id", "route_id", "score")


# -- extraction and scores ---------------------------------------------------------------------------------------------


@query(
    "e1_windows",
    """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(1, n + 1, 7)) AS s FROM n)
    SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(s + 9, n) AS INTEGER) AS "end" FROM w WHERE s = 1 OR s - 7 + 9 < n""",
)
def e1_windows(spark, d):
    docs = read(spark, d, "documents")
    out = extract.windows(docs, "doc_id", F.size(F.split("text", "\n", -1)), 10, 3)
    return out.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query(
    "e1_chunks_all",
    """WITH n AS (SELECT doc_id, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM documents),
    w AS (SELECT doc_id, l, n, unnest(CASE WHEN n <= 220 THEN [CAST(1 AS BIGINT)] ELSE range(1, n + 1, 140) END) AS s FROM n),
    c AS (SELECT doc_id, l, s, CASE WHEN n <= 220 THEN n ELSE least(s + 159, n) END AS e FROM w WHERE s = 1 OR s + 19 < n)
    SELECT CAST(doc_id AS VARCHAR) AS path, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line FROM c WHERE trim(regexp_replace(array_to_string(l[s:e], chr(10)), '\\s+', ' ', 'g')) <> ''""",
)
def e1_chunks_all(spark, d):
    """Documents of any length, in windows where they are long."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("markdown").alias("language"), F.col("text").alias("content"))
    return extract.chunks(docs).select("path", "start_line", "end_line")


def _code(spark, d):
    """Files of code made from the parts, for the extractors to work on."""
    p = spread(read(spark, d, "part").select("p_partkey"))
    body = F.concat(
        F.lit("import { helper, spare } from './util';\nexport async function part"), "p_partkey", F.lit("(id) {\n  const key = process.env.PART_KEY;\n  const rows = await db.query(`SELECT * FROM part WHERE id = ${id}`);\n  if (rows.length) { return helper(rows); }\n  return null;\n}\nrouter.get('/parts/"),
        "p_partkey", F.lit("/:id', requireAuth, part"), "p_partkey", F.lit(");\nfetch(`/api/parts/${id}`);\n"),
    )
    return p.select(F.concat(F.lit("src/part"), "p_partkey", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), body.alias("content"), F.lit(False).alias("is_test"), F.lit(False).alias("is_generated"))


@query("e2_symbols", "SELECT 'src/part' || p_partkey || '.ts' AS path, 'part' || p_partkey AS name, 'function' AS kind, 2 AS start_line, 7 AS end_line, true AS exported, true AS is_async FROM part")
def e2(spark, d):
    return extract.symbols(_code(spark, d)).select("path", "name", "kind", "start_line", "end_line", "exported", "is_async")


@query("e3_imports", "SELECT 'src/part' || p_partkey || '.ts' AS path, './util' AS specifier, 1 AS line FROM part")
def e3(spark, d):
    return extract.imports(_code(spark, d)).select("path", "specifier", "line")


@query("e7_routes", "SELECT 'src/part' || p_partkey || '.ts' AS file_path, 'GET' AS method, '/parts/' || p_partkey || '/:id' AS path, 8 AS line, true AS has_auth FROM part")
def e7(spark, d):
    return extract.routes(_code(spark, d)).select("file_path", "method", "path", "line", "has_auth")


@query("e8_http_calls", "SELECT 'src/part' || p_partkey || '.ts' AS file_path, 'GET' AS verb, '/api/parts/:param' AS path, 9 AS line FROM part")
def e8(spark, d):
    return extract.http_calls(_code(spark, d))


@query("e9_env_vars", "WITH p AS (SELECT 'src/part' || p_partkey || '.ts' AS path FROM part ORDER BY 1 LIMIT 6) SELECT 'PART_KEY' AS name, string_agg(path, ',' ORDER BY path) AS files FROM p")
def e9(spark, d):
    return extract.env_vars(_code(spark, d)).select("name", F.array_join("found", ",").alias("files"))


@query("k1_rules_on_code", "SELECT 'src/part' || p_partkey || '.ts' AS file_path, 'sec.sql-injection.template' AS rule_id, 4 AS start_line FROM part UNION ALL SELECT 'src/part' || p_partkey || '.ts', 'perf.select-star', 4 FROM part")
def k1_code(spark, d):
    return detect.run_rules(_code(spark, d)).select("file_path", "rule_id", "start_line")


@query("k4_unused_imports", "SELECT 'src/part' || p_partkey || '.ts' AS file_path, 'spare' AS title, 1 AS start_line FROM part")
def k4(spark, d):
    return detect.unused_imports(_code(spark, d)).select("file_path", "title", "start_line")


@query("k5_unreachable", "SELECT 'src/part' || p_partkey || '.py' AS file_path, 3 AS start_line FROM part WHERE p_partkey % 2 = 0")
def k5(spark, d):
    body = F.when(F.col("p_partkey") % 2 == 0, "def f():\n    return 1\n    x = 2\n").otherwise("def f():\n    if y:\n        return 1\n    x = 2\n")
    files = read(spark, d, "part").select(F.concat(F.lit("src/part"), "p_partkey", F.lit(".py")).alias("path"), F.lit("python").alias("language"), body.alias("content"), F.lit(False).alias("is_generated"))
    return detect.unreachable_lines(files).select("file_path", "start_line")


@query("k6_unprotected_routes", "SELECT 'x' AS file_path WHERE false")
def k6(spark, d):
    return detect.unprotected_routes(extract.routes(_code(spark, d))).select("file_path")


@query("k8_dead_files", "SELECT 'src/part' || p_partkey || '.ts' AS path FROM part ORDER BY 1")
def k8(spark, d):
    files = _code(spark, d).withColumn("is_config", F.lit(False))
    return detect.dead_files(files, graph.resolve_imports(extract.imports(files), files)).select("path")


@query("j3_resolve_imports", "SELECT 'src/part' || p_partkey || '.ts' AS path, './util' AS specifier, CAST(NULL AS VARCHAR) AS to_path, true AS is_external FROM part")
def j3_imports(spark, d):
    files = _code(spark, d)
    return graph.resolve_imports(extract.imports(files), files)


@query(
    "a18_scores",
    """WITH f AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 11 ELSE 1.2 END ELSE 0 END) / 20 AS sec, count(*) * 40 AS lines, sum(l_linenumber) AS dup, avg(l_quantity) / 4 AS cx, count(*) AS syms, count(*) FILTER (l_quantity > 40) AS high FROM lineitem GROUP BY 1),
    k AS (SELECT *, sqrt(greatest(lines / 1000, 0.5)) AS k FROM f)
    SELECT l_suppkey, CAST(floor(least(greatest(100 - sec / k, 0), 100) + 0.5) AS BIGINT) AS s_security, CAST(floor(least(greatest(100 - least(25, 400 * dup / lines), 0), 100) + 0.5) AS BIGINT) AS s_quality,
      CAST(floor(least(greatest(100 - least(45, greatest(0, 6 * (cx - 5))) - least(25, 150 * high / syms), 0), 100) + 0.5) AS BIGINT) AS s_complexity FROM k""",
)
def a18(spark, d):
    li = read(spark, d, "lineitem")
    w = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", 11.0).otherwise(1.2)).otherwise(0.0)
    rows = li.groupBy("l_suppkey").agg(
        (F.sum(w) / 20).alias("security"), (F.count(F.lit(1)) * 40).alias("lines"), F.sum("l_linenumber").alias("dup_lines"), (F.avg("l_quantity") / 4).alias("avg_complexity"),
        F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("l_quantity") > 40).alias("high_complexity"),
    )
    zero = {c: F.lit(0.0) for c in ("quality", "bug", "performance", "unprotected_routes", "dead_files", "unused_imports", "test_files", "code_files")}
    return score.scores(rows.withColumns({**zero, "has_framework": F.lit(True), "has_ci": F.lit(True)})).select("l_suppkey", "s_security", "s_quality", "s_complexity")


@query(
    "n6_cvss",
    """SELECT v, s FROM (VALUES ('CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H', 9.8::DOUBLE), ('CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N', 6.1::DOUBLE), ('CVSS:3.0/AV:L/AC:H/PR:L/UI:N/S:U/C:L/I:N/A:N', 2.5::DOUBLE), ('CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N', 0.0::DOUBLE), ('CVSS:3.1/AV:N', NULL)) t(v, s)""",
)
def n6(spark, d):
    from quarry.functions.numeric import cvss31

    v = ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", "CVSS:3.0/AV:L/AC:H/PR:L/UI:N/S:U/C:L/I:N/A:N", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", "CVSS:3.1/AV:N"]
    return spark.createDataFrame([(x,) for x in v], "v string").select("v", cvss31(F.col("v")).alias("s"))


# -- sinks -------------------------------------------------------------------------------------------------------------


@query("s17_sarif")
def s17(spark, d):
    o = read(spark, d, "orders")
    sev = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    rows = o.select(F.col("o_orderpriority").alias("rule_id"), sev.alias("severity"), F.col("o_orderstatus").alias("title"), F.concat(F.lit("src/"), "o_custkey").alias("file_path"), F.col("o_orderkey").cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("cwe"))
    return sinks.sarif_lines(rows)


@query(
    "s18_markdown",
    """WITH p AS (SELECT conv_id, turn, role, text FROM conversations)
    SELECT conv_id, '# Log' || chr(10) || chr(10) || string_agg('- [' || role || '](#' || role || ')', chr(10) ORDER BY turn) || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM p GROUP BY 1""",
)
def s18(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("role").alias("title"), F.col("text").alias("body"))
    return sinks.markdown(rows, "Log", "conv_id")


@query("s21_insights", """SELECT n_nationkey, 'nation' AS kind, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS data FROM nation""")
def s21(spark, d):
    return sinks.insight(read(spark, d, "nation"), "n_nationkey", "nation")


@query("f10_roles", "SELECT 'route' AS role, (SELECT count(*) FROM part) AS n")
def f10(spark, d):
    from quarry.operators.aggregates import counts_by

    return counts_by(_code(spark, d).select(filters.role(F.col("path"), F.col("content")).alias("role")), "role")
