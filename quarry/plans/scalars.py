"""Queries of the scalar functions over documents, pages, parts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import numeric as num
from quarry.functions import paths, text

from .catalog import query, read


def _docs(spark, d):
    return read(spark, d, "documents")


@query(
    "x1_tokens_x2_lines",
    """SELECT doc_id, CAST(ceil(length(text) / 3.6) AS BIGINT) AS tokens, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS INTEGER) AS lines FROM documents""",
)
def x1(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", text.estimate_tokens(t).alias("tokens"), text.count_lines(t).cast("int").alias("lines"))


@query(
    "x3_slice_lines",
    """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS part FROM documents""",
)
def x3(spark, d):
    return _docs(spark, d).select("doc_id", text.slice_lines(F.col("text"), 2, 4).alias("part"))


@query(
    "x4_line_of_offset",
    """SELECT doc_id, CAST(length(h) - length(replace(h, chr(10), '')) + 1 AS INTEGER) AS line FROM (SELECT doc_id, substr(text, 1, length(text) // 2) AS h FROM documents)""",
)
def x4(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    return _docs(spark, d).select("doc_id", text.line_of_offset(F.col("text"), half).cast("int").alias("line"))


@query(
    "x5_truncate",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || chr(10) || '… [' || (length(text) - 100) || ' more characters]' ELSE text END AS short FROM documents""",
)
def x5(spark, d):
    return _docs(spark, d).select("doc_id", text.truncate(F.col("text"), 100).alias("short"))


@query(
    "x6_identifier_words",
    r"""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(p_type || p_brand, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w)), ' ') AS words FROM part""",
)
def x6(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(text.split_identifier(F.concat("p_type", "p_brand")), " ").alias("words"))


@query(
    "x7_lexical_tokens",
    r"""WITH w AS (SELECT page_id, list_filter(string_split_regex(url, '[^A-Za-z0-9_$]+'), lambda w: length(w) > 1) AS ws FROM pages)
    SELECT page_id, array_to_string(flatten(list_transform(ws, lambda w: list_concat([lower(w)], list_filter(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda p: p <> ''), lambda p: lower(p)), lambda p: length(p) > 1 AND p <> lower(w))))), ' ') AS tokens FROM w""",
)
def x7(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(text.lexical_tokens(F.col("url")), " ").alias("tokens"))


@query(
    "x8_fnv1a",
    """SELECT p_partkey, list_reduce(list_concat([2166136261::HUGEINT], list_transform(string_split(p_brand, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS h FROM part""",
)
def x8(spark, d):
    return read(spark, d, "part").select("p_partkey", text.fnv1a(F.col("p_brand")).alias("h"))


@query("x9_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def x9(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))


_TRI = """list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(
    "x11_trigram_similarity",
    f"""WITH t AS (SELECT p_partkey, {_TRI.format("p_name")} AS a, {_TRI.format("'copper steel brass'")} AS b FROM part)
    SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS sim FROM t""",
)
def x11(spark, d):
    a, b = text.trigrams(F.col("p_name")), text.trigrams(F.lit("copper steel brass"))
    return read(spark, d, "part").select("p_partkey", F.round(text.trigram_similarity(a, b), 6).alias("sim"))


@query(
    "x14_entropy",
    """WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, ch, count(*) AS k, sum(count(*)) OVER (PARTITION BY p_partkey) AS t FROM c GROUP BY 1, 2)
    SELECT p_partkey, round(sum(-(k / t) * log2(k / t)), 6) AS bits FROM n GROUP BY 1""",
)
def x14(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(text.entropy(F.col("p_name")), 6).alias("bits"))


@query(
    "x15_call_paths",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url || '?q=1#x', '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS u FROM pages), t AS (SELECT page_id, regexp_replace('/' || u, '/{2,}', '/', 'g') AS u FROM p)
    SELECT page_id, CASE WHEN u = '/' THEN u ELSE regexp_replace(u, '/+$', '') END AS path FROM t""",
)
def x15(spark, d):
    return read(spark, d, "pages").select("page_id", paths.call_path(F.concat("url", F.lit("?q=1#x"))).alias("path"))


@query(
    "x16_route_paths",
    r"""WITH t AS (SELECT p_partkey, '/api/' || p_brand || '/{id}/<int:n>/:name/' || p_size AS r FROM part)
    SELECT p_partkey, regexp_replace(r, '\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*', ':param', 'g') AS path FROM t""",
)
def x16(spark, d):
    r = F.concat(F.lit("/api/"), "p_brand", F.lit("/{id}/<int:n>/:name/"), "p_size")
    return read(spark, d, "part").select("p_partkey", paths.route_path(r).alias("path"))


@query(
    "x17_route_group",
    r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[A-Za-z]+://[^/]*', ''), '/'), lambda s: s <> '' AND s NOT IN ('api', 'v1', 'v2', 'v3', 'rest', 'internal', 'public', 'app') AND NOT starts_with(s, ':')) AS s FROM pages)
    SELECT coalesce(s[1], 'root') AS grp, count(*) AS n FROM p GROUP BY 1""",
)
def x17(spark, d):
    path = F.regexp_replace("url", "^[A-Za-z]+://[^/]*", "")
    return read(spark, d, "pages").groupBy(paths.route_group(path).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x18_package_root",
    "SELECT page_id, regexp_extract(regexp_replace(url, '^[a-z]+://', '@'), '^(@[^/]+/[^/]+|[^/]+)', 1) AS root FROM pages",
)
def x18(spark, d):
    return read(spark, d, "pages").select("page_id", paths.package_root(F.regexp_replace("url", "^[a-z]+://", "@")).alias("root"))


@query(
    "x19_path_parts",
    r"""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS base, lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS ext FROM pages""",
)
def x19(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", paths.dirname(u).alias("dir"), paths.basename(u).alias("base"), paths.extension(u).alias("ext"))


@query(
    "x22_code_tokens",
    r"""SELECT page_id, CAST(len(regexp_extract_all(html, '[A-Za-z_$][\w$]*|[^\s\w]')) AS INTEGER) AS tokens FROM pages""",
)
def x22(spark, d):
    return read(spark, d, "pages").select("page_id", F.size(text.code_tokens(F.col("html"))).alias("tokens"))


@query(
    "x23_shingle_count",
    r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '[A-Za-z_$][\w$]*|[^\s\w]') AS t FROM pages)
    SELECT page_id, CAST(least(600, len(list_distinct(list_transform(generate_series(1, len(t) - 4), lambda i: array_to_string(list_slice(t, i, i + 4), '/'))))) AS INTEGER) AS n FROM t""",
)
def x23(spark, d):
    return read(spark, d, "pages").select("page_id", F.size(text.shingles(text.code_tokens(F.col("html")))).alias("n"))


@query(
    "x24_cyclomatic",
    r"""SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '\b(?:if|for|while|case|catch|elif|except|when)\b|&&|\|\|')) AS INTEGER) AS complexity FROM documents WHERE NOT contains(text, '?')""",
)
def x24(spark, d):
    docs = _docs(spark, d).where(~F.contains("text", F.lit("?")))
    return docs.select("doc_id", text.cyclomatic(F.col("text")).cast("int").alias("complexity"))


@query(
    "x25_number_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    SELECT doc_id, string_agg(lpad(CAST(i AS VARCHAR), 5, ' ') || ' | ' || line, chr(10) ORDER BY i) AS numbered FROM l GROUP BY 1""",
)
def x25(spark, d):
    return _docs(spark, d).select("doc_id", text.number_lines(F.col("text")).alias("numbered"))


@query("x29_one_line", r"SELECT doc_id, trim(regexp_replace(substr(text, 1, 400), '[ \t\n\r\f\v]+', ' ', 'g')) AS flat FROM documents")
def x29(spark, d):
    return _docs(spark, d).select("doc_id", text.one_line(F.substring("text", 1, 400)).alias("flat"))


@query("x32_semantic_header", "SELECT doc_id, substr('File: ' || source || chr(10) || 'Language: ' || lang || chr(10) || chr(10) || text, 1, 12000) AS header FROM documents")
def x32(spark, d):
    return _docs(spark, d).select("doc_id", text.semantic_header(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text")).alias("header"))


@query(
    "c3_path_suffixes",
    "SELECT page_id, len(string_split(url, '/')) AS n, array_to_string(list_slice(string_split(url, '/'), 2, 100), '/') AS second FROM pages",
)
def c3(spark, d):
    from quarry.operators.joins import path_suffixes

    s = path_suffixes(F.col("url"))
    return read(spark, d, "pages").select("page_id", F.size(s).cast("long").alias("n"), F.element_at(s, 2).alias("second"))


@query("c4_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def c4(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query(
    "n1_cosine",
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS sim FROM embeddings, q""",
)
def n1(spark, d):
    e = read(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(num.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))


@query(
    "n2_normalise",
    """WITH e AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 32) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e)
    SELECT vec_id, CASE WHEN l = 0 THEN round(v[1], 6) ELSE round(v[1] / l, 6) END AS first, CASE WHEN l = 0 THEN round(v[32], 6) ELSE round(v[32] / l, 6) END AS last FROM n""",
)
def n2(spark, d):
    u = num.fit_unit(F.col("embedding"), 32)
    e = read(spark, d, "embeddings").select("vec_id", u.alias("u"))
    return e.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 32), 6).alias("last"))


@query(
    "n3_hashed_embedding",
    r"""WITH t AS (SELECT page_id, list_filter(string_split_regex(lower(url), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM pages),
    u AS (SELECT page_id, unnest(t) AS term, 1.0 AS unit FROM t UNION ALL SELECT page_id, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || '~' || t[i + 1])), 0.5 FROM t),
    f AS (SELECT page_id, term, unit, count(*) AS tf, list_reduce(list_concat([2166136261::HUGEINT], list_transform(string_split(term, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS h FROM u GROUP BY 1, 2, 3),
    c AS (SELECT page_id, h % 1536 AS index, sum(CASE WHEN h >= 2147483648 THEN -1.0 ELSE 1.0 END * unit * (1 + ln(tf))) AS x FROM f GROUP BY 1, 2)
    SELECT page_id, index, round(x / sqrt(sum(x * x) OVER (PARTITION BY page_id)), 6) AS weight FROM c""",
)
def n3(spark, d):
    terms = F.filter(F.split(F.lower("url"), "[^a-z0-9]+"), lambda w: w != "")
    return num.hashed_embedding(read(spark, d, "pages"), "page_id", terms).withColumn("weight", F.round("weight", 6))


@query("n7_half_up", "SELECT o_orderkey, CAST(floor((o_totalprice - 200000) / 1000 + 0.5) AS BIGINT) AS r FROM orders")
def n7(spark, d):
    return read(spark, d, "orders").select("o_orderkey", num.half_up((F.col("o_totalprice") - 200000) / 1000).alias("r"))


@query(
    "n9_grades",
    "SELECT c_custkey, CASE WHEN s >= 90 THEN 'A' WHEN s >= 78 THEN 'B' WHEN s >= 65 THEN 'C' WHEN s >= 50 THEN 'D' ELSE 'F' END AS grade FROM (SELECT c_custkey, floor(least(greatest(c_acctbal / 100, 0), 100) + 0.5) AS s FROM customer)",
)
def n9(spark, d):
    return read(spark, d, "customer").select("c_custkey", num.grade(num.clamp(F.col("c_acctbal") / 100)).alias("grade"))


@query("d1_stale", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 60 MINUTE")
def d1(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return read(spark, d, "events").where(F.col("ts") < now - F.expr("INTERVAL 60 MINUTES")).select("event_id")


@query("d2_iso_strings", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def d2(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("d3_epoch_seconds", "SELECT event_id, CAST(epoch(ts) AS BIGINT) AS seconds FROM (SELECT event_id, make_timestamp(event_id * 1000000000) AS ts FROM events)")
def d3(spark, d):
    return read(spark, d, "events").select("event_id", F.unix_seconds(F.timestamp_seconds(F.col("event_id") * 1000)).alias("seconds"))


@query("d5_unexpired", "SELECT user_id, count(*) AS n FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1")
def d5(spark, d):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    return read(spark, d, "events").where(F.col("ts") + F.expr("INTERVAL 7 DAYS") > now).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
