"""Queries of the filters and detectors over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import detect, filters
from quarry.operators.aggregates import counts_by

from .catalog import query, read


@query(
    "f1_skip_reasons",
    """WITH r AS (SELECT CASE WHEN lang = 'fr' THEN 'ignored' WHEN n_chars > 6000 THEN 'too large' WHEN (CASE WHEN lang <> 'es' THEN lang END) IS NULL AND n_chars > 3000 THEN 'unknown and large' END AS reason FROM documents)
    SELECT reason, count(*) AS n FROM r GROUP BY 1""",
)
def f1(spark, d):
    docs = read(spark, d, "documents").withColumn("language", F.when(F.col("lang") != "es", F.col("lang")))
    return counts_by(filters.skip_reasons(docs, F.col("lang") == "fr", 6000, "language", "n_chars", unknown_most=3000), "reason")


@query("f2_limits", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def f2(spark, d):
    n, b = filters.check_limits(read(spark, d, "documents"), "n_chars", 10**9, 10**15)
    return spark.createDataFrame([(n, b)], "n long, bytes long")


@query(
    "f3_ignored_paths",
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(p, '(?:^|/)blog(?:/|$)') THEN false WHEN regexp_matches(p, '(?:^|/)[^/]*\.html(?:/|$)') THEN true WHEN regexp_matches(p, '(?:^|/)1[^/]*(?:/|$)') THEN true ELSE false END AS ignored FROM p""",
)
def f3(spark, d):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, d, "pages").select("page_id", filters.is_ignored(p, ["1*", "*.html", "!blog"]).alias("ignored"))


@query(
    "f4_incremental",
    """WITH o AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS s FROM documents WHERE doc_id % 7 <> 0)
    SELECT CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN o.doc_id IS NOT NULL AND o.s = n.s THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1""",
)
def f4(spark, d):
    docs = read(spark, d, "documents")
    old = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    new = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.expr("if(doc_id % 5 = 0, concat(text, '!'), text)"), 256).alias("sha"))
    return counts_by(filters.incremental(old, new), "state")


@query("f5_binary", "SELECT doc_id, false AS is_binary FROM documents")
def f5(spark, d):
    return read(spark, d, "documents").select("doc_id", filters.looks_binary(F.encode("text", "UTF-8")).alias("is_binary"))


@query("f6_language", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)[^/]\\.html$') THEN 'html' END AS language FROM pages")
def f6(spark, d):
    return read(spark, d, "pages").select("page_id", filters.language(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("language"))


@query(
    "f9_generated",
    """SELECT doc_id FROM documents WHERE contains(lower(substr(text, 1, 800)), '@generated') OR contains(lower(substr(text, 1, 800)), 'do not edit') OR contains(lower(substr(text, 1, 800)), 'auto-generated') OR contains(lower(substr(text, 1, 800)), 'autogenerated') OR contains(lower(substr(text, 1, 800)), 'generated by')""",
)
def f9(spark, d):
    return read(spark, d, "documents").where(filters.looks_generated(F.col("text"))).select("doc_id")


@query("f14_filter_search", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'urg'))")
def f14(spark, d):
    rows = filters.any_of(read(spark, d, "orders"), o_orderstatus=["F", "O"], o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None)
    return filters.search_columns(rows, "URG", "o_orderpriority", "o_orderstatus").select("o_orderkey")


@query("f15_category_view", "SELECT 'A' AS category, count(*) AS n FROM lineitem WHERE l_returnflag = 'A'")
def f15(spark, d):
    views = filters.category_views(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "category"), ["A", "N", "R"])
    return counts_by(views["A"], "category")


@query(
    "f16_null_aware_or",
    """SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN part ON p_partkey = CASE WHEN l_linenumber < 4 THEN l_partkey END LEFT JOIN supplier ON s_suppkey = l_suppkey
    WHERE p_size = 10 OR (CASE WHEN l_linenumber < 4 THEN l_partkey END IS NULL AND s_nationkey = 10)""",
)
def f16(spark, d):
    findings = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("if(l_linenumber < 4, l_partkey, null)").alias("file_id"), F.col("l_suppkey").alias("run_id"))
    files = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("branch_id"))
    runs = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("branch_id"))
    return filters.of_branch(findings, files, runs, 10).select("l_orderkey", "l_linenumber")


@query("f21_owner", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def f21(spark, d):
    return read(spark, d, "orders").where(F.col("o_custkey") == 7).select("o_orderkey")


@query("f23_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://')")
def f23(spark, d):
    return filters.with_prefix(read(spark, d, "pages"), "https://", "url").select("page_id")


@query("f25_comment_lines", """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, lang FROM documents) SELECT lang, count(*) AS n FROM l WHERE regexp_matches(trim(line), '^(//|/\\*|\\*|<!--)') GROUP BY 1""")
def f25(spark, d):
    lines = read(spark, d, "documents").select("lang", F.explode(F.split("text", "\n", -1)).alias("line"))
    return counts_by(lines.where(detect.comment_line(F.col("line"), F.col("lang"))), "lang")


@query("f26_drift", "SELECT bool_or(label <> 3) AS drift FROM embeddings WHERE embedding IS NOT NULL")
def f26(spark, d):
    return filters.model_drift(read(spark, d, "embeddings").withColumn("embedding_model", F.col("label").cast("string")), "3")


@query(
    "f18_policies",
    r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    f AS (SELECT 'no-token' AS policy, source || '/' || doc_id AS path, line FROM l WHERE regexp_matches(substr(raw, 1, 2000), 'token') AND regexp_matches(source || '/' || doc_id, '^src[0-4]/')
      UNION ALL SELECT 'has-the', source || '/' || doc_id, 1 FROM documents WHERE regexp_matches(source || '/' || doc_id, '^src9/') AND NOT regexp_matches(text, 'the'))
    SELECT policy, path, CAST(line AS INTEGER) AS line FROM f QUALIFY row_number() OVER (PARTITION BY policy ORDER BY path, line) <= 50""",
)
def f18(spark, d):
    files = read(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("content"), F.lit(False).alias("is_generated"))
    rules = spark.createDataFrame([("no-token", "^src[0-4]/", None, "token", None), ("has-the", "^src9/", None, None, "the")], "policy string, files string, exclude string, forbid string, require string")
    return filters.policy_findings(files, rules).select("policy", "path", F.col("line").cast("int").alias("line"))


@query("f19_unmatched", "SELECT 'none' AS policy")
def f19(spark, d):
    files = read(spark, d, "documents").select(F.col("source").alias("path"))
    rules = spark.createDataFrame([("some", "^src1$", None), ("none", "^nowhere/", None)], "policy string, files string, exclude string")
    return filters.unmatched_policies(files, rules).select("policy")


def _as_files(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".ts"))).alias("path"), F.lit("typescript").alias("language"),
        F.col("text").alias("content"), F.lit(False).alias("is_test"), F.lit(False).alias("is_generated"),
    )


@query("k1_static_rules")
def k1(spark, d):
    return detect.run_rules(_as_files(spark, d)).select("rule_id", "file_path", "start_line", "end_line", "severity", "confidence")


@query("k9_secrets")
def k9(spark, d):
    return detect.secret_findings(_as_files(spark, d)).select("rule_id", "file_path", "start_line", "snippet")


@query("k20_fingerprints")
def k20(spark, d):
    return detect.fingerprint(detect.run_rules(_as_files(spark, d))).select("rule_id", "file_path", "start_line", "fingerprint")


_TOK = r"regexp_extract_all(trim(regexp_replace(regexp_replace(html, '\b[0-9][0-9a-fA-FxX_.]*\b', 'N', 'g'), '\s+', ' ', 'g')), '[A-Za-z_$][\w$]*|[^\s\w]')"


@query("k11_near_duplicates")
def k11(spark, d):
    units = read(spark, d, "pages").select(F.col("page_id").alias("unit_id"), F.col("url").alias("path"), F.lit(1).alias("start_line"), F.col("html").alias("content"))
    return detect.near_duplicate_units(units, most_df=10_000)


@query(
    "x33_added_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i + 4 AS INTEGER) AS line, t AS text FROM l WHERE i % 2 = 0""",
)
def x33(spark, d):
    # every second line is added, the others are context
    marked = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 2 == 1, "+").otherwise(" "), x))
    patch = F.concat(F.lit("@@ -5,9 +5,9 @@ part\n"), F.array_join(marked, "\n"))
    return detect.added_lines(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), patch.alias("patch")))


@query("k16_verdict", "SELECT CASE WHEN bool_or(o_orderpriority < '3') THEN 'request_changes' ELSE 'comment' END AS verdict FROM orders")
def k16(spark, d):
    sev = F.when(F.col("o_orderpriority") < "2", "critical").when(F.col("o_orderpriority") < "3", "high").otherwise("medium")
    return detect.verdict(read(spark, d, "orders").select(sev.alias("severity")))


@query(
    "a29_merge_duplicates",
    """SELECT l_suppkey, max(l_discount) AS best FROM lineitem GROUP BY 1""",
)
def a29(spark, d):
    rows = read(spark, d, "lineitem").select(
        F.lit("bug").alias("category"), F.lit("r").alias("rule_id"), F.lit("t").alias("type"), F.lit("low").alias("severity"), F.lit("x").alias("title"),
        F.col("l_suppkey").cast("string").alias("file_path"), F.lit(1).alias("start_line"), F.col("l_discount").alias("confidence"), F.lit("static").alias("source"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
    )
    return detect.merge_duplicates(rows).select(F.col("file_path").cast("long").alias("l_suppkey"), F.col("confidence").alias("best"))


_CODE = ["for (const r of rows) {", "}", "  await db.query(q)", "  step(1)", "for (const x of xs) {"]


@query(
    "k3_n_plus_one",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber AS i, (l_partkey + l_linenumber) % 5 AS kind, {_CODE}[kind + 1] AS code FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i, code) AS line FROM l),
    c AS (SELECT *, sum(CASE kind WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY line) AS depth FROM n),
    loops AS (SELECT a.l_orderkey, a.line, coalesce(min(b.line), 1000000) AS ends FROM c a LEFT JOIN c b ON b.l_orderkey = a.l_orderkey AND b.line > a.line AND b.depth < a.depth WHERE a.kind IN (0, 4) GROUP BY ALL)
    SELECT DISTINCT 'src/' || o.l_orderkey || '.ts' AS file_path, CAST(o.line AS INTEGER) AS start_line, 'await db.query(' AS snippet FROM loops o JOIN c ON c.l_orderkey = o.l_orderkey AND c.kind = 2 AND c.line > o.line AND c.line < o.ends""",
)
def k3(spark, d):
    """A file for each order, whose lines open and close loops, reach for data or do not, as its items say."""
    kind = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(5)).cast("int")
    lines = read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.element_at(F.array(*[F.lit(c) for c in _CODE]), kind + 1).alias("code")).alias("x"))
    files = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select(
        F.concat(F.lit("src/"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("path"), F.array_join(F.col("x.code"), "\n").alias("content"), F.lit(False).alias("is_generated"),
    )
    return detect.loop_queries(files).select("file_path", "start_line", "snippet")


_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '(?m)(//|#).*$', ' ', 'g'), '"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''|`(?:\\.|[^`\\])*`', '"S"', 'g'), '\b[0-9][0-9a-fA-FxX_.]*\b', 'N', 'g')"""


@query(
    "k11_near_texts",
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[A-Za-z_$][\w$]*|[^\s\w]') AS t FROM documents WHERE text <> '' AND len(string_split(text, chr(10))) >= 8),
    r AS (SELECT doc_id, array_to_string(list_slice(t, i, i + 4), '/') AS h, min(i) AS i FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 4)) AS i FROM t WHERE len(t) >= 25) GROUP BY 1, 2),
    s AS (SELECT doc_id, h FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 600), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5),
    d AS (SELECT h FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40), k AS (SELECT doc_id, h FROM s JOIN d USING (h) JOIN n USING (doc_id)),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM k x JOIN k y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 6),
    z AS (SELECT a, b, shared, shared / (m.n + o.n - shared) AS s FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b)
    SELECT a, b, shared, round(s, 6) AS similarity FROM z WHERE s >= 0.72 ORDER BY s DESC, a, b LIMIT 60""",
)
def k11_texts(spark, d):
    """All documents as units, at the detector's own bounds."""
    units = read(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("start_line"), F.col("text").alias("content"))
    return detect.near_duplicate_units(units)
