"""Queries of predicates, joins and conversions that the analysers and retrievers share."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import numeric as num
from quarry.functions import paths, text, values
from quarry.operators import aggregates, detect, docs, filters, joins, sets, tables, windows
from quarry.sources import readers

from .catalog import query, read

#: Documents as files and their lines as chunks; every third line has a name.
FILES = "SELECT doc_id AS id, source AS branch_id, source || '/' || doc_id AS path, CASE WHEN doc_id % 5 <> 0 THEN text END AS content, CASE WHEN lang <> 'fr' THEN lang END AS language, CASE WHEN doc_id % 4 = 0 THEN 'model' END AS role FROM documents"


def _files(spark, d):
    return read(spark, d, "documents").selectExpr(
        "doc_id as id", "source as branch_id", "source || '/' || doc_id as path", "if(doc_id % 5 <> 0, text, null) as content", "if(lang <> 'fr', lang, null) as language", "if(doc_id % 4 = 0, 'model', null) as role",
    )


def _turns(spark, d):
    return read(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as id", "conv_id as file_id", "if(turn % 3 = 0, role, null) as symbol")


_TURNS = "SELECT conv_id * 1000 + turn AS id, conv_id AS file_id, CASE WHEN turn % 3 = 0 THEN role END AS symbol FROM conversations"


@query(
    "s5_branch_files",
    f"SELECT id, path, md5(content) AS h, coalesce(language, 'unknown') AS language, coalesce(role, 'unknown') AS role FROM ({FILES}) WHERE branch_id = 'src1' AND content IS NOT NULL",
)
def s5(spark, d):
    return tables.analysable_files(_files(spark, d), "src1").select("id", "path", F.md5("content").alias("h"), "language", "role")


@query("j1_chunk_files", f"SELECT c.file_id, c.id, c.symbol, f.path, f.language FROM ({_TURNS}) c JOIN ({FILES}) f ON f.id = c.file_id")
def j1(spark, d):
    return tables.chunks_with_files(_turns(spark, d), _files(spark, d), "path", "language")


@query(
    "s6_duplicate_units",
    f"SELECT c.file_id, c.id, c.symbol, f.path FROM ({_TURNS}) c JOIN ({FILES}) f ON f.id = c.file_id WHERE c.symbol IS NOT NULL AND coalesce(f.language, '') <> 'de' ORDER BY c.id LIMIT 8000",
)
def s6(spark, d):
    return tables.duplicate_units(_turns(spark, d), _files(spark, d), F.col("language") == "de")


@query(
    "d4_retry_after",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(greatest(CAST(event_id % 200 - 20 AS DOUBLE), 0), 45)
    WHEN event_id % 3 = 1 THEN least(greatest(epoch(date_trunc('second', ts)) - epoch(date_trunc('minute', ts)) - 5, 0), 45) END AS wait FROM events""",
)
def d4(spark, d):
    header = F.expr("case when event_id % 3 = 0 then string(event_id % 200 - 20) when event_id % 3 = 1 then date_format(ts, \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\") else 'soon' end")
    return read(spark, d, "events").select("event_id", values.retry_after(header, F.expr("date_trunc('minute', ts) + interval 5 seconds"), 45.0).alias("wait"))


@query(
    "c6_string_or_list",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name || '|' || s_nationkey END AS names FROM supplier""",
)
def c6(spark, d):
    json = F.expr("case s_suppkey % 3 when 0 then '\"' || s_name || '\"' when 1 then ' [\"' || s_name || '\", \"' || s_nationkey || '\"]' else string(s_suppkey) end")
    return read(spark, d, "supplier").select("s_suppkey", F.array_join(values.string_or_list(json), "|").alias("names"))


@query("n4_rank_share", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 0.0 ELSE 2.0::DOUBLE / (60 + s_suppkey) END AS share FROM supplier")
def n4(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", num.rank_share(F.expr("if(s_suppkey % 7 = 0, null, s_suppkey)"), 2.0).alias("share"))


@query(
    "f12_vendored",
    """SELECT doc_id, doc_id % 4 IN (1, 3) AS vendored FROM documents""",
)
def f12(spark, d):
    path = F.expr("case doc_id % 4 when 0 then 'src/my_vendor/' when 1 then 'Vendor/' when 2 then 'src/vendors/' else 'web/node_modules/' end || lang || '/' || doc_id || '.js'")
    return read(spark, d, "documents").select("doc_id", filters.is_vendored(path).alias("vendored"))


@query("f24_picker", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 AND contains(lower(s_name), '0')")
def f24(spark, d):
    return filters.search_columns(read(spark, d, "supplier").where("s_nationkey = 3"), "0", "s_name").select("s_suppkey", "s_name")


@query(
    "j14_symbol_files",
    f"SELECT c.id, c.symbol, f.path FROM ({_TURNS}) c JOIN ({FILES}) f ON f.id = c.file_id WHERE contains(lower(c.symbol), 'user') AND f.branch_id = 'src2'",
)
def j14(spark, d):
    symbols = filters.search_columns(_turns(spark, d), "USER", "symbol")
    return tables.chunks_with_files(symbols, _files(spark, d).where("branch_id = 'src2'"), "path").select("id", "symbol", "path")


@query(
    "j17_changed_paths",
    """WITH f AS (SELECT doc_id, 'app/' || source || '/' || (doc_id % 50) || '.ts' AS path FROM documents), c AS (SELECT DISTINCT source || '/' || (doc_id % 50) || '.ts' AS p FROM documents WHERE lang = 'de' UNION SELECT '7.ts')
    SELECT doc_id, path FROM f WHERE EXISTS (SELECT 1 FROM c WHERE f.path = c.p OR ends_with(f.path, '/' || c.p))""",
)
def j17(spark, d):
    docs = read(spark, d, "documents")
    changed = docs.where("lang = 'de'").selectExpr("source || '/' || (doc_id % 50) || '.ts' as p").union(spark.sql("select '7.ts'"))
    return joins.in_changed_paths(docs.selectExpr("doc_id", "'app/' || source || '/' || (doc_id % 50) || '.ts' as path"), "path", changed, "p")


@query("w3_cap_per_file", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 12")
def w3(spark, d):
    return windows.capped(read(spark, d, "orders"), ["o_custkey"], 12, F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query(
    "u8_pinned_context",
    """WITH p AS (SELECT doc_id, source || lang AS path FROM documents WHERE doc_id % 100 = 1), r AS (SELECT doc_id, source || lang AS path FROM documents WHERE n_chars > 3000)
    SELECT * FROM p UNION ALL SELECT * FROM r WHERE path NOT IN (SELECT path FROM p)""",
)
def u8(spark, d):
    docs = read(spark, d, "documents").selectExpr("doc_id", "source || lang as path", "n_chars")
    pinned, found = docs.where("doc_id % 100 = 1").drop("n_chars"), docs.where("n_chars > 3000").drop("n_chars")
    return sets.union_unless(pinned, found, F.col("a.path") == F.col("b.path"))


@query("x20_stays_inside", "SELECT doc_id, doc_id % 5 IN (1, 3) AS inside FROM documents")
def x20(spark, d):
    path = F.expr("case doc_id % 5 when 0 then '/' || lang when 1 then 'a/../' || source when 2 then 'a/../../' || source when 3 then './' || lang || '/b' else '../' || lang end")
    return read(spark, d, "documents").select("doc_id", paths.stays_inside(path).alias("inside"))


@query("x34_human_bytes", """SELECT o_orderkey, CASE WHEN o_orderkey < 1024 THEN o_orderkey || ' B' WHEN o_orderkey < 1048576 THEN CAST(round(o_orderkey / 1024.0::DOUBLE, 1) AS VARCHAR) || ' KB' ELSE CAST(round(o_orderkey / 1048576.0::DOUBLE, 1) AS VARCHAR) || ' MB' END AS size FROM orders""")
def x34(spark, d):
    return read(spark, d, "orders").select("o_orderkey", text.human_bytes(F.col("o_orderkey")).alias("size"))


@query("c1_batches", "SELECT o_orderkey, o_custkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS INTEGER) AS batch FROM orders")
def c1(spark, d):
    return windows.batches(read(spark, d, "orders"), ["o_custkey"], 4, F.col("o_orderkey")).select("o_orderkey", "o_custkey", "batch")


@query("c2_vector_literal", "SELECT s_suppkey, '[' || printf('%.6f', s_acctbal) || ',' || printf('%.6f', s_acctbal / 8) || ']' AS v FROM supplier")
def c2(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", num.vector_literal(F.expr("array(s_acctbal, s_acctbal / 8)")).alias("v"))


@query("a21_skip_reasons", "SELECT CASE WHEN lang = 'fr' THEN 'ignored' WHEN n_chars > 2000 THEN 'too large' END AS reason, count(*) AS n FROM documents WHERE lang = 'fr' OR n_chars > 2000 GROUP BY 1")
def a21(spark, d):
    skipped = filters.skip_reasons(read(spark, d, "documents"), F.col("lang") == "fr", 2000, "lang", "n_chars", unknown_most=10**9).where("reason is not null")
    return aggregates.counts_by(skipped, "reason")


@query(
    "j2_chunk_terms",
    "SELECT p_partkey, term FROM part, (VALUES ('STAN'), ('ECON'), ('M')) t(term) WHERE contains(p_type, term)",
)
def j2(spark, d):
    terms = spark.createDataFrame([("STAN",), ("ECON",), ("M",)], "word string")
    return joins.contains_any(read(spark, d, "part"), "p_type", terms, "word").select("p_partkey", "term")


@query(
    "x27_json_from_prose",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '{"id": ' || doc_id || ', "of": ["' || source || '}", {"k": null}]}' END AS found FROM documents""",
)
def x27(spark, d):
    """Documents whole, fenced, within prose, and one that is cut off; ``found`` is the JSON as it stands in the text."""
    body = "'{\"id\": ' || doc_id || ', \"of\": [\"' || source || '}\", {\"k\": null}]}'"
    prose = F.expr(f"case doc_id % 4 when 0 then '\n' || {body} || ' ' when 1 then 'So: ```json\n' || {body} || '\n``` and {{no}}' when 2 then 'It is ' || {body} || ' as said}}' else 'It is {{\"id\": ' || doc_id end")
    return read(spark, d, "documents").select("doc_id", values.json_from_prose(prose).alias("found"))


@query(
    "c7_defaults",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS names, s_suppkey % 4 = 0 AS flag, CASE WHEN s_suppkey % 3 <> 2 THEN s_nationkey END AS nation FROM supplier""",
)
def c7(spark, d):
    json = F.expr("""case s_suppkey % 3 when 0 then '{"names": ["' || s_name || '"], "flag": ' || string(s_suppkey % 4 = 0) || ', "nation": ' || s_nationkey || '}'
    when 1 then '{"names": null, ' || if(s_suppkey % 4 = 0, '"flag": true, ', '') || '"nation": ' || s_nationkey || '}' else if(s_suppkey % 4 = 0, '{"flag": true}', '{') end""")
    x = read(spark, d, "supplier").select("s_suppkey", values.with_defaults(json, "names array<string>, flag boolean, nation long").alias("x"))
    return x.select("s_suppkey", F.array_join("x.names", "|").alias("names"), "x.flag", F.col("x.nation").cast("int").alias("nation"))


@query(
    "x31_digest",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '  3: run(request, ' || o_custkey || ')' || chr(10) || '  5: token = ' || o_orderkey
    ELSE '  3: value = ' || o_custkey || chr(10) || '  5: other = ' || o_orderkey END AS digest FROM orders""",
)
def x31(spark, d):
    code = "'import request\n\n  ' || if(o_orderkey % 2 = 0, 'run(request, ' || o_custkey || ')', 'value = ' || o_custkey) || '\nx\n' || if(o_orderkey % 2 = 0, 'token = ', 'other = ') || o_orderkey || if(o_orderkey % 2 = 0, '\nplain = 100000', '\n# a remark of length')"
    return read(spark, d, "orders").select("o_orderkey", text.digest_lines(F.expr(code)).alias("digest"))


_FILES_OF_PULLS = "SELECT o_custkey AS pull, o_orderkey AS pos, CASE WHEN o_orderkey % 16 = 0 THEN 'tests/' ELSE 'src/' END || o_orderkey || '.py' AS path, o_orderkey % 3 AS additions FROM orders"


@query(
    "k17_test_gaps",
    f"""WITH f AS ({_FILES_OF_PULLS}), g AS (SELECT *, row_number() OVER (PARTITION BY pull ORDER BY pos) AS r, count(*) OVER (PARTITION BY pull) AS n FROM f WHERE additions > 0 AND NOT starts_with(path, 'tests/'))
    SELECT pull, 1 AS ordinal, max(n) || ' changed source file(s) and no changed test: ' || string_agg(path, ', ' ORDER BY r) AS statement FROM g
    WHERE r <= 5 AND pull NOT IN (SELECT pull FROM f WHERE starts_with(path, 'tests/')) GROUP BY pull
    UNION ALL SELECT DISTINCT pull, 2, 'No test refers to the changed modules.' FROM f WHERE pull % 5 <> 0""",
)
def k17(spark, d):
    files = read(spark, d, "orders").selectExpr("o_custkey as pull", "o_orderkey as at", "if(o_orderkey % 16 = 0, 'tests/', 'src/') || o_orderkey || '.py' as path", "o_orderkey % 3 as additions")
    return detect.gap_statements(files, files.where("pull % 5 = 0").select("pull"))


@query(
    "s8_advisories",
    """WITH p AS (SELECT DISTINCT 'pypi' AS ecosystem, 'p' || (s_suppkey % 10) AS name, s_suppkey % 13 AS v FROM supplier), a AS (SELECT n_nationkey AS k, 'p' || (n_nationkey % 10) AS name, n_regionkey AS lo, n_regionkey + 9 AS hi FROM nation)
    SELECT ecosystem, p.name, v || '.0' AS version, 'A-' || k AS id, 'of ' || k AS summary FROM p JOIN a ON a.name = p.name WHERE (v >= lo AND v < hi OR v = 12) AND k % 8 <> 0""",
)
def s8(spark, d):
    packages = read(spark, d, "supplier").selectExpr("'pypi' as ecosystem", "'p' || (s_suppkey % 10) as name", "(s_suppkey % 13) || '.0' as version").distinct()
    record = """'{"id": "A-' || n_nationkey || '", "summary": "of ' || n_nationkey || '", ' || if(n_nationkey % 8 = 0, '"withdrawn": "2024-01-01T00:00:00Z", ', '') || '"affected": [{"package": {"ecosystem": "pypi", "name": "p' || (n_nationkey % 10) ||
    '"}, "versions": ["12.0"], "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "' || n_regionkey || '.0"}, {"fixed": "' || (n_regionkey + 9) || '.0"}]}]}]}'"""
    known = readers.advisories(read(spark, d, "nation").select(F.expr(record).alias("json")), "json")
    ids = readers.advisory_ids(packages, known)
    return ids.join(readers.advisory_details(ids, known).select("id", "summary"), "id").select("ecosystem", "name", "version", "id", "summary")


_KEY = "a shared key"


def _pad(pad: int) -> str:
    return bytes(k ^ pad for k in _KEY.encode().ljust(64, b"\0")).hex()


@query(
    "s20_webhooks",
    f"""WITH x AS (SELECT s_suppkey, '{{"action": "deleted", "installation": {{"id": ' || s_suppkey || '}}}}' AS body FROM supplier)
    SELECT s_suppkey, 'sha256=' || sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(body)))) AS signature,
    CASE WHEN s_suppkey % 5 = 0 THEN 401 ELSE 200 END AS status, s_suppkey % 5 = 0 AS kept FROM x""",
)
def s20(spark, d):
    """Every fifth delivery carries a wrong signature, and its installation stays."""
    own = read(spark, d, "supplier").selectExpr("s_suppkey", "encode('{\"action\": \"deleted\", \"installation\": {\"id\": ' || s_suppkey || '}}', 'UTF-8') as body", "'installation' as event")
    signed = own.withColumn("right", readers.webhook_signature(F.col("body"), _KEY)).withColumn("signature", F.expr("if(s_suppkey % 5 = 0, reverse(right), right)"))
    events = readers.webhook_events(signed, _KEY)
    kept = readers.still_installed(own.select(F.col("s_suppkey").cast("string").alias("installation_id")), events).select(F.col("installation_id").cast("long").alias("k"), F.lit(True).alias("kept"))
    return events.join(kept, F.col("s_suppkey") == F.col("k"), "left").select("s_suppkey", F.col("right").alias("signature"), "status", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(
    "e18_documentation",
    """WITH c AS (SELECT 'src/part' || p_partkey || '.ts' AS path, p_partkey AS k FROM part), f AS (SELECT * FROM c ORDER BY path LIMIT 200), g AS (SELECT * FROM c ORDER BY path LIMIT 12), e AS (SELECT * FROM c ORDER BY path LIMIT 3)
    SELECT 2 AS position, 'architecture' AS section, '- `src`: ' || count(*) || ' files, ' || 10 * count(*) || ' lines' AS body FROM part
    UNION ALL SELECT 3, 'folder-structure', '- src/'
    UNION ALL SELECT 5, 'environment-variables', '- `PART_KEY` in ' || string_agg('`' || path || '`', ', ' ORDER BY path) FROM e
    UNION ALL SELECT 8, 'authorization', count(*) || ' of ' || count(*) || ' routes have a guard near them.' FROM part
    UNION ALL SELECT 9, 'api', string_agg('- GET `/parts/' || k || '/:id` at `' || path || ':8`, guarded', chr(10) ORDER BY path) FROM f
    UNION ALL SELECT 11, 'workflows', string_agg('- parts: GET `/parts/' || k || '/:id` at `' || path || ':8`', chr(10) ORDER BY path) FROM g""",
)
def e18(spark, d):
    from .flows import _code

    return docs.documentation(_code(spark, d)).where("position in (2, 3, 5, 8, 9, 11)").drop("title")
