"""Detectors over files that differ from row to row, made of the given tables, so that their SQL has rows to compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import detect, filters, sets
from quarry.operators.aggregates import counts_by

from .catalog import ORACLES, query, read
from .filtering import k3


def _files(df, path, content, language="typescript"):
    return df.select(path.alias("path"), F.lit(language).alias("language"), content.alias("content"), F.lit(False).alias("is_test"), F.lit(False).alias("is_generated"))


def _path(column, ending=".ts"):
    return F.concat(F.lit("src/"), F.col(column).cast("string"), F.lit(ending))


def _lines_of_orders(spark, d, line, ending=".ts", language="typescript"):
    """A file for each order, a line for each of its items."""
    rows = read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", line.alias("code")).alias("x"))
    whole = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return _files(whole, _path("l_orderkey", ending), F.array_join(F.col("x.code"), "\n"), language)




@query(
    "k9_secrets_varied",
    """SELECT 'src/' || o_orderkey || '.ts' AS file_path, CASE o_orderkey % 5 WHEN 0 THEN 'secret.aws-access-key' WHEN 1 THEN 'secret.github-token' ELSE 'secret.stripe-key' END AS rule_id, CAST(2 + o_custkey % 3 AS INTEGER) AS start_line FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)""",
)
def k9_varied(spark, d):
    """A cloud key, a token, a placeholder, a payment key or none in each file, on a line that differs."""
    o, name = read(spark, d, "orders"), F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256))
    secret = F.element_at(F.array(
        F.concat(F.lit("k = 'AKIA"), F.substring(name, 1, 16), F.lit("'")), F.concat(F.lit("k = 'ghp_"), F.substring(name, 1, 36), F.lit("'")), F.lit("password = 'placeholder-1234'"),
        F.concat(F.lit("k = 'sk_live_"), F.substring(name, 1, 20), F.lit("'")), F.lit("k = 1"),
    ), F.pmod("o_orderkey", F.lit(5)).cast("int") + 1)
    content = F.concat(F.lit("a = 1\n"), F.repeat(F.lit("b = 2\n"), F.pmod("o_custkey", F.lit(3)).cast("int")), secret, F.lit("\nc = 3\n"))
    return detect.secret_findings(_files(o, _path("o_orderkey"), content)).select("file_path", "rule_id", "start_line")


@query(
    "k20_fingerprints_varied",
    f"""WITH f AS ({ORACLES["k3_n_plus_one"]}) SELECT file_path, start_line, sha256('perf.n-plus-one|' || file_path || '|await db.query(|' || row_number() OVER (PARTITION BY file_path ORDER BY start_line)) AS fingerprint FROM f""",
)
def k20_varied(spark, d):
    found = k3(spark, d).withColumns({"rule_id": F.lit("perf.n-plus-one"), "type": F.lit("n-plus-one"), "ordinal": F.col("start_line").cast("long")})
    return detect.fingerprint(found).select("file_path", "start_line", "fingerprint")


@query(
    "k4_unused_imports_varied",
    """SELECT 'src/' || l_orderkey || '.ts' AS file_path, 'n' || l_linenumber AS title, 1 AS start_line FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) FILTER (l_returnflag = 'R') = 0""",
)
def k4_varied(spark, d):
    """Each file imports a name for each item and uses those of returned ones."""
    name = F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))
    used = F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("use("), name, F.lit(");"))))), "\n")
    whole = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("import { "), F.array_join(F.array_sort(F.collect_set(name)), ", "), F.lit(" } from 'x';\n"), used).alias("content"))
    return detect.unused_imports(_files(whole, _path("l_orderkey"), F.col("content"))).select("file_path", "title", "start_line")


@query(
    "k5_unreachable_varied",
    """WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'return 1' WHEN 'A' THEN 'x = 2' ELSE '}' END AS code FROM lineitem),
    n AS (SELECT *, row_number() OVER w AS line, lag(code) OVER w AS before FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, code))
    SELECT 'src/' || l_orderkey || '.js' AS file_path, CAST(line AS INTEGER) AS start_line FROM n WHERE before = 'return 1' AND code <> '}' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY line) <= 10""",
)
def k5_varied(spark, d):
    """Files whose lines return, go on or close a block, as their items' flags say."""
    code = F.when(F.col("l_returnflag") == "R", "return 1").when(F.col("l_returnflag") == "A", "x = 2").otherwise("}")
    return detect.unreachable_lines(_lines_of_orders(spark, d, code, ".js", "javascript")).select("file_path", "start_line")


@query(
    "k6_open_routes",
    f"""WITH r AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path, page_id % 3 = 0 AS has_auth FROM pages)
    SELECT 'src/' || page_id || '.ts' AS file_path, path FROM r WHERE NOT has_auth AND NOT regexp_matches(path, '{detect.PUBLIC}') ORDER BY 1 LIMIT 40""",
)
def k6_varied(spark, d):
    """The paths of all pages as routes, every third behind authentication; the first 40 that are open, as the SQL has it."""
    r = read(spark, d, "pages").select(_path("page_id").alias("file_path"), F.lit(1).alias("line"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"), (F.pmod("page_id", F.lit(3)) == 0).alias("has_auth"))
    return detect.unprotected_routes(r).limit(40).select("file_path", "path")


@query(
    "k8_dead_files_varied",
    """SELECT 'src/p' || p_partkey || '.ts' AS path FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) ORDER BY 1 LIMIT 30""",
)
def k8_varied(spark, d):
    """A file for each part, imported where large items have it; the first 30 that aren't, as the SQL has it."""
    path = lambda c: F.concat(F.lit("src/p"), F.col(c).cast("string"), F.lit(".ts"))
    files = _files(read(spark, d, "part"), path("p_partkey"), F.lit("")).withColumn("is_config", F.lit(False))
    return detect.dead_files(files, read(spark, d, "lineitem").where("l_quantity > 48").select(path("l_partkey").alias("to_path"))).limit(30).select("path")


_MARKED = "CASE doc_id % 4 WHEN 0 THEN '// @generated by a tool' WHEN 1 THEN '# Do not edit' WHEN 2 THEN 'plain' ELSE '' END || chr(10) || text"


@query("f9_generated_varied", f"SELECT doc_id FROM (SELECT doc_id, lower(substr({_MARKED}, 1, 800)) AS h FROM documents) WHERE contains(h, '@generated') OR contains(h, 'do not edit') OR contains(h, 'auto-generated') OR contains(h, 'autogenerated') OR contains(h, 'generated by')")
def f9_varied(spark, d):
    """Every document behind a first line that says it is generated, or one that doesn't."""
    head = F.element_at(F.array(*[F.lit(x) for x in ("// @generated by a tool", "# Do not edit", "plain", "")]), F.pmod("doc_id", F.lit(4)).cast("int") + 1)
    return read(spark, d, "documents").where(filters.looks_generated(F.concat(head, F.lit("\n"), F.col("text")))).select("doc_id")


_COMMENTED = "CASE i % 4 WHEN 0 THEN '// ' WHEN 1 THEN '# ' WHEN 2 THEN '  * ' ELSE '' END || line"


@query(
    "f25_comment_lines_varied",
    rf"""WITH l AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'python' ELSE 'typescript' END AS language, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), m AS (SELECT language, trim({_COMMENTED}) AS t FROM l)
    SELECT language, count(*) AS n FROM m WHERE CASE language WHEN 'python' THEN starts_with(t, '#') ELSE regexp_matches(t, '^(//|/\*|\*|<!--)') END GROUP BY 1""",
)
def f25_varied(spark, d):
    """All lines behind the mark of a comment or none, in two languages."""
    docs = read(spark, d, "documents").withColumn("language", F.when(F.pmod("doc_id", F.lit(2)) == 0, "python").otherwise("typescript"))
    lines = docs.select("language", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    mark = F.element_at(F.array(*[F.lit(x) for x in ("// ", "# ", "  * ", "")]), F.pmod(F.col("at") + 1, F.lit(4)) + 1)
    return counts_by(lines.where(detect.comment_line(F.concat(mark, F.col("line")), F.col("language"))), "language")


@query("u4_removed_varied", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u4_varied(spark, d):
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.minus(read(spark, d, "customer").select("c_custkey"), urgent, "c_custkey")


@query("j13_anti_varied", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def j13_varied(spark, d):
    returned = read(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return sets.minus(read(spark, d, "part").select("p_partkey"), returned, "p_partkey")
