"""Which sides of joins are broadcast or moved, on plans of small tables."""

from itertools import product

from pyspark.sql import functions as F

from quarry.operators import detect, graph, joins, retrieve
from quarry.operators.textindex import TextIndex, words
from quarry.operators.trigramindex import LiteralIndex, character_trigrams


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_symbol_search_broadcasts_the_terms(spark):
    chunks = spark.createDataFrame([(1, "steel pipe", "brushed tin"), (2, "copper", None)], "chunk_id long, symbol string, path string")
    found = retrieve.symbol(chunks, spark.createDataFrame([(0, "steel brushed ab")], "query_id int, terms string"), 5)
    assert "SortMergeJoin" not in plan(found) and plan(found).count("BroadcastHashJoin") == 2 and "BuildLeft" not in plan(found)
    assert [(r["chunk_id"], r["rank"]) for r in found.collect()] == [(1, 1)]


def test_imports_meet_files_by_stems_as_by_all_candidates(spark):
    parts = ["", ".", "..", "a", "b.ts", "index", "index.ts"]
    specs = ["", ".", "..", "./", "../..", "./b", "../b.ts", "@/", "@/a", "/a", "/", "src/a/", "a..b", "a.b", "react", "./.ts", "./index", "../../../b/", None]
    imports = spark.createDataFrame([(f, s) for f in ["x.ts", "a/x.ts", "/a/x.ts", "a/b/../x.ts", "./x.ts", None] for s in specs], "path string, specifier string")
    names = {"/".join(p) for n in (1, 2, 3) for p in product(parts, repeat=n)}
    names |= {f"{x}{t}" for x in list(names) for t in (".ts", ".json", "/index.js", "/__init__.py", "/.py")}
    files = spark.createDataFrame([(f,) for f in sorted(names)], "path string")
    keyed = imports.withColumn("k", F.monotonically_increasing_id())
    plain = joins.first_candidate(keyed, "k", graph.import_candidates(F.col("path"), F.col("specifier")), files, "path", "path")
    expected = {(r["path"], r["specifier"]): r["target"] for r in plain.collect()}
    # each file alone too, so that candidates of every place count
    some = spark.createDataFrame([(f,) for f in sorted(names) if len(f) % 3 == 0], "path string")
    fewer = joins.first_candidate(keyed, "k", graph.import_candidates(F.col("path"), F.col("specifier")), some, "path", "path")
    got, less = graph.resolve_imports(imports, files), graph.resolve_imports(imports, some)
    assert {(r["path"], r["specifier"]): r["to_path"] for r in got.collect()} == expected
    assert {(r["path"], r["specifier"]): r["to_path"] for r in less.collect()} == {(r["path"], r["specifier"]): r["target"] for r in fewer.collect()}
    assert sum(x is not None for x in expected.values()) > 30


def test_imports_and_files_of_any_number_are_joined_by_sort_and_merge(spark):
    # tables of a size that Spark knows, and takes for small
    files = spark.range(3).selectExpr("concat('src/', id, '.ts') as path")
    imports = spark.range(2).selectExpr("concat('src/', id, '.ts') as path", "concat('./', id + 1) as specifier")
    edges = graph.resolve_imports(imports, files)
    assert "BroadcastHashJoin" not in plan(edges)
    assert sorted(r["to_path"] for r in edges.collect()) == ["src/1.ts", "src/2.ts"]


def test_files_in_use_are_not_broadcast(spark):
    files = spark.range(3).selectExpr("concat('src/', id, '.ts') as path", "false as is_test", "false as is_config", "false as is_generated")
    dead = detect.dead_files(files, spark.range(2).selectExpr("concat('src/', id, '.ts') as to_path"))
    assert "BroadcastHashJoin" not in plan(dead)
    assert [r["path"] for r in dead.collect()] == ["src/2.ts"]


def test_files_made_of_small_rows_go_to_several_tasks_a_core(spark, tmp_path):
    from quarry.plans.flows import _code

    spark.range(5).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert _code(spark, str(tmp_path)).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_indexed_texts_are_split_once_where_they_are_read(spark, tmp_path):
    texts = ["a\U0001f600bc", "\u0130stanbul KELVIN \u212a x2 \u03a3\u0391\u03a3", "\u00df aa\nab\r\0cd aa", "", "ab", "Z9_ q \u00c0B_9 z9_"]
    docs = spark.createDataFrame([(i, b"", x) for i, x in enumerate(texts)], "doc long, digest binary, text string")
    for kind, units in ((TextIndex, words), (LiteralIndex, character_trigrams)):
        counted = kind(spark, f"{tmp_path}/{kind.__name__}")._counted(docs)
        assert plan(counted).count("MapInArrow") == 1 and "Exchange" not in plan(counted)
        expected = {r["doc"]: sorted(r["u"]) for r in docs.select("doc", units(F.col("text")).alias("u")).collect()}
        got = {r["doc"]: (r["len"], sorted(w for w, n in zip(r["words"], r["counts"], strict=True) for _ in range(n))) for r in counted.collect()}
        assert got == {k: (len(v), v) for k, v in expected.items()}


def test_shared_pairs_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 20)
    items = spark.range(30).selectExpr("id as k", "explode(array(0, 1, if(id % 2 = 0, 2, null), if(id = 3, 4, 3))) as i").union(spark.sql("select null, 1")).union(spark.sql("select 1L, 0"))
    got = joins.shared_count_pairs(items, "k", "i", 3, 2, 30)
    have = {k: {0, 1, 4 if k == 3 else 3} | ({2} if k % 2 == 0 else set()) for k in range(30)}
    expected = {(a, b, len(have[a] & have[b])) for a in have for b in have if a < b and len(have[a] & have[b]) >= 3}
    assert {tuple(r) for r in got.collect()} == expected
    # 1,381 pairs; without their number the exchange has the session's eight tasks
    assert got.rdd.getNumPartitions() >= 60


def test_near_duplicates_ask_for_the_tokens_once_a_reading(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(joins, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    units = spark.createDataFrame([("u", "a.ts", 1, "a b c\n" * 20)], "unit_id string, path string, start_line int, content string")
    detect.near_duplicate_units(units)
    # the lists' members and their counts, over one exchange; filters don't ask again
    assert [p.count("regexp_extract_all(") for p in plans] == [2]


def test_documentation_parses_all_files_once_for_its_sections(spark, monkeypatch):
    from quarry.operators import docs, extract

    files = spark.createDataFrame([("src/a.ts", "typescript", "router.get('/x', requireAuth, f);"), ("package.json", "json", '{"dependencies": {"express": "1"}}')], "path string, language string, content string")
    written = []
    monkeypatch.setattr(docs, "cut", lambda df: written.append(df.columns) or spark.createDataFrame(df.collect(), df.schema))
    out = docs.documentation(files)
    assert ["file_path", "method", "path", "framework", "line", "has_auth"] in written and "MapInArrow" not in plan(out)
    assert "express in package.json" in {r["section"]: r["body"] for r in out.collect()}["overview"]
    # the manifests' pattern finds all that their readers read
    named = ["a/package.json", "Makefile", "requirements-dev.txt", "go.mod", "Gemfile", "Cargo.toml", "x/pom.xml", "build.gradle.kts", "composer.json", "pyproject.toml", ".nvmrc", ".node-version", ".python-version", ".ruby-version", "rust-toolchain.toml"]
    paths = spark.createDataFrame([(p,) for p in [*named, "a.ts", "xpackage.json"]], "path string")
    assert [r["path"] for r in paths.where(F.col("path").rlike(extract.MANIFESTS)).collect()] == named


def test_unprotected_routes_parse_the_files_once(spark):
    from quarry.operators import extract

    files = spark.createDataFrame([("a.ts", "typescript", "router.get('/x', requireAuth, f);\n"), ("b.ts", "typescript", "router.get('/y', f);\n")], "path string, language string, content string")
    out = detect.unprotected_routes(extract.routes(files))
    assert "MapInArrow" not in plan(out) and [r["path"] for r in out.collect()] == ["/y"]
