"""Scalar functions on small examples."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import numeric as num
from quarry.functions import paths, text, values


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column).first()[0]


@pytest.mark.parametrize("given, want", [("getHTTPUserById", ["get", "http", "user", "by", "id"]), ("snake_case_name", ["snake", "case", "name"]), ("", []), ("A", ["a"])])
def test_split_identifier(spark, given, want):
    assert one(spark, text.split_identifier(F.col("x")), x=given) == want


def test_lexical_tokens_keep_words_and_parts(spark):
    assert one(spark, text.lexical_tokens(F.col("x")), x="parseUrl a x1") == ["parseurl", "parse", "url", "x1"]


@pytest.mark.parametrize("given, want", [("", 0), ("a", 1), ("a\n", 2), ("a\n\nb", 3)])
def test_count_lines(spark, given, want):
    assert one(spark, text.count_lines(F.col("x")), x=given) == want


@pytest.mark.parametrize("a, b, want", [(1, 2, "a\nb"), (0, 1, "a"), (3, 9, "c"), (9, 12, "")])
def test_slice_lines(spark, a, b, want):
    assert one(spark, text.slice_lines(F.col("x"), a, b), x="a\nb\nc") == want


def test_fnv1a_is_the_published_value(spark):
    assert one(spark, text.fnv1a(F.col("x")), x="abc") == 0x1A47E90B


def test_trigrams_of_two_words(spark):
    assert len(one(spark, text.trigrams(F.col("x")), x="Foo bar")) == 8


def test_trigram_similarity_bounds(spark):
    a = text.trigrams(F.col("x"))
    assert one(spark, text.trigram_similarity(a, a), x="same") == 1.0
    assert one(spark, text.trigram_similarity(text.trigrams(F.lit("")), text.trigrams(F.lit(""))), x="") == 0.0


def test_entropy(spark):
    assert one(spark, text.entropy(F.col("x")), x="aabb") == pytest.approx(1.0)
    assert one(spark, text.entropy(F.col("x")), x="") == 0.0


def test_normalise_code_ignores_comments_and_literals(spark):
    a = one(spark, text.normalise_code(F.col("x")), x="let a = 1; // one\nlet s = 'x';")
    b = one(spark, text.normalise_code(F.col("x")), x="let a = 22;\n/* two */ let s = \"yy\";")
    assert a == b


def test_citations(spark):
    got = one(spark, text.citations(F.col("x")), x="see src/auth/AuthService.ts:42 and lib/a.py:10-45, version 1.2.3, e.g. this; main.go(7)")
    assert [(r["path"], r["first"], r["last"]) for r in got] == [("src/auth/AuthService.ts", 42, None), ("lib/a.py", 10, 45), ("main.go", 7, None)]


@pytest.mark.parametrize("given, want", [("https://x.y/a/b?q#h", "/a/b"), ("${BASE}/users/${id}/", "/users/:param"), ("//a//b", "/a/b"), ("", "/")])
def test_call_path(spark, given, want):
    assert one(spark, paths.call_path(F.col("x")), x=given) == want


@pytest.mark.parametrize("given", ["/users/{id}", "/users/<int:id>", "/users/:id", "/users/*"])
def test_route_path(spark, given):
    assert one(spark, paths.route_path(F.col("x")), x=given) == "/users/:param"


@pytest.mark.parametrize("given, want", [("/api/v1/users/:id", "users"), ("/api/:id", "root"), ("/orders", "orders")])
def test_route_group(spark, given, want):
    assert one(spark, paths.route_group(F.col("x")), x=given) == want


@pytest.mark.parametrize("given, want", [("a/../b/./c", "b/c"), ("../a", "../a"), ("/../a", "/a"), ("a/..", "."), ("a//b/", "a/b")])
def test_normalise_path(spark, given, want):
    assert one(spark, paths.normalise(F.col("x")), x=given) == want


@pytest.mark.parametrize("given, want", [("a/b", True), ("../a", False), ("/etc/passwd", False), ("a/../../b", False), ("a/../b", True)])
def test_stays_inside(spark, given, want):
    from quarry.sources.readers import within_root

    assert one(spark, paths.stays_inside(F.col("x")), x=given) is want
    assert within_root(given) is want


@pytest.mark.parametrize("x, want", [(2.5, 3), (-2.5, -2), (1.4, 1)])
def test_half_up(spark, x, want):
    assert one(spark, num.half_up(F.col("x")), x=x) == want


def test_cosine_and_unit(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, num.cosine(v(1, 0), v(1, 0, 9))) == pytest.approx(1.0)
    assert one(spark, num.cosine(v(0, 0), v(1, 1))) == 0.0
    assert one(spark, num.fit_unit(v(3, 4), 3)) == pytest.approx([0.6, 0.8, 0.0])
    assert one(spark, num.fit_unit(v(0, 0), 2)) == [0.0, 0.0]


@pytest.mark.parametrize(
    "vector, want",
    [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 7.8), ("CVSS:3.0/AV:N/AC:H/PR:N/UI:R/S:U/C:H/I:N/A:N", 5.3), ("nonsense", None)],
)
def test_cvss(spark, vector, want):
    assert one(spark, num.cvss31(F.col("x")), x=vector) == want


def test_default_ignores_take_secrets_but_not_their_templates(spark):
    from pyspark.sql import functions as F

    from quarry.operators import filters
    from quarry.rules.names import IGNORED

    paths = {".env": True, "app/.env.production": True, "a/key.p12": True, "b.pfx": True, "id_rsa": True, "x/id_rsa.pub": True, "c.pem": True, ".env.example": False, "app/.env.template": False, "prod.env.sample": False, "src/a.ts": False, "node_modules/x.js": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["i"] for r in df.select("path", filters.is_ignored(F.col("path"), IGNORED).alias("i")).collect()} == paths


@pytest.mark.parametrize(
    "given, want",
    [
        (None, None), ("", None), (" [1, 2]\n", "[1, 2]"), ("7", "7"), ("NaN", None), ("a ```\n{\"a\": 1}\n``` b", '{"a": 1}'), ("```json\n{oops\n``` [3]", None),
        ('so {"a": "}\\" ]"} and {"b": 2}', '{"a": "}\\" ]"}'), ("x [1, {}] y", "[1, {}]"), ("x {a} {\"b\": 1}", None), ("{" * 3, None), ("[" * 50_000, None), ("``` [1]", "[1]"),
    ],
)
def test_json_from_prose(spark, given, want):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(values.json_from_prose("x")).first()[0] == want


def test_defaults_of_a_profile(spark):
    df = spark.createDataFrame([(None,), ("{",), ('{"a": "x", "b": true, "c": "s"}',), ('{"a": ["x", null]}',)], "j string")
    got = [tuple(r[0]) for r in df.select(values.with_defaults(F.col("j"), "a array<string>, b boolean, c string")).collect()]
    assert got == [([], False, None), ([], False, None), ([], True, "s"), (["x", None], False, None)]


def test_digest_lines(spark):
    code = "\n".join(["import secret", "a = 1"] + [f"x{i} = request.get({i})" for i in range(12)])
    got = one(spark, text.digest_lines(F.col("x")), x=code).split("\n")
    assert got[0] == "  3: x0 = request.get(0)" and len(got) == 10
    assert one(spark, text.digest_lines(F.col("x")), x="// nothing here\nlong_name = 1\nab\n") == "  2: long_name = 1"
    assert one(spark, text.digest_lines(F.col("x")), x="") == ""
    assert len(one(spark, text.digest_lines(F.col("x")), x="token" * 100)) == 165


def test_embeddings_by_a_provider(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "x string").coalesce(1)
    embed = num.embedding_by(lambda texts: [(len(t), 1) for t in texts], 2)
    assert [r[0] for r in df.select(embed("x")).collect()] == [[2.0, 1.0], None, [0.0, 1.0]]
    with pytest.raises(Exception, match="other than"):
        df.select(num.embedding_by(lambda texts: [], 2)("x")).collect()
