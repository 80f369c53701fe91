"""Joins that equality alone doesn't say: ordered candidates, suffixes, containment, ranges of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.checkpoints import cut


def hinted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_candidate(left: DataFrame, key: str, candidates: Column, right: DataFrame, match: str, take: str) -> DataFrame:
    """For each left row the first of its ordered candidates that the right side has; null where none."""
    tried = left.select(key, F.posexplode(candidates).alias("_at", "_c"))
    hit = tried.join(right.select(F.col(match).alias("_c"), F.col(take).alias("_t")), "_c").groupBy(key).agg(F.min_by("_t", F.struct("_at", "_t")).alias("target"))
    return left.join(hit, key, "left")


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path by segments, the whole first."""
    from quarry.functions.text import let

    tails = lambda seg: F.transform(F.sequence(F.lit(1), F.size(seg)), lambda i: F.array_join(F.slice(seg, i, F.size(seg) - i + 1), "/"))
    return let(F.split(path, "/"), tails)


def unique_suffix(cites: DataFrame, cite: str, files: DataFrame, path: str) -> DataFrame:
    """Each citation's file: the exact path, else the only file that ends with it; verdict says which or why not."""
    clean = F.regexp_replace(F.col(cite), "^(\\./|/)+", "")
    suffix = (
        files.select(F.col(path).alias("_p"), F.explode(path_suffixes(F.col(path))).alias("_s"))
        .groupBy("_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_one"), F.bool_or(F.col("_p") == F.col("_s")).alias("_exact"))
    )
    return (
        cites.withColumn("_clean", clean).join(suffix, F.col("_clean") == F.col("_s"), "left")
        .withColumn("verdict", F.when(F.col("_n").isNull(), "missing").when(F.col("_exact"), "exact").when(F.col("_n") == 1, "suffix").otherwise("ambiguous"))
        .withColumn("file", F.when(F.col("verdict") == "exact", F.col("_clean")).when(F.col("verdict") == "suffix", F.col("_one")))
        .drop("_clean", "_s", "_n", "_one", "_exact")
    )


#: Pairs that one task counts, about.
PAIRS = 500_000


def shared_count_pairs(items: DataFrame, key: str, item: str, least: int, least_df: int = 2, most_df: int | None = None, once: bool = False) -> DataFrame:
    """Pairs a < b of keys with the number of items they share; items in too few or too many keys are left out.

    ``once`` says that no row of ``items`` comes twice.  Rows are dealt by item once.  A list of n members makes n squared
    pairs however few bytes it has, so the pairs are counted first and dealt by their lesser key to as many tasks as they
    need: a member goes out with those after it as one row, which is taken apart where the pairs are counted.
    """
    dealt = items.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull()).repartition(item)
    uniq = dealt if once else dealt.distinct()
    df = uniq.groupBy(item).agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= max(2, least_df))
    if most_df is not None:
        df = df.where(F.col("_df") <= most_df)
    # lists may look small enough to be broadcast, as repeated values compress well
    lists = cut(uniq.hint("merge").join(df.select(item).hint("merge"), item).groupBy(item).agg(F.array_sort(F.collect_list(key)).alias("m")).select("m"))
    n = F.size("m").cast("long")
    pairs = lists.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS) + 1)
    after = F.transform("m", lambda x, i: F.struct(x.alias("a"), F.slice("m", i + 2, F.size("m")).alias("bs")))
    heads = lists.select(F.explode(after).alias("x")).select("x.a", "x.bs").where("size(bs) > 0").repartition(tasks, "a")
    return heads.select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def flag_if_in(left: DataFrame, key: str, right: DataFrame, other: str, flag: str) -> DataFrame:
    """Each left row with whether the right side has its key."""
    r = right.select(F.col(other).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return left.join(r, F.col(key) == F.col("_k"), "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def carry_forward(new: DataFrame, old: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """New rows with the flags that the old row of the same key had, else false."""
    prior = old.groupBy(key).agg(*[F.bool_or(f).alias(f) for f in flags])
    return new.drop(*flags).join(prior, key, "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def contains_any(docs: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(docs row, term) for each term that a text contains.  The terms must be few: they go to every task."""
    return docs.join(hinted(terms.select(F.col(term).alias("term"))), F.contains(F.col(text), F.col("term")))


def in_changed_paths(findings: DataFrame, path: str, changed: DataFrame, other: str) -> DataFrame:
    """Findings whose path is a changed one or ends with it after a slash (J17): by all suffixes, so that the join is on equality."""
    f = findings.withColumn("_id", F.xxhash64(*findings.columns)).withColumn("_s", F.explode(path_suffixes(F.col(path))))
    return f.join(changed.select(F.col(other).alias("_s")).distinct(), "_s", "left_semi").drop("_s", "_id").distinct()


def best_route(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Each call (call_id, verb, path) with the route (route_id, verb, path) that fits best.

    A route's segments stand against the end of the call's; each is equal but for case or a parameter, and at least one
    is literal.  Verbs agree if the route names the call's, of several one; else one is missing or the route takes any.  Score: 10 a literal, 1 a segment, 3 for
    agreeing verbs, 2 for equal length; ties go to the smaller route.  Calls meet routes by their last literal
    segment's text or by none, so that not every call meets every route.
    """
    seg = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    c = calls.select("call_id", F.upper("verb").alias("cv"), seg(F.lower(F.col("path"))).alias("cs"))
    r = routes.select("route_id", F.upper("verb").alias("rv"), seg(F.lower(F.col("path"))).alias("rs"))
    param = lambda s: s.startswith(":")
    r = r.withColumn("lits", F.filter("rs", lambda s: ~param(s))).where("size(lits) > 0").withColumn("key", F.element_at("lits", 1))
    keyed = c.withColumn("key", F.explode(F.array_distinct("cs")))
    pairs = keyed.join(r, "key").where("size(rs) <= size(cs)").drop("key")
    tail = F.slice("cs", F.size("cs") - F.size("rs") + 1, F.size("rs"))
    fits = F.forall(F.zip_with(tail, "rs", lambda a, b: (a == b) | b.startswith(":")), lambda x: x)
    agree = F.array_contains(F.split("rv", ","), F.col("cv"))  # a route may name several verbs
    free = F.col("cv").isNull() | F.col("rv").isNull() | F.col("rv").isin("ALL", "ANY")
    score = 10 * F.size("lits") + F.size("rs") + F.when(agree, 3).otherwise(0) + F.when(F.size("rs") == F.size("cs"), 2).otherwise(0)
    hit = pairs.where(fits & (F.coalesce(agree, F.lit(False)) | free)).withColumn("score", score)
    best = hit.groupBy("call_id").agg(F.min_by(F.struct("route_id", "score"), F.struct(-F.col("score"), F.col("route_id"))).alias("b"))
    return calls.join(best, "call_id", "left").select(*calls.columns, "b.route_id", "b.score")


def contained(inner: DataFrame, outer: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Rows of ``inner`` with those of ``outer`` of the same key that contain them, by columns first and last (both included).

    Ranges meet by bins of ``width``: an outer one stands in every bin that it reaches into, an inner one in that of its
    first place, so that the join is on equality and a pair comes once.  Other columns must have different names.
    """
    bins = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))
    o = outer.where("first <= last").withColumn("_bin", bins).withColumnsRenamed({"first": "outer_first", "last": "outer_last"})
    i = inner.withColumn("_bin", F.floor(F.col("first") / width))
    return i.join(o, [key, "_bin"]).where("outer_first <= first and last <= outer_last").drop("_bin")


def innermost(inner: DataFrame, outer: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Each row of ``inner`` with the smallest range of ``outer`` that contains it, of equal ones that which begins last; rows without one go."""
    named = inner.withColumn("_row", F.struct(*inner.columns))
    found = contained(named, outer, key, width)
    mine = [c for c in found.columns if c not in (*inner.columns, "_row")]
    best = F.min_by(F.struct(*mine), F.struct((F.col("outer_last") - F.col("outer_first")).alias("size"), (-F.col("outer_first")).alias("late"), *[c for c in mine if not c.startswith("outer_")]))
    return found.groupBy("_row").agg(best.alias("_best")).select("_row.*", "_best.*")


def affected_versions(advisories: DataFrame) -> DataFrame:
    """(id, ecosystem, name, introduced, fixed) rows of nested advisories."""
    return (
        advisories.select("id", F.explode("affected").alias("a")).select("id", "a.package.ecosystem", "a.package.name", F.explode("a.ranges").alias("r"))
        .select("id", "ecosystem", "name", F.explode("r.events").alias("e"))
        .select("id", "ecosystem", "name", "e.introduced", "e.fixed").distinct()
    )


def lookup_children(edges: DataFrame, targets: DataFrame, children: DataFrame, src: str, dst: str, per_src: int, per_target: int) -> DataFrame:
    """For each source its first targets and of each its first children, in one join instead of a look-up a row."""
    e = edges.select(src, dst).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(src).orderBy(dst))).where(F.col("_r") <= per_src).drop("_r")
    kids = children.withColumn("_r", F.row_number().over(Window.partitionBy(dst).orderBy("name"))).where(F.col("_r") <= per_target).drop("_r")
    return e.join(targets, dst).join(kids, dst)


def signature_matches(rules: DataFrame, facts: dict[str, DataFrame], most: int = 4) -> DataFrame:
    """Rules (rule, kind, value) that facts support, with up to ``most`` of them.

    facts: by kind a table (value, evidence).  Kind "name" matches equal values, "prefix" values that begin with the rule's,
    "suffix" those that end with it, "pattern" those that its expression finds.
    """
    on = {
        "name": lambda: F.col("f.value") == F.col("r.value"), "prefix": lambda: F.startswith(F.col("f.value"), F.col("r.value")),
        "suffix": lambda: F.endswith(F.col("f.value"), F.col("r.value")), "pattern": lambda: F.expr("f.value rlike r.value"),
    }
    parts = []
    for kind, table in facts.items():
        r = hinted(rules.where(F.col("kind") == kind)).alias("r")
        parts.append(table.alias("f").join(r, on[kind]()).select("r.rule", F.col("f.evidence").alias("evidence")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    order = Window.partitionBy("rule").orderBy("evidence")
    return whole.distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).groupBy("rule").agg(F.array_sort(F.collect_list("evidence")).alias("evidence"))
