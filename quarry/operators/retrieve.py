"""Retrieval: query understanding, three retrievers, fusion, context, citations."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import numeric as num
from quarry.functions import text
from quarry.functions.stems import porter
from quarry.operators.joins import hinted

#: Words that say nothing in a question, and what each topic's words stand for.
STOP = {"a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "find", "for", "from", "get", "has", "have", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "show", "tell", "that", "the", "there", "this", "to", "us", "was", "we", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your"}
EXPANSIONS: dict[str, list[str]] = {
    "auth": ["authentication", "login", "session", "token"], "authentication": ["auth", "login", "session", "jwt"], "authorization": ["permission", "role", "guard", "access"], "login": ["signin", "auth", "session"], "logout": ["signout", "session"],
    "password": ["hash", "bcrypt", "credential"], "user": ["account", "profile"], "permission": ["role", "access", "policy"], "database": ["db", "sql", "query", "repository"], "db": ["database", "sql"], "query": ["sql", "select", "find"],
    "api": ["route", "endpoint", "controller"], "endpoint": ["route", "handler", "controller"], "route": ["endpoint", "router", "handler"], "error": ["exception", "catch", "throw"], "exception": ["error", "throw", "catch"], "bug": ["error", "fix", "issue"],
    "slow": ["performance", "latency", "query", "loop"], "performance": ["slow", "cache", "latency"], "cache": ["redis", "memo", "ttl"], "payment": ["stripe", "checkout", "billing", "invoice"], "email": ["mail", "smtp", "notification"], "upload": ["file", "multipart", "storage"],
    "test": ["spec", "mock", "assert"], "config": ["settings", "env", "environment"], "env": ["environment", "config"], "deploy": ["docker", "ci", "build"], "queue": ["job", "worker", "task"], "job": ["queue", "worker", "cron"], "log": ["logger", "logging"], "validate": ["validation", "schema", "zod"], "order": ["cart", "checkout", "purchase"], "search": ["query", "index", "filter"], "webhook": ["callback", "event", "hook"], "middleware": ["interceptor", "guard", "handler"],
}
#: Tested in this order; the first that is found is the intent, with the roles that it prefers.
INTENTS: list[tuple[str, str, list[str]]] = [
    ("security", r"(?i)\b(?:secur\w*|vulnerab\w*|injection|xss|csrf|exploit\w*|secrets?|unsafe)\b", ["auth", "middleware", "route"]),
    ("bug", r"(?i)\b(?:bugs?|errors?|exceptions?|crash\w*|broken|fail(?:s|ing|ure)?|wrong)\b", ["service", "controller"]),
    ("performance", r"(?i)\b(?:slow\w*|performance|latency|optimi[sz]\w*|bottleneck\w*|n\+1)\b", ["repository", "service"]),
    ("test", r"(?i)\b(?:tests?|testing|specs?|coverage|mock\w*)\b", ["test"]),
    ("flow", r"(?i)\b(?:flow|sequence|lifecycle|end[- ]to[- ]end|happens when|trace)\b", ["route", "controller", "service"]),
    ("locate", r"(?i)\b(?:where|which file|locate|find|defined)\b", []),
    ("documentation", r"(?i)\b(?:document\w*|readme|docs?)\b", ["markup"]),
    ("explain", r"(?i)\b(?:explain|how does|what (?:is|does)|describe|why)\b", []),
]
ROLE_HINTS: list[tuple[str, str]] = [(r"(?i)\b(?:routes?|endpoints?|api)\b", "route"), (r"(?i)\b(?:auth\w*|login)\b", "auth"), (r"(?i)\b(?:components?|ui|page)\b", "component"), (r"(?i)\b(?:models?|schema|entity)\b", "model"), (r"(?i)\b(?:middleware)\b", "middleware"), (r"(?i)\b(?:config\w*|settings?)\b", "config")]


class Understood(NamedTuple):
    intent: str
    literals: list[str]
    terms: list[str]
    roles: list[str]


def understand(query: str) -> Understood:
    """Intent, literal words (quoted spans last), expansions and preferred roles of a question."""
    words = [t for t in re.split(r"[^A-Za-z0-9_$.]+", query) if len(t.strip(".")) >= 2]
    literals = list(dict.fromkeys(t.strip(".") for t in words if t.lower().strip(".") not in STOP))
    quoted = [q for pair in re.findall(r"`([^`]{2,60})`|\"([^\"]{2,60})\"|'([^']{2,60})'", query) for q in pair if q]
    literals = list(dict.fromkeys([*literals, *quoted]))[:20]
    terms: dict[str, None] = {}
    for w in literals:
        low = w.lower()
        parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", w)]
        for t in (low, *parts, *EXPANSIONS.get(low, [])):
            if len(t) > 1:
                terms.setdefault(t)
    intent, roles = next(((n, r) for n, p, r in INTENTS if re.search(p, query)), ("general", []))
    roles = list(dict.fromkeys([*roles, *(r for p, r in ROLE_HINTS if re.search(p, query))]))
    return Understood(intent, literals, list(terms)[:40], roles)


# -- retrievers --------------------------------------------------------------------------------------------------------


def dense(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank): the k chunks (id, embedding) nearest to each query (query_id, vector), exactly.

    A few queries go to every vector; more than 1,000 are answered, as exactly, over an index made for them.
    """
    if queries.limit(1001).count() > 1000:
        from quarry.operators.vectorindex import VectorIndex
        from quarry.sources.checkpoints import new_folder

        size = chunks.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]
        index = VectorIndex(chunks.sparkSession, new_folder(chunks.sparkSession), max(1, size))
        index.build(chunks, id_col, "embedding")
        return index.search_exactly(queries, k).withColumnRenamed("id", id_col)
    hit = chunks.where("embedding is not null").crossJoin(F.broadcast(queries)).select("query_id", id_col, num.cosine(F.col("embedding"), F.col("vector")).alias("score"))
    return best_of_each(hit, id_col, k)


def best_of_each(hits: DataFrame, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inverted_index(chunks: DataFrame, id_col: str, content: str) -> DataFrame:
    """(term, id, tf): how often each lower-case word of two characters or more is in each chunk."""
    words = F.filter(F.split(F.lower(content), "[^a-z0-9_]+"), lambda x: F.length(x) > 1)
    return chunks.select(id_col, F.explode(words).alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))


def keyword(index: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", stems: bool = False) -> DataFrame:
    """(query_id, id, score, rank) by words (R3): each of a query's first 12 words adds 1 + ln tf where a chunk has it.

    Our own score.  Words that no query has go before anything is counted: the optimiser takes the half join below the
    index's grouping, where the few words are broadcast.
    """
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower("query"), "[^a-z0-9_]+"), lambda x: F.length(x) > 1)), 1, 12)
    q = queries.select("query_id", F.explode(words).alias("term"))
    if stems:
        keys = [c for c in index.columns if c != "tf"]
        index = index.withColumn("term", porter(F.col("term"))).groupBy(*keys).agg(F.sum("tf").alias("tf"))
        q = q.withColumn("term", porter(F.col("term"))).distinct()
    asked = index.join(hinted(q.select("term").distinct()), "term", "left_semi")
    hit = asked.join(q, "term").groupBy("query_id", id_col).agg(F.sum(1 + F.log("tf")).alias("score"))
    return best_of_each(hit, id_col, k)


def symbol(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank) by trigrams of symbol and, weighted 0.7, path.

    Of a query's terms the first 10 over 2 characters count.  Chunks meet terms by shared trigrams, not each other all.
    """
    terms = F.slice(F.filter(F.transform(F.split("terms", "\\s+"), F.trim), lambda t: F.length(t) > 2), 1, 10)
    q = queries.select("query_id", F.explode(terms).alias("term")).distinct().withColumn("t", text.trigrams(F.col("term")))

    def similar(col: str) -> DataFrame:
        c = chunks.where(F.col(col).isNotNull()).select(id_col, text.trigrams(F.col(col)).alias("c"))
        n = c.select(id_col, F.size("c").alias("nc"), F.explode("c").alias("g"))
        m = q.select("query_id", "term", F.size("t").alias("nt"), F.explode("t").alias("g"))
        # the terms are what is broadcast: trigrams of many chunks look small to Spark, since they compress well
        return n.hint("merge").join(hinted(m), "g").groupBy("query_id", "term", id_col, "nc", "nt").agg(F.count(F.lit(1)).alias("s")).select("query_id", id_col, (F.col("s") / (F.col("nc") + F.col("nt") - F.col("s"))).alias("sim"))

    both = similar("symbol").withColumn("w", F.lit(1.0)).unionByName(similar("path").withColumn("w", F.lit(0.7)))
    hit = both.groupBy("query_id", id_col).agg(F.max(F.col("sim") * F.col("w")).alias("score")).where("score > 0.1")
    return best_of_each(hit, id_col, k)


def fuse(lists: dict[str, DataFrame], chunks: DataFrame, limit: int, roles: list[str], literals: list[str], about_tests: bool = False, id_col: str = "chunk_id", weights: dict[str, float] | None = None, prefix: str | None = None, language: str | None = None) -> DataFrame:
    """The best chunks by reciprocal ranks of several lists, then boosts.

    1.35 for a preferred role, 1.5 for a literal in path or symbol, 0.75 for tests (1.2 where the question is about
    tests), 1.15 for a chunk that several lists have.  Filters apply after the fusion.  Ties go by the lists' ranks in
    order, then by id.
    """
    weights = {"dense": 1.0, "keyword": 1.0, "symbol": 0.9} if weights is None else weights
    parts = [df.select("query_id", id_col, F.lit(n).alias("list"), "rank", F.lit(weights.get(n, 1.0)).alias("w")) for n, df in lists.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ranks = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank_{n}") for n in lists]
    merged = every.groupBy("query_id", id_col).agg(F.sum(F.col("w") / (60 + F.col("rank"))).alias("fused"), F.count_distinct("list").alias("found"), *ranks).join(chunks, id_col)
    if prefix:
        merged = merged.where(F.startswith("path", F.lit(prefix)))
    if language:
        merged = merged.where(F.col("language") == language)
    name = F.lower(F.concat_ws(" ", "path", F.coalesce("symbol", F.lit(""))))
    literal = F.lit(False)
    for x in literals:
        literal = literal | F.contains(name, F.lit(x.lower()))
    boost = (
        F.when(F.col("role").isin(roles) if roles else F.lit(False), 1.35).otherwise(1.0) * F.when(literal, 1.5).otherwise(1.0)
        * F.when(F.col("is_test"), 1.2 if about_tests else 0.75).otherwise(1.0) * F.when(F.col("found") > 1, 1.15).otherwise(1.0)
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *[F.col(f"rank_{n}").asc_nulls_last() for n in lists], id_col)
    return merged.withColumn("score", F.col("fused") * boost).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def isolated(build, empty: DataFrame) -> tuple[DataFrame, str | None]:
    """A retriever's plan, or an empty result and the error where it can't be built."""
    try:
        return build(), None
    except Exception as e:  # noqa: BLE001  one retriever's failure must not fail the others
        return empty, str(e)


def hybrid(chunks: DataFrame, query: str, vector: list[float] | None, limit: int = 10) -> DataFrame:
    """Retrieval of one question over chunks (chunk_id, path, symbol, language, role, is_test, content, embedding)."""
    spark, u, depth = chunks.sparkSession, understand(query), max(3 * limit, 40)
    empty = spark.createDataFrame([], "query_id int, chunk_id long, score double, rank int")
    q = spark.createDataFrame([(0, f"{query} {' '.join(u.terms)}", " ".join([*u.literals, *u.terms]))], "query_id int, query string, terms string")
    lists = {
        "dense": isolated(lambda: dense(chunks, spark.createDataFrame([(0, vector)], "query_id int, vector array<double>"), depth), empty)[0] if vector else empty,
        "keyword": isolated(lambda: keyword(inverted_index(chunks, "chunk_id", "content"), q, depth), empty)[0],
        "symbol": isolated(lambda: symbol(chunks, q, depth), empty)[0],
    }
    return fuse(lists, chunks, limit, u.roles, u.literals, u.intent == "test")


# -- context -----------------------------------------------------------------------------------------------------------


def context(hits: DataFrame, files: DataFrame, budget: int = 12_000) -> DataFrame:
    """(used, context): numbered, redacted excerpts of hits (path, start_line, end_line, score) in a token budget.

    Overlapping and adjacent excerpts of a file are merged and cut from the file anew (W6); the best go first, and one
    that doesn't fit is skipped (W13).
    """
    from .windows import first_fit

    w = Window.partitionBy("path").orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("_new", F.when(before.isNull() | (F.col("start_line") > before + 1), 1).otherwise(0))
    marked = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("path", "_g").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"))
    cut = merged.join(files.select("path", "content"), "path").withColumn("body", text.slice_lines(F.col("content"), F.col("start_line"), F.col("end_line")))

    @F.pandas_udf("string")
    def redacted(s):
        from quarry.operators.detect import redact

        return s.map(lambda x: redact(x)[0], na_action="ignore")

    block = F.concat(F.lit("### "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"), text.number_lines(redacted("body"), F.col("start_line")))
    items = cut.withColumn("block", block).withColumn("cost", text.estimate_tokens(F.col("block"))).withColumn("one", F.lit(0))
    order = F.struct((-F.col("score")).alias("s"), F.col("path"), F.col("start_line"))
    return first_fit(items.select("one", "block", "cost", order.alias("o")), "one", F.col("o"), "cost", "block", budget).select("used", F.array_join("taken", "\n\n").alias("context"))


def validate_citations(cites: DataFrame, files: DataFrame) -> DataFrame:
    """Citations (cite_id, path, first, last) with verdict, file and lines cut to the file's.

    A line outside the file spoils a citation; an end beyond it is cut.
    """
    from .joins import unique_suffix

    found = unique_suffix(cites, "path", files, "path").join(files.select(F.col("path").alias("file"), "line_count"), "file", "left")
    outside = F.col("first").isNotNull() & ((F.col("first") < 1) | (F.col("first") > F.col("line_count")))
    return found.withColumn("valid", F.col("file").isNotNull() & ~F.coalesce(outside, F.lit(False))).withColumn("last", F.least("last", "line_count"))


def grounding(validated: DataFrame) -> DataFrame:
    """One row: valid citations over all, 0 without any."""
    return validated.agg(F.coalesce(F.count_if("valid") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("score"))


def extractive_answer(hits: DataFrame, most: int = 5) -> DataFrame:
    """(answer): what was found, by file in order of the best place."""
    by = hits.groupBy("path").agg(F.min("place").alias("place"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  - lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.coalesce(F.concat(F.lit(" "), F.col("symbol")), F.lit(""))))), "\n").alias("lines"))
    top = by.orderBy("place", "path").limit(most)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("path", F.lit("\n"), "lines").alias("t")))), lambda x: x["t"]), "\n").alias("answer"))


def chat_turn(spark: SparkSession, session: str, question: str, answer: str, at) -> DataFrame:
    """The two message rows of a turn."""
    return spark.createDataFrame([(session, "user", question, at), (session, "assistant", answer, at)], "sessionId string, role string, content string, createdAt timestamp")
