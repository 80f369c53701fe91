"""A stored inverted index over texts: written once, kept up by what changed, searched by reading a query's terms only.

Below the index's folder, all Parquet:

* ``postings/gen=/bucket=``: (term, block, doc, tf, len), a term's bucket being its hash; sorted by term and block
* ``bounds/gen=/bucket=``: (term, block, docs, max_tf, min_len), what a block of documents can add to a score at most
* ``documents/gen=``: (doc, digest, len) of the texts that a generation brought
* ``dead/gen=``: (doc, was), the texts of earlier generations that it replaced or removed
* ``commits``: a row for each generation, written last; what isn't in it is not read

A refresh compares digests and writes a new generation of the texts that changed, whatever the size of the rest.  A block is
a hash class of documents.  A search sums the bounds of a query's terms by block, scores the blocks with the highest ones,
and then only those whose bound reaches the k-th best score so far.  Bounds of many terms spare nothing, so questions that
are texts themselves are scored together, in one pass over the postings of all their terms by document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.stems import porter, stem
from quarry.operators.joins import hinted
from quarry.sources.checkpoints import cut

BUCKETS, BLOCKS = 64, 256
#: Blocks of a query that are scored before there is a k-th best score to hold the others against.
FIRST_BLOCKS = 8
#: Scores are whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000

#: From so many terms a query on average queries are scored together, if all have at most so many terms.
LONG, TOGETHER = 8, 250_000
#: Numbers in an array of scores at a time, in a task that scores queries together.
CELLS = 2_000_000

_WORD = re.compile("[a-z0-9_]{2,}")

COMMIT = "gen int, base int, buckets int, blocks int, docs long, words long, removed long"


def words(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: F.length(x) > 1)


def weight(tf: Column, length: Column, by_length: bool) -> Column:
    """What a term adds to a text's score: 1 + ln tf, by the text's length over 1 + ln length."""
    w = 1 + F.log(tf)
    return F.round((w / (1 + F.log(length)) if by_length else w) * UNIT).cast("long")


def _bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def stemmed(counts: dict[str, int]) -> dict[str, int]:
    """Counts of words as counts of their stems."""
    out: dict[str, int] = {}
    for word, n in counts.items():
        term = stem(word)
        out[term] = out.get(term, 0) + n
    return out


def best_together(postings: Iterator[tuple], starts: np.ndarray, of: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, doc, points) of the k best of each query among postings (docs, terms, weights) in order of docs.

    Term t is asked by the queries ``of[starts[t]:starts[t + 1]]``.  Of equal points the doc that comes first stays.
    """
    best_q, best_doc, best_points = np.zeros(0, np.int64), None, np.zeros(0, np.int64)
    floor = np.zeros(queries, np.int64)  # points of a query's k-th best so far; no posting weighs less than 1
    asks = np.diff(starts)

    def add(docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Whole documents."""
        nonlocal best_q, best_doc, best_points
        new = np.ones(len(docs), bool)
        new[1:] = docs[1:] != docs[:-1]
        number, own = np.cumsum(new) - 1, docs[new]
        n = asks[terms]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell = np.repeat(number * queries, n) + of[np.repeat(starts[terms], n) + inside]
        # sums of whole numbers far below 2 ** 53 are exact
        scores = np.bincount(cell, np.repeat(weights, n), len(own) * queries).astype(np.int64).reshape(len(own), queries)
        d, q = np.nonzero(scores > floor)
        if not len(d):
            return
        q_, points, doc = np.concatenate([best_q, q]), np.concatenate([best_points, scores[d, q]]), own[d] if best_doc is None else np.concatenate([best_doc, own[d]])
        order = np.lexsort((-points, q_))  # stable: what came first stays first
        q_ = q_[order]
        first = np.searchsorted(q_, np.arange(queries))
        rank = np.arange(len(q_)) - first[q_]
        kept = rank < k
        best_q, best_doc, best_points = q_[kept], doc[order][kept], points[order][kept]
        last = rank[kept] == k - 1
        floor[best_q[last]] = best_points[last]

    held: list[tuple] = []

    def flush(end: bool) -> None:
        docs, terms, weights = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        cuts = np.flatnonzero(docs[1:] != docs[:-1]) + 1  # where documents begin
        ends = [*cuts, len(docs)] if end else [*cuts]  # the last one may go on
        asked, begun = np.concatenate([[0], np.cumsum(asks[terms])]), 0
        i = 0
        while i < len(ends):
            # as many documents as their scores and what is added to them have room for, one at least
            j = min(i + max(1, CELLS // queries), len(ends))
            j = max(i + 1, min(j, int(np.searchsorted(asked[ends[i:j]], asked[begun] + CELLS, "right")) + i))
            add(docs[begun : ends[j - 1]], terms[begun : ends[j - 1]], weights[begun : ends[j - 1]])
            begun, i = ends[j - 1], j
        if begun < len(docs):
            held.append((docs[begun:], terms[begun:], weights[begun:]))

    for batch in postings:
        if len(batch[0]):
            held.append(batch)
            if sum(len(x[0]) for x in held) >= 200_000:
                flush(False)
    if held:
        flush(True)
    return best_q, np.zeros(0, np.int64) if best_doc is None else best_doc, best_points


class TextIndex:
    """The index under a folder that all executors see.  Ids are unique in what is indexed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, blocks: int = BLOCKS):
        """``buckets`` and ``blocks`` count for a new index; one that is there has its own."""
        self.spark, self.path = spark, path.rstrip("/")
        done = self._commits()
        self.buckets, self.blocks = (done[-1]["buckets"], done[-1]["blocks"]) if done else (buckets, blocks)

    # -- what is stored ------------------------------------------------------------------------------------------------

    def _there(self, name: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(conf).exists(p)

    def _commits(self) -> list:
        """One row a generation, in order: as many as there were refreshes since the last compaction."""
        if not self._there("commits"):
            return []
        rows = sorted(self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect(), key=lambda r: r["gen"])
        return [r for r in rows if r["gen"] >= rows[-1]["base"]]

    def _read(self, name: str, schema: str) -> DataFrame:
        """The rows of the generations that count."""
        gens = [r["gen"] for r in self._commits()]
        if not gens or not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("gen").isin(gens))

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.path}/documents").schema["doc"].dataType.simpleString()

    def postings(self) -> DataFrame:
        return self._read("postings", f"term string, block int, doc {self._kind()}, tf int, len int, gen int, bucket int")

    def bounds(self) -> DataFrame:
        return self._read("bounds", "term string, block int, docs long, max_tf int, min_len int, gen int, bucket int")

    def dead(self) -> DataFrame:
        return self._read("dead", f"doc {self._kind()}, was int, gen int")

    def documents(self) -> DataFrame:
        """(doc, digest, len, gen) of the texts that are in the index now."""
        every = self._read("documents", f"doc {self._kind()}, digest binary, len int, gen int")
        return every.join(self.dead().select("doc", F.col("was").alias("gen")), ["doc", "gen"], "left_anti").select("doc", "digest", "len", "gen")

    # -- keeping it up -------------------------------------------------------------------------------------------------

    def _put(self, df: DataFrame, name: str, gen: int, *by: str) -> None:
        # a generation that a refresh broke off is written anew
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/gen={gen}")

    def _put_postings(self, postings: DataFrame, gen: int) -> None:
        """Postings by bucket and in order, a term of many documents over several files; and their bounds."""
        self._put(postings.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block"), "postings", gen, "bucket")
        own = self.spark.read.schema(postings.schema).parquet(f"{self.path}/postings/gen={gen}")
        bounds = own.groupBy("bucket", "term", "block").agg(F.count(F.lit(1)).alias("docs"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        self._put(bounds.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term", "block"), "bounds", gen, "bucket")

    def _commit(self, gen: int, base: int, docs: int, words_: int, removed: int) -> None:
        row = self.spark.createDataFrame([(gen, base, self.buckets, self.blocks, docs, words_, removed)], COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    @staticmethod
    def _count(text: str) -> dict[str, int]:
        """What a lower-case text is split into, as ``words`` does, and how often it comes."""
        return Counter(_WORD.findall(text))

    def _counted(self, texts: DataFrame, fold: Callable[[dict[str, int]], dict[str, int]] = lambda c: c) -> DataFrame:
        """(doc, digest, len, words, counts) of (doc, digest, text): each text is split once and counted where it is read.

        ``fold`` puts a text's words together, which leaves its length as it is.
        """
        count = self._count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    b = batch.slice(at, 256)
                    found = [count(x) for x in b.column(2).to_pylist()]
                    sums = pa.array([sum(c.values()) for c in found], pa.int32())
                    found = [fold(c) for c in found]
                    own = [sums, pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own], names=["doc", "digest", "len", "words", "counts"])

        kind = texts.schema["doc"].dataType.simpleString()
        return texts.select("doc", "digest", F.lower("text")).mapInArrow(run, f"doc {kind}, digest binary, len int, words array<string>, counts array<int>")

    def _terms(self, texts: DataFrame) -> DataFrame:
        """What is indexed of (doc, digest, text), as ``_counted`` gives it: stems, put together where the text is read."""
        return self._counted(texts, stemmed)

    def _split(self, texts: DataFrame) -> DataFrame:
        """(term, block, doc, tf, len, bucket) of counted texts, which moves nothing."""
        counted = texts.select("doc", "len", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("doc", "len", F.col("x.words").alias("term"), F.col("x.counts").alias("tf"))
        return counted.select("term", F.pmod(F.xxhash64("doc"), F.lit(self.blocks)).cast("int").alias("block"), "doc", "tf", "len", _bucket(F.col("term"), self.buckets).alias("bucket"))

    def refresh(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> int:
        """Bring the index to what ``docs`` says and return how many texts were written.

        Texts of a known digest are left alone.  Where ``docs`` is the whole table, texts that it lacks are removed; else
        only what it has is looked at.  A null text is an empty one.  The same call again changes nothing.
        """
        done = self._commits()
        gen = done[-1]["gen"] + 1 if done else 1
        now = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
        if done:
            known = self.documents().select("doc", F.col("digest").alias("old"), "gen")
            both = cut(now.select("doc", "digest").join(known, "doc", "full" if whole else "left"))
            fresh = both.where(F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("old")))
            gone = both.where(F.col("gen").isNotNull() & ~F.col("digest").eqNullSafe(F.col("old"))).select("doc", F.col("gen").alias("was"))
            now = now.join(fresh.select("doc"), "doc", "left_semi")
            removed = gone.count()
            if not removed and fresh.isEmpty():
                return 0
            self._put(gone, "dead", gen)
        else:
            removed = 0
        texts = cut(self._terms(now))
        self._put(texts.select("doc", "digest", "len"), "documents", gen)
        self._put_postings(self._split(texts), gen)
        sums = self.spark.read.parquet(f"{self.path}/documents/gen={gen}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("w")).first()
        self._commit(gen, done[-1]["base"] if done else gen, sums["n"], sums["w"], removed)
        return sums["n"]

    def compact(self) -> None:
        """All generations as one, without what they replaced."""
        done = self._commits()
        if len(done) < 2:
            return
        gen, kept = done[-1]["gen"] + 1, cut(self.documents())
        self._put(kept.select("doc", "digest", "len"), "documents", gen)
        dead = self.dead().select("doc", F.col("was").alias("gen"))
        self._put_postings(self.postings().join(dead, ["doc", "gen"], "left_anti").select("term", "block", "doc", "tf", "len", "bucket"), gen)
        sums = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("w")).first()
        self._commit(gen, gen, sums["n"], sums["w"], 0)

    # -- searching -----------------------------------------------------------------------------------------------------

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term): the stems of all words of a query."""
        return queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("word")).select("query_id", porter(F.col("word")).alias("term")).distinct()

    def _of_terms(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """``rows`` of the asked terms with the queries that ask: only their buckets' folders and, of few terms, only their row groups are read."""
        buckets = [r["b"] for r in asked.select(_bucket(F.col("term"), self.buckets).alias("b")).distinct().collect()]  # at most self.buckets
        rows = rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        few = [r["term"] for r in asked.select("term").distinct().limit(1001).collect()]
        if len(few) <= 1000:
            rows = rows.where(F.col("term").isin(few) if few else F.lit(False))
        return rows.join(hinted(asked), "term")

    def search(self, queries: DataFrame, k: int, id_col: str = "doc_id", by_length: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the k best texts for each query (query_id, query); ties to the smaller id.

        Exactly what scoring every text gives.  Texts without any of a query's terms are no results.
        """
        if not self._commits():
            return queries.select("query_id").limit(0).select("query_id", F.lit(None).cast("long").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        asked = cut(self._asked(queries))
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("q")).first()
        if LONG * size["q"] < size["n"] <= TOGETHER:
            return self._search_together(asked, k, id_col, by_length)
        most = weight(F.col("max_tf"), F.col("min_len"), by_length)
        by_term = self._of_terms(self.bounds(), asked).groupBy("query_id", "block", "term").agg(F.max(most).alias("most"))
        order = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "block")
        bounds = cut(by_term.groupBy("query_id", "block").agg(F.sum("most").alias("most")).withColumn("place", F.row_number().over(order)))

        def scored(chosen: DataFrame) -> DataFrame:
            live = self._of_terms(self.postings(), asked).join(hinted(chosen.select("query_id", "block")), ["query_id", "block"])
            return self.live(live).groupBy("query_id", "doc").agg(F.sum(weight(F.col("tf"), F.col("len"), by_length)).alias("points"))

        best = Window.partitionBy("query_id").orderBy(F.col("points").desc(), "doc")
        top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        first = cut(top(scored(bounds.where(F.col("place") <= FIRST_BLOCKS))))
        floor = first.where(F.col("rank") == k).select("query_id", F.col("points").alias("floor"))
        # a block whose bound only equals the k-th score may hold a smaller id
        rest = bounds.where(F.col("place") > FIRST_BLOCKS).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor")))
        every = top(first.select("query_id", "doc", "points").unionByName(scored(cut(rest.select("query_id", "block")))))
        return every.select("query_id", F.col("doc").alias(id_col), (F.col("points") / UNIT).alias("score"), "rank")

    def _search_together(self, asked: DataFrame, k: int, id_col: str, by_length: bool) -> DataFrame:
        """What ``search`` gives, of at most TOGETHER asked terms: the postings go by document to tasks that add up all queries' scores."""
        from pyspark.sql.pandas.types import to_arrow_type

        rows = asked.collect()  # at most TOGETHER
        terms, ids = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}, list(dict.fromkeys(r["query_id"] for r in rows))
        at = {q: i for i, q in enumerate(ids)}
        pairs = np.array(sorted((terms[r["term"]], at[r["query_id"]]) for r in rows), np.int64)
        starts, of = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1]
        numbered = self.spark.createDataFrame(list(terms.items()), "term string, t int")
        hits = self.live(self._of_terms(self.postings(), numbered)).select("doc", "t", weight(F.col("tf"), F.col("len"), by_length).alias("w"))
        kind, types = self._kind(), [to_arrow_type(asked.schema["query_id"].dataType), to_arrow_type(hits.schema["doc"].dataType)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, doc, points = best_together(((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches), starts, of, len(ids), k)
            for i in range(0, len(q), 10_000):
                s = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in q[s]], types[0]), pa.array(doc[s], types[1]), pa.array(points[s], pa.int64())], names=["query_id", "doc", "points"])

        found = hits.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc {kind}, points long")
        best = Window.partitionBy("query_id").orderBy(F.col("points").desc(), "doc")
        every = cut(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return every.select("query_id", F.col("doc").alias(id_col), (F.col("points") / UNIT).alias("score"), "rank")

    def live(self, postings: DataFrame) -> DataFrame:
        """Postings of texts that are in the index now."""
        return postings.join(self.dead().select("doc", F.col("was").alias("gen")), ["doc", "gen"], "left_anti")

    def blocks_left(self, queries: DataFrame, k: int, by_length: bool = False) -> tuple[int, int]:
        """(blocks scored, blocks with any of the terms) over all queries; to see what the bounds save."""
        asked = cut(self._asked(queries))
        most = weight(F.col("max_tf"), F.col("min_len"), by_length)
        bounds = self._of_terms(self.bounds(), asked).groupBy("query_id", "block", "term").agg(F.max(most).alias("most")).groupBy("query_id", "block").agg(F.sum("most").alias("most"))
        floor = self.search(queries, k, "doc", by_length).where(F.col("rank") == k).select("query_id", F.round(F.col("score") * UNIT).cast("long").alias("floor"))
        r = bounds.join(floor, "query_id", "left").agg(F.count_if(F.col("floor").isNull() | (F.col("most") >= F.col("floor"))).alias("a"), F.count(F.lit(1)).alias("b")).first()
        return r["a"], r["b"]
