"""Stored indexes of trigrams: literal search in lines without a scan, and similarity of names.

They are kept as ``textindex`` says, with trigrams for terms.  A literal of three characters or more occurs only in texts
that have all its trigrams; those that have its rarest ones are candidates, and only these are read and searched line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators.filters import line_search
from quarry.operators.joins import hinted
from quarry.operators.retrieve import best_of_each
from quarry.operators.textindex import TextIndex
from quarry.sources.checkpoints import cut

#: Of a literal's trigrams so many, the rarest, are intersected.
RAREST = 6


def character_trigrams(x: Column) -> Column:
    """The distinct runs of three characters of the lower-case text."""
    def of(c: Column) -> Column:
        last = F.greatest(F.size(c) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(c, F.lit(1), last), F.slice(c, F.lit(2), last), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.zip_with(pairs, F.slice(c, F.lit(3), last), lambda ab, b: F.concat(ab, b)))

    return t.let(F.filter(F.split(F.lower(x), ""), lambda c: c != ""), of)


class _Trigrams(TextIndex):
    def _terms(self, texts: DataFrame) -> DataFrame:
        return self._counted(texts)

    def _split(self, texts: DataFrame) -> DataFrame:
        each = texts.select("doc", "len", F.explode("words").alias("term"))
        return each.select("term", F.pmod(F.xxhash64("doc"), F.lit(self.blocks)).cast("int").alias("block"), "doc", F.lit(1).alias("tf"), "len", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket"))


class LiteralIndex(_Trigrams):
    """For literals in texts, whatever their case."""

    @staticmethod
    def _count(text: str) -> dict[str, int]:
        return dict.fromkeys((text[i : i + 3] for i in range(len(text) - 2)), 1)

    def candidates(self, literals: DataFrame) -> DataFrame:
        """(literal, doc): the texts that have the rarest trigrams of each of ``literals`` (literal), those that contain it among them.

        Literals of less than three characters have no trigrams and so none here; ``lines`` scans for those.
        """
        asked = literals.select("literal").distinct()
        terms = cut(asked.select(F.col("literal").alias("query_id"), F.explode(character_trigrams(F.col("literal"))).alias("term")))
        counts = self._of_terms(self.bounds(), terms).groupBy("query_id", "term").agg(F.sum("docs").alias("docs"))
        every = terms.join(counts, ["query_id", "term"], "left").fillna(0, ["docs"])
        rare = cut(every.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("docs", "term"))), 1, RAREST).alias("x")).select("query_id", F.size("x").alias("need"), F.explode("x.term").alias("term")))
        hits = self.live(self._of_terms(self.postings(), rare)).groupBy("query_id", "need", "doc").agg(F.count(F.lit(1)).alias("n")).where("n = need")
        return hits.select(F.col("query_id").alias("literal"), "doc")

    def lines(self, docs: DataFrame, literal: str, limit: int, id_col: str = "doc_id") -> DataFrame:
        """What ``line_search`` finds, searching the candidates only."""
        if len(literal) < 3:
            return line_search(docs, literal, limit=limit)
        found = self.candidates(self.spark.createDataFrame([(literal,)], "literal string")).select(F.col("doc").alias(id_col))
        return line_search(docs.join(hinted(found), id_col, "left_semi"), literal, limit=limit)


class NameIndex(_Trigrams):
    """For names that are like a term, by the trigrams of their words."""

    def _counted(self, texts: DataFrame) -> DataFrame:
        return texts.select("doc", "digest", t.trigrams(F.col("text")).alias("words")).withColumn("len", F.size("words"))

    def similar(self, terms: DataFrame) -> DataFrame:
        """(query_id, term, doc, similarity) of the terms (query_id, term) and every name that shares a trigram with one."""
        own = terms.select("query_id", "term").distinct().withColumn("t", t.trigrams(F.col("term")))
        asked = cut(own.select(F.struct("query_id", F.col("term").alias("name"), F.size("t").alias("nt")).alias("query_id"), F.explode("t").alias("term")))
        hits = self.live(self._of_terms(self.postings(), asked)).groupBy("query_id", "doc", "len").agg(F.count(F.lit(1)).alias("s"))
        return hits.select("query_id.query_id", F.col("query_id.name").alias("term"), "doc", (F.col("s") / (F.col("len") + F.col("query_id.nt") - F.col("s"))).alias("similarity"))


def symbol_search(symbols: NameIndex, paths: NameIndex, queries: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """What ``retrieve.symbol`` finds, from indexes of the chunks' symbols and paths."""
    terms = F.slice(F.filter(F.transform(F.split("terms", "\\s+"), F.trim), lambda x: F.length(x) > 2), 1, 10)
    asked = cut(queries.select("query_id", F.explode(terms).alias("term")))
    both = symbols.similar(asked).withColumn("w", F.lit(1.0)).unionByName(paths.similar(asked).withColumn("w", F.lit(0.7)))
    hits = both.groupBy("query_id", F.col("doc").alias(id_col)).agg(F.max(F.col("similarity") * F.col("w")).alias("score")).where("score > 0.1")
    return best_of_each(hits, id_col, k)
