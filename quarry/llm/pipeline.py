"""The stages of the corpus pipeline.

A stage begins by letting go of the shuffle files of the one before, whose result is written by then: they would lie beside its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linedup, mixing, quality, spm, tjoin
from .common import release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go."""
    release(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, and documents of which no line is left; others keep what is left."""
    release(spark)
    out = linedup.dedup_lines(docs)
    emptied = (F.col("__n_lines") > 0) & (F.col("__n_kept") == 0)
    return out.where(~emptied).select(*[F.col(f"`{c}`") for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays; documents without a word all stay.

    The links are those of five-word shingles at a similarity of 0.8, as for near duplicates elsewhere.
    """
    release(spark)
    return tjoin.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice, so that their words come to its targets."""
    release(spark)
    return mixing.take_whole(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text beside the documents' columns, and whether decoding gives the text back."""
    release(spark)
    return spm.encode(docs, spm.read_model(), keep=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources", source_mixing),
    ("SentencePiece", sentencepiece),
]


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on what the one before wrote to the shared checkpoint folder."""
    import uuid

    from .common import checkpoint_dir

    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
