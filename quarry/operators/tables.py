"""Reads of the typed tables that the analysers and retrievers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def analysable_files(files: DataFrame, branch) -> DataFrame:
    """A branch's files with content; a missing language or role reads ``unknown`` (S5).  Null content is left out."""
    known = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("language", "role")}
    return files.where((F.col("branch_id") == branch) & F.col("content").isNotNull()).select("id", "path", "content", *[x.alias(c) for c, x in known.items()])


def chunks_with_files(chunks: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """Chunks with columns of the file that they are part of; a chunk without its file is left out."""
    return chunks.join(files.select(F.col("id").alias("file_id"), *columns), "file_id")


def duplicate_units(chunks: DataFrame, files: DataFrame, generated: Column, most: int = 8000) -> DataFrame:
    """Named chunks of files that no tool wrote, the ``most`` of the least id: the limit is the feature's own."""
    ours = files.where(~F.coalesce(generated, F.lit(False)))
    return chunks_with_files(chunks.where("symbol is not null"), ours, "path").orderBy("id").limit(most)
