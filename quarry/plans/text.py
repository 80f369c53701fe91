"""Queries over the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.filters import line_search

from .catalog import query, read


@query(
    "f13_line_search",
    """
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
    ), hits AS (SELECT doc_id, line_no, substr(trim(line), 1, 300) AS line FROM lines WHERE contains(lower(line), 'license'))
    SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM hits ORDER BY doc_id, line_no LIMIT 100
    """,
)
def f13(spark, sf_dir):
    return line_search(read(spark, sf_dir, "documents"), "license", limit=100).withColumn("line_no", F.col("line_no").cast("int"))
