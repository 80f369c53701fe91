"""The corpus pipeline: stages over ``documents``, each taking what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.pipeline import STAGES, run_stages

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    return run_stages(spark, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
