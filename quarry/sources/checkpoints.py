"""Lineage cuts in the folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` (in local mode one of our own where it is unset) and read it from there."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{_shared(spark)}/own-{uuid.uuid4().hex}"
