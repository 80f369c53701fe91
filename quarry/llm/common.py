"""Shared plumbing of the corpus operators: lineage cuts and safe column handling."""

from __future__ import annotations

import gc
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: code points other than space and the ASCII controls 9 to 13.
WORD_JAVA = "[^\\x20\\x09-\\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only in local mode, as in tests.

    Raises where a cluster names none: a folder of one machine would not be seen by the others.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    sc.setCheckpointDir(named)
    return named


#: Rows and bytes of the Arrow batches that go to Python, so that neither side holds many long texts at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's defaults; a session's own settings stand."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


#: Bytes of a checkpoint that one task reads at least, where there are more than two tasks a core.
PACKED = 16 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without lineage.

    A checkpoint has a file for each partition that wrote it, however small; where the files hold less than PACKED bytes
    on average they are read several to a task, down to two tasks a core.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    bounded_batches(spark)
    out = df.checkpoint(eager=True)
    sc = spark.sparkContext
    rdd = out._jdf.queryExecution().logical().rdd()
    at = rdd.getCheckpointFile()
    if at.isEmpty():
        return out
    path = sc._jvm.org.apache.hadoop.fs.Path(at.get())
    size = path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = max(2 * sc.defaultParallelism, -(-size // PACKED))
    return out.coalesce(tasks) if tasks < rdd.getNumPartitions() else out


def merge_slices(parts: DataFrame, combine: np.ufunc, dtype: type, fan: int = 8) -> dict[int, np.ndarray]:
    """Element-wise ``combine`` of the compressed arrays of each slice in ``parts`` (slice int, part binary).

    Arrays meet in two steps, by slice and ``fan`` groups of partitions first, and are added up one by one, so that no
    task holds more than one array a slice, however many partitions there are.  Returns the arrays by slice, so all
    slices together must be of a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(x.as_buffer()), dtype)
                if k in total:
                    combine(total[k], own, out=total[k])
                else:
                    total[k] = own.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["slice", "part"])

    grouped = parts.select("slice", "part", F.pmod(F.spark_partition_id(), F.lit(fan)).alias("g"))
    once = grouped.repartition("slice", "g").select("slice", "part").mapInArrow(run, "slice int, part binary")
    rows = once.repartition("slice").mapInArrow(run, "slice int, part binary").collect()
    return {r["slice"]: np.frombuffer(zlib.decompress(r["part"]), dtype) for r in rows}


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any longer, as after a cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str):
    """Column ``name`` even where it needs quoting."""
    return df[f"`{name}`"]


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id, the text and the named extras, so that no other column's name can clash."""
    bounded_batches(df.sparkSession)
    return df.select(
        column(df, id_col).alias("doc_id"),
        column(df, text_col).cast("string").alias("text"),
        *[column(df, c).alias(c) for c in more],
    )


def with_columns_of(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``, in their order."""
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
