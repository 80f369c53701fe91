"""Keyed tables in hash buckets, where a change rewrites the buckets that it touches and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.sets import distinct_first
from quarry.sources.checkpoints import cut

BUCKETS = 64


class BucketTable:
    """Parquet under ``path``, in folders by the hash of the keys.

    For a table of children the keys are those of the parent, so that all of a parent's rows lie in one bucket.  Null keys
    are equal to each other.  One writer at a time.  A write that breaks off is mended by doing it again, since each one
    replaces whole buckets by what they were plus the change.
    """

    def __init__(self, spark: SparkSession, path: str, *keys: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def there(self) -> bool:
        fs, p = self._fs(f"{self.path}/_SUCCESS")
        return fs.exists(p)

    def _stored(self) -> DataFrame:
        """All rows with their bucket; the columns are written down beside the table, since it may have no rows."""
        columns = self.spark.read.parquet(f"{self.path}.columns").schema
        return self.spark.read.schema(columns).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _same_keys(self, a: str, b: str) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    def upsert(self, new: DataFrame, *order: Column | str) -> list[int]:
        """Rows of ``new`` in place of those of the same keys, of several in ``new`` the first in ``order``; the buckets that were written.

        Rows that are there already as they are touch nothing, so a batch that comes again writes nothing.
        """
        fresh = cut(distinct_first(new, self.keys, *(order or [c for c in new.columns if c not in self.keys])))
        if self.there():
            old = self._of_buckets(self._touched(fresh))
            row = lambda a: F.struct(*[F.col(f"{a}.`{c}`") for c in new.columns])
            fresh = cut(fresh.alias("n").join(old.alias("o"), self._same_keys("n", "o") & row("n").eqNullSafe(row("o")), "left_anti"))
        return self._put(fresh, fresh.select(*self.keys))

    def replace(self, new: DataFrame, parents: DataFrame) -> list[int]:
        """All rows of the given parents replaced by ``new``, which has rows of those parents only; the buckets that were written."""
        return self._put(cut(new), cut(parents.select(*self.keys).distinct()))

    def delete(self, gone: DataFrame) -> list[int]:
        """The rows of the given keys removed; the buckets that were written."""
        if not self.there():
            return []
        return self._put(self.read().limit(0), cut(gone.select(*self.keys).distinct()))

    def _touched(self, *frames: DataFrame) -> list[int]:
        return sorted({r["bucket"] for f in frames for r in f.select(self._bucket()).distinct().collect()})  # at most self.buckets

    def _of_buckets(self, numbers: list[int]) -> DataFrame:
        return self._stored().where(F.col("bucket").isin(numbers) if numbers else F.lit(False)).drop("bucket")

    def _put(self, new: DataFrame, gone: DataFrame) -> list[int]:
        named = lambda df: df.select("*", self._bucket())
        # ranges of keys within a bucket, so that a large one goes to several files
        write = lambda df: df.repartitionByRange("bucket", *self.keys).write.partitionBy("bucket")
        if not self.there():
            named(new).limit(0).write.mode("overwrite").parquet(f"{self.path}.columns")
            write(named(new)).mode("overwrite").parquet(self.path)
            return self._touched(new)
        touched = self._touched(new, gone)
        if not touched:
            return []
        kept = self._of_buckets(touched).alias("o").join(gone.alias("g"), self._same_keys("o", "g"), "left_anti")
        whole = cut(named(kept.unionByName(new)))  # what is read is written over
        write(whole).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        full = {r["bucket"] for r in whole.select("bucket").distinct().collect()}
        for b in set(touched) - full:  # an overwrite leaves a folder alone for which it has no row
            fs, p = self._fs(f"{self.path}/bucket={b}")
            fs.delete(p, True)
        return touched
