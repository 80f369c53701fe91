"""Running streams over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.buckets import BUCKETS, BucketTable
from quarry.sources.checkpoints import new_folder


def read_parquet_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """The Parquet file or folder ``name`` under ``folder`` as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    # event time is a point in time; files that leave the zone open mean the session's
    return stream.withColumns({f.name: stream[f.name].cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def settle(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream after all there is now, read from the table that the last batch wrote."""
    spark, folder = stream.sparkSession, None
    folder = new_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def index_incrementally(stream: DataFrame, table: str, state: str, *keys: str, buckets: int = BUCKETS) -> None:
    """What a stream of files brings, put into a table by key; a batch rewrites the buckets that it touches, and one that comes again none."""
    known = BucketTable(stream.sparkSession, table, *keys, buckets=buckets)
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda batch, number: known.upsert(batch)).start().awaitTermination()


def receive(deliveries: DataFrame, secret: str | None, table: str, state: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Webhook deliveries (delivery, event, sent, signature, body) of a stream, each judged once and kept by its id; the table after all there is now.

    A delivery that comes again within ``delay`` goes in the stream, one that comes later or in a repeated batch changes
    nothing in the table.
    """
    from quarry.sources.readers import webhook_events

    once = deliveries.withWatermark("sent", delay).dropDuplicatesWithinWatermark(["delivery"])
    judged = webhook_events(once, secret).select("delivery", "event", "status", "action", "installation_id")
    known = BucketTable(deliveries.sparkSession, table, "delivery", buckets=buckets)
    judged.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda batch, number: known.upsert(batch)).start().awaitTermination()
    return known.read()
