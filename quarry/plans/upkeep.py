"""Queries of tables that are kept up, of streams with state, and of paged sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.sources import paged, readers
from quarry.sources.buckets import BucketTable
from quarry.streaming import lifecycle, runner

from .catalog import query, read
from .flows import _STEPS

# -- tables by key -------------------------------------------------------------------------------------------------------


@query("s13_incremental", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS seen FROM events GROUP BY 1")
def s13_incremental(spark, d):
    """Events by weeks, each batch a file or more of a stream; the table keeps each user's last one."""
    events, folder = read(spark, d, "events"), runner.new_folder(spark)
    kind = events.schema["ts"].dataType
    for i, batch in enumerate((F.dayofmonth("ts") <= 10, F.dayofmonth("ts") > 10)):
        events.where(batch).select("user_id", "event_type", "ts", "event_id").write.parquet(f"{folder}/in/{i}")
        # a stream that goes on where the last one ended
        last = spark.readStream.schema("user_id long, event_type string, ts timestamp, event_id long").option("recursiveFileLookup", True).parquet(f"{folder}/in")
        table = BucketTable(spark, f"{folder}/table", "user_id", buckets=16)

        def keep(batch, number, table=table):
            old = table.read().join(batch.select("user_id"), "user_id", "left_semi") if table.there() else batch.limit(0)
            table.upsert(batch.unionByName(old), F.col("ts").desc(), F.col("event_id").desc())

        last.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return table.read().select("user_id", "event_type", F.col("ts").cast(kind).alias("seen"))


@query(
    "s14_replace_children",
    """SELECT l_orderkey, l_linenumber, CASE WHEN o_orderpriority = '1-URGENT' THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderpriority <> '1-URGENT' OR l_linenumber <= 2""",
)
def s14_children(spark, d):
    """All lines, then those of urgent orders replaced by their first two with another quantity."""
    lines, orders = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), read(spark, d, "orders")
    table = BucketTable(spark, f"{runner.new_folder(spark)}/lines", "l_orderkey", buckets=16)
    table.replace(lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"), orders.select(F.col("o_orderkey").alias("l_orderkey")))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = lines.where("l_linenumber <= 2").join(urgent, "l_orderkey", "left_semi").withColumn("l_quantity", F.col("l_quantity") + 1)
    table.replace(new.select(*lines.columns), urgent)
    return table.read()


@query(
    "s20_commits",
    """SELECT o_custkey AS repository, sha1(CAST(o_orderkey AS VARCHAR)) AS sha, CASE WHEN o_orderstatus = 'O' THEN upper(o_orderpriority) || '!' ELSE o_orderpriority END AS message FROM orders""",
)
def s20_commits(spark, d):
    """All commits, then those of open orders again with another message and some unchanged."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("repository"), F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("sha"), F.col("o_orderpriority").alias("message"), "o_orderstatus")
    table = BucketTable(spark, f"{runner.new_folder(spark)}/commits", "repository", "sha", buckets=16)
    table.upsert(o.drop("o_orderstatus"))
    table.upsert(o.withColumn("message", F.when(F.col("o_orderstatus") == "O", F.concat(F.upper("message"), F.lit("!"))).otherwise(F.col("message"))).drop("o_orderstatus"))
    return table.read()


# -- runs ----------------------------------------------------------------------------------------------------------------


def _step_files(spark, d, folder: str) -> None:
    """The events as steps of runs in several files, not in the order of time."""
    events = read(spark, d, "events")
    status = F.when(F.col("event_id") % 4 == 1, "running").when(F.col("event_id") % 4 == 2, "skipped").otherwise("completed")
    steps = events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("step"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    steps.repartition(3, "seq").write.parquet(folder)


_STEP = "run_id string, step string, status string, ts timestamp, seq long"


@query(
    "s_run_lifecycle",
    f"""WITH l AS (SELECT run_id, step, arg_max(status, (ts, event_id)) AS status FROM ({_STEPS}) GROUP BY 1, 2), d AS (SELECT run_id, count(*) FILTER (status IN ('completed', 'skipped')) AS done FROM l GROUP BY 1)
    SELECT run_id, CAST(done AS INTEGER) AS done, CAST(floor(100 * done / 15 + 0.5) AS INTEGER) AS percent, CASE WHEN done = 15 THEN 'completed' ELSE 'running' END AS state FROM d""",
)
def s_run_lifecycle(spark, d):
    folder = runner.new_folder(spark)
    _step_files(spark, d, f"{folder}/steps")
    stream = spark.readStream.schema(_STEP).option("maxFilesPerTrigger", 1).parquet(f"{folder}/steps")
    with lifecycle.map_state(spark):
        return lifecycle.last_of_each(runner.settle(lifecycle.run_lives(stream, 15, "400 days", 400 * 86_400_000), "update"))


# -- webhooks ------------------------------------------------------------------------------------------------------------

_SECRET = "s3cret"


@query(
    "s_webhook_stream",
    """SELECT 'd' || c_custkey AS delivery, CASE WHEN c_custkey % 7 = 0 THEN 400 WHEN c_custkey % 5 = 0 THEN 401 ELSE 200 END AS status, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS installation_id FROM customer""",
)
def s_webhook_stream(spark, d):
    """Each delivery twice, in the order of a hash; every fifth with a wrong signature, every seventh without JSON."""
    spark.dataSource.register(paged.Deliveries)
    folder = runner.new_folder(spark)
    body = "encode(if(c_custkey % 7 = 0, 'no json', '{\"action\": \"deleted\", \"installation\": {\"id\": ' || c_custkey || '}}'), 'UTF-8') as body"
    own = read(spark, d, "customer").selectExpr("c_custkey", "'d' || c_custkey as delivery", "'installation' as event", body, "explode(array(0, 5)) as again")
    right = readers.webhook_signature(F.col("body"), _SECRET)
    sent = F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("c_custkey") % 100 + F.col("again")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    signed = own.withColumn("signature", F.when(F.col("c_custkey") % 5 == 0, F.reverse(right)).otherwise(right)).withColumn("sent", sent)
    logs = signed.select("delivery", "event", "sent", "signature", F.base64("body").alias("body"), F.xxhash64("delivery", "again").alias("o")).repartitionByRange(4, "o").sortWithinPartitions("o").drop("o")
    logs.write.json(f"{folder}/logs")
    stream = spark.readStream.format("deliveries").option("path", f"{folder}/logs").load()
    out = runner.receive(stream, _SECRET, f"{folder}/table", f"{folder}/state", "1 hour", buckets=8)
    return out.select("delivery", "status", "installation_id")


# -- pages ---------------------------------------------------------------------------------------------------------------


@query("s4_page_files", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def s4_pages(spark, d):
    """All orders in pages of a thousand keys, each page linking to the next, read by a filter that the source applies."""
    spark.dataSource.register(paged.PageFiles)
    folder = f"{runner.new_folder(spark)}/pages"
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    rows = o.groupBy(F.floor(F.col("o_orderkey") / 4000).alias("n")).agg(F.collect_list(F.struct(*o.columns)).alias("items"))
    after = rows.select("n", F.lead("n").over(Window.orderBy("n")).alias("m"))  # a number a page
    pages = rows.join(after, "n")
    text = pages.select("n", F.to_json(F.struct("items", F.concat(F.lit("n="), F.col("m").cast("string")).alias("next"))).alias("value"))
    text.repartition("n").write.partitionBy("n").text(folder)
    first = rows.agg(F.min("n")).first()[0]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return paged_orders(spark, folder, f"n={first}").where("o_orderstatus = 'F' and o_totalprice > 100000")


def paged_orders(spark, folder: str, first: str):
    return spark.read.format("page_files").schema("o_orderkey long, o_orderstatus string, o_totalprice double").option("path", folder).option("first", first).load()
