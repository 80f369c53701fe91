"""Bucket tables, runs with state, webhook deliveries and paged files."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import paged, readers
from quarry.sources.buckets import BucketTable
from quarry.streaming import lifecycle, runner

pytestmark = pytest.mark.usefixtures("few_partitions")


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def bucket_of(path):
    return int(path.split("bucket=")[1].split("/")[0])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_an_upsert_rewrites_only_the_buckets_of_what_changed(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", "k", buckets=16)
    first = spark.createDataFrame([(i, f"v{i}", [i]) for i in range(200)] + [(None, "none", None)], "k int, v string, more array<int>")
    t.upsert(first)
    before = stamps(tmp_path / "t")
    assert len({bucket_of(f) for f in before}) == 16
    change = spark.createDataFrame([(3, "new", [1]), (3, "newer", None), (500, "more", [5]), (7, "v7", [7]), (None, "null", None)], "k int, v string, more array<int>")
    touched = t.upsert(change, F.col("v").desc())
    after = stamps(tmp_path / "t")
    assert 1 <= len(touched) <= 3
    assert {f: m for f, m in before.items() if bucket_of(f) not in touched} == {f: m for f, m in after.items() if bucket_of(f) not in touched}
    want = {i: f"v{i}" for i in range(200)} | {3: "newer", 500: "more", None: "null"}
    assert {r["k"]: r["v"] for r in t.read().collect()} == want and t.read().count() == len(want)
    assert t.upsert(change, F.col("v").desc()) == [] and stamps(tmp_path / "t") == after  # the same batch again


def test_children_are_replaced_and_emptied_buckets_go(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", "p", buckets=4)
    t.replace(spark.createDataFrame([(p, c) for p in range(8) for c in range(3)], "p int, c int"), spark.range(8).select(F.col("id").cast("int").alias("p")))
    t.replace(spark.createDataFrame([(2, 9)], "p int, c int"), spark.createDataFrame([(2,), (5,), (77,)], "p int"))
    want = [(p, c) for p in range(8) for c in range(3) if p not in (2, 5)] + [(2, 9)]
    assert rows(t.read()) == sorted(want)
    assert len(t.delete(spark.range(8).select(F.col("id").cast("int").alias("p")))) > 0
    assert rows(t.read()) == [] if stamps(tmp_path / "t") else True
    assert t.upsert(spark.createDataFrame([(1, 1)], "p int, c int")) and rows(t.read()) == [(1, 1)]


def test_a_stream_of_files_goes_to_a_table_by_key(spark, tmp_path):
    src, table, state = f"{tmp_path}/in", f"file://{tmp_path}/t", f"{tmp_path}/state"
    run = lambda: runner.index_incrementally(spark.readStream.schema("path string, sha string").parquet(src), table, state, "path", buckets=8)
    spark.createDataFrame([("a", "1"), ("b", "1")], "path string, sha string").write.parquet(src)
    run()
    spark.createDataFrame([("b", "2"), ("c", "1")], "path string, sha string").write.mode("append").parquet(src)
    run()
    run()
    assert rows(BucketTable(spark, table, "path").read()) == [("a", "1"), ("b", "2"), ("c", "1")]


STEP = "run_id string, step string, status string, ts timestamp, seq long"


def feed(spark, path, steps):
    spark.createDataFrame(steps, "run_id string, step string, status string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def lives(spark, tmp_path, silence_ms):
    """Reports so far, by a query that goes on from its checkpoint."""
    stream = spark.readStream.schema(STEP).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    with lifecycle.map_state(spark):
        q = lifecycle.run_lives(stream, 2, "1 minute", silence_ms).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        q.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


def test_a_run_lives_on_over_a_restart_and_late_steps_dont_undo_later_ones(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", [("r", "one", "running", "2024-01-01 10:00:00", 1), ("r", "one", "completed", "2024-01-01 10:00:20", 2), ("s", "one", "failed", "2024-01-01 10:00:00", 3)])
    first = lifecycle.last_of_each(lives(spark, tmp_path, None))
    assert rows(first) == [("r", 1, 50, "running"), ("s", 0, 0, "failed")]
    feed(spark, f"{tmp_path}/in", [("r", "two", "skipped", "2024-01-01 10:00:30", 5), ("r", "one", "running", "2024-01-01 10:00:10", 4)])
    again = lifecycle.last_of_each(lives(spark, tmp_path, None))
    assert rows(again) == [("r", 2, 100, "completed"), ("s", 0, 0, "failed")]


def test_a_silent_run_is_stale_by_event_time_and_starts_anew(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", [("old", "one", "completed", "2024-01-01 10:00:00", 1)])
    lives(spark, tmp_path, 3_600_000)
    feed(spark, f"{tmp_path}/in", [("new", "one", "completed", "2024-01-01 13:00:00", 2)])
    lives(spark, tmp_path, 3_600_000)
    feed(spark, f"{tmp_path}/in", [("new", "two", "completed", "2024-01-01 13:00:01", 3)])
    got = lives(spark, tmp_path, 3_600_000)
    assert rows(lifecycle.last_of_each(got)) == [("new", 2, 100, "completed"), ("old", 1, 50, "stale")]
    feed(spark, f"{tmp_path}/in", [("old", "two", "running", "2024-01-01 13:00:30", 4)])
    last = lives(spark, tmp_path, 3_600_000).where("run_id = 'old'").orderBy(F.col("seen").desc()).first()
    assert (last["done"], last["state"]) == (0, "running")


def test_deliveries_come_once_over_batches_and_restarts(spark, tmp_path):
    import base64
    import hashlib
    import hmac

    spark.dataSource.register(paged.Deliveries)
    os.makedirs(tmp_path / "logs")

    def log(name, *ids, sent="2024-01-01T10:00:00+00:00"):
        out = []
        for i in ids:
            body = b"nothing" if i == 4 else json.dumps({"action": "deleted", "installation": {"id": i}}).encode()
            sign = "sha256=" + hmac.new(b"key", body, hashlib.sha256).hexdigest()
            out.append(json.dumps({"delivery": f"d{i}", "event": "installation", "sent": sent, "signature": sign if i != 3 else "sha256=0", "body": base64.b64encode(body).decode()}))
        (tmp_path / "logs" / name).write_text("\n".join(out))

    def run():
        stream = spark.readStream.format("deliveries").option("path", str(tmp_path / "logs")).load()
        return rows(runner.receive(stream, "key", f"file://{tmp_path}/t", f"{tmp_path}/state", "1 hour", buckets=4))

    log("log-1", 2, 1, 2, 3)
    assert [r[0] for r in run()] == ["d1", "d2", "d3"]
    log("log-2", 1, 4)
    log("log-3", 5, 5, 2, sent="2024-01-01T18:00:00+00:00")  # beyond the watermark of the first
    want = [("d1", "installation", 200, "deleted", "1"), ("d2", "installation", 200, "deleted", "2"), ("d3", "installation", 401, None, None), ("d4", "installation", 400, None, None), ("d5", "installation", 200, "deleted", "5")]
    assert run() == want and run() == want


def write_pages(path, pages):
    os.makedirs(path)
    for i, items in enumerate(pages):
        with open(f"{path}/p{i}", "w") as f:
            json.dump({"items": items, "next": f"p{i + 1}" if i + 1 < len(pages) else None}, f)


def load(spark, path, **options):
    spark.dataSource.register(paged.PageFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("page_files").schema("n int, s string").options(path=path, first="p0", **options).load()


def test_pages_follow_their_links_to_a_cap_with_filters_in_the_source(spark, tmp_path):
    path = f"{tmp_path}/pages"
    write_pages(path, [[{"n": 1, "s": "a"}, {"n": 2}], [], [{"n": 3, "s": "b", "x": 1}, {"s": "b"}]])
    df = load(spark, path)
    assert df.rdd.getNumPartitions() == 3
    assert rows(df) == sorted([(1, "a"), (2, None), (3, "b"), (None, "b")], key=repr)
    assert rows(load(spark, path, most=3)) == [(1, "a"), (2, None), (3, "b")]
    assert rows(load(spark, path, most=0)) == []
    own = df.where("s = 'b' and n >= 2 and length(s) = 1")
    assert rows(own) == [(3, "b")]
    plan = own._jdf.queryExecution().executedPlan().toString()
    kept = [x for x in plan.splitlines() if "Filter" in x and "BatchScan" not in x]
    assert "(s#" not in "".join(kept).replace("length(s#", "") or "PushedFilters" in plan
    assert rows(df.where("n in (1, 3)")) == [(1, "a"), (3, "b")]
    assert rows(df.where("n is null")) == [(None, "b")] and rows(df.where("n < 2 or s is null")) == [(1, "a"), (2, None)]


def test_pages_that_go_round_are_an_error(spark, tmp_path):
    path = f"{tmp_path}/pages"
    os.makedirs(path)
    with open(f"{path}/p0", "w") as f:
        json.dump({"items": [], "next": "p0"}, f)
    with pytest.raises(Exception, match="circle"):
        load(spark, path).collect()


def test_the_signature_is_the_keyed_hash(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([(b"x",)], "b binary").select(readers.webhook_signature(F.col("b"), "k")).first()[0]
    assert got == "sha256=" + hmac.new(b"k", b"x", hashlib.sha256).hexdigest()


def test_a_run_reads_and_writes_its_state_once_a_batch():
    from pyspark.sql import Row

    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        def registerTimer(self, at):  # noqa: N802
            calls.append(("register", at))

        def deleteTimer(self, at):  # noqa: N802
            calls.append(("delete", at))

    life = lifecycle.RunLife(3, 10)
    life.init(Handle())
    step = lambda name, status, us: Row(run_id="r", step=name, status=status, us=us, seq=1)
    assert [r["done"] for r in life.handleInputRows(("r",), iter([step(n, "completed", 5000) for n in "ab"]), None)] == [2]
    assert calls == ["get", "update", ("register", 15)]
    calls.clear()
    assert [r["version"] for r in life.handleInputRows(("r",), iter([step("a", "running", 4000), step("c", "skipped", 9000)]), None)] == [4]
    assert calls == ["get", "update", ("delete", 15), ("register", 19)]
