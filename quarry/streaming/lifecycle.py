"""The life of a run as keyed state: its steps in one value, and event-time timers that end what is silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import DONE

OUT = "run_id string, done int, percent int, state string, version long, seen timestamp"
_OUT = OUT.replace("seen timestamp", "seen long")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def map_state(spark: SparkSession):
    """A session setting for as long as a query is started: map state and timers need the state store on disk."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class RunLife(StatefulProcessor):
    """Keeps the last status of each step, however late it comes, and reports the run at each batch that has news of it.

    Of a step's statuses that with the greatest (ts, seq) counts, so the result doesn't depend on batches.  A run that is
    silent for ``silence_ms`` of event time is reported stale and forgotten.  All that is kept of a run is one value, as
    each access to the state is a message to the store: a batch reads and writes it once.  Its timer follows from ``seen``.
    """

    def __init__(self, total: int, silence_ms: int | None):
        self.total, self.silence_ms = total, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "version long, seen long, steps array<struct<step: string, status: string, ts: long, seq: long>>")

    def _report(self, run: str, state: str | None, version: int, seen: int, statuses: list[str]) -> Row:
        done = sum(s in DONE for s in statuses)
        name = state or ("failed" if "failed" in statuses else "completed" if done == self.total else "running")
        return Row(run_id=run, done=done, percent=int(100 * done / self.total + 0.5), state=name, version=version, seen=seen)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.life.get()
        version, seen, steps = kept or (0, 0, [])
        best = {step: (ts, seq, status) for step, status, ts, seq in steps}
        before = seen // 1000 + self.silence_ms if kept and self.silence_ms is not None else None
        for r in rows:
            best[r["step"]] = max(best.get(r["step"], (-1, -1, "")), (r["us"], r["seq"], r["status"]))
            seen = max(seen, r["us"])
            version += 1
        self.life.update((version, seen, [(step, status, ts, seq) for step, (ts, seq, status) in best.items()]))
        if self.silence_ms is not None and before != (timer := seen // 1000 + self.silence_ms):
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        yield self._report(key[0], None, version, seen, [x[2] for x in best.values()])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        version, seen, steps = self.life.get()
        self.life.clear()
        yield self._report(key[0], "stale", version + 1, seen, [x[1] for x in steps])

    def close(self) -> None:
        pass


def run_lives(steps: DataFrame, total: int, delay: str, silence_ms: int | None = 3_600_000) -> DataFrame:
    """OUT for a stream of steps (run_id, step, status, ts, seq), a row whenever there is news of a run.

    ``delay`` is how late a step may come.  Without ``silence_ms`` runs are kept for good.  State ends by timers in event
    time: Spark's time to live goes by the clock, and a query with it never ends where a stream ends with what is there.
    """
    own = steps.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    lives = own.groupBy("run_id").transformWithState(RunLife(total, silence_ms), _OUT, "update", "EventTime")
    return lives.withColumn("seen", F.timestamp_micros("seen"))


def last_of_each(lives: DataFrame) -> DataFrame:
    """(run_id, done, percent, state): the last report of each run."""
    last = lives.groupBy("run_id").agg(F.max_by(F.struct("done", "percent", "state"), "version").alias("x"))
    return last.select("run_id", "x.done", "x.percent", "x.state")
