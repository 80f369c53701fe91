"""Progress of runs: steps go pending, running, then completed, failed or skipped; percent is of steps done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DONE = ("completed", "skipped")
STATE = "steps map<string,string>"
OUT = "run_id string, done int, percent int, state string"


def summary(steps: DataFrame, total: int) -> DataFrame:
    """(run_id, done, percent, state) from the last status of each step (run_id, step, status, at); batch form."""
    last = steps.groupBy("run_id", "step").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    done = F.count_if(F.col("status").isin(*DONE))
    failed = F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False))
    return last.groupBy("run_id").agg(done.cast("int").alias("done"), failed.alias("f")).select(
        "run_id", "done", F.floor(100 * F.col("done") / total + 0.5).cast("int").alias("percent"),
        F.when(F.col("f"), "failed").when(F.col("done") == total, "completed").otherwise("running").alias("state"),
    )


def track(steps: DataFrame, total: int, silence_ms: int | None = 3_600_000) -> DataFrame:
    """The same for a stream, with state by run; a run that is silent for too long is reported stale and forgotten.

    Without ``silence_ms`` runs are kept for good, which suits a stream that ends with what is there now.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            known = dict(state.get[0])
            state.remove()
            done = sum(v in DONE for v in known.values())
            yield pd.DataFrame([(key[0], done, int(100 * done / total + 0.5), "stale")], columns=["run_id", "done", "percent", "state"])
            return
        known = dict(state.get[0]) if state.exists else {}
        for pdf in frames:
            for step, status in pdf.sort_values(["at", "status"])[["step", "status"]].itertuples(index=False):
                known[step] = status
        state.update((known,))
        if silence_ms is not None:
            state.setTimeoutDuration(silence_ms)
        done = sum(v in DONE for v in known.values())
        name = "failed" if "failed" in known.values() else "completed" if done == total else "running"
        yield pd.DataFrame([(key[0], done, int(100 * done / total + 0.5), name)], columns=["run_id", "done", "percent", "state"])

    timeout = GroupStateTimeout.NoTimeout if silence_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return steps.groupBy("run_id").applyInPandasWithState(update, OUT, STATE, "update", timeout)
