"""Retry state of partitions, kept by key while their reports stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolith.shared import fresh_path
from chronolith.streaming.tail import source

MOST_ATTEMPTS, MOST_CHECKS = 3, 2


def next_state(state: tuple[str, int, int], report: str) -> tuple[str, int, int]:
    """(status, attempts, checks) after a report.

    'start' begins an attempt unless the partition is done or has used its attempts; 'fail' leaves it queued or failed;
    'success' without output is looked at once more; a second one without it counts as lost, and the partition is queued again; 'output' completes it.
    """
    status, attempts, checks = state
    if status in ("complete", "failed"):
        return state
    if report == "start":
        return ("running", attempts + 1, 0) if attempts < MOST_ATTEMPTS else ("failed", attempts, checks)
    if report == "fail":
        return ("failed" if attempts >= MOST_ATTEMPTS else "queued", attempts, 0)
    if report == "success":
        return ("running", attempts, checks + 1) if checks + 1 < MOST_CHECKS else ("queued", attempts, 0)
    return ("complete", attempts, checks) if report == "output" else state


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's reports of one batch in order; streams cannot be sorted, so they meet here, as many as the source's batch has."""
    now = state.get if state.exists else ("queued", 0, 0)
    rows = pd.concat(list(batches)).sort_values("event_id")
    for report in rows["report"]:
        now = next_state(tuple(now), report)
    state.update(tuple(now))
    yield pd.DataFrame({"part": [key[0]], "status": [now[0]], "attempts": [now[1]], "checks": [now[2]]})


def partition_states(spark: SparkSession, path: str) -> DataFrame:
    """part, status, attempts, checks: the last state of every partition (here a user) after all reports."""
    report = F.element_at(F.array(*[F.lit(x) for x in ("start", "fail", "success", "output", "success")]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = source(spark, path).select(F.col("user_id").alias("part"), "event_id", report.alias("report"))
    states = rows.groupBy("part").applyInPandasWithState(fold, "part long, status string, attempts long, checks long", "status string, attempts long, checks long", "update", GroupStateTimeout.NoTimeout)
    out = fresh_path(spark, "states")

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={no}")

    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("part").agg(F.max_by(F.struct("status", "attempts", "checks"), "batch").alias("s"))
    return last.select("part", "s.*")
