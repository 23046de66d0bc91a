"""Which partitions still need work: scans, barriers and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS = 3


def scan(expected: DataFrame, outputs: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, attempts: complete (has an output or is missing at the source), running, failed, or queued now.

    jobs: keys, state ('running', 'failed', 'success'), attempts, checks. A success without output is looked at once more
    before it is queued again. Queued partitions have one attempt more. An anti-join in effect: outputs and jobs are one
    row for each partition.
    """
    known = expected.join(outputs.select(*keys, F.lit(True).alias("done")).distinct(), keys, "left").join(jobs, keys, "left")
    attempts = F.coalesce("attempts", F.lit(0))
    recheck = (F.col("state") == "success") & (F.coalesce("checks", F.lit(0)) + 1 < 2)
    status = F.when(F.col("done"), "complete").when(F.col("state") == "running", "running").when(recheck, "checked").when(attempts >= MOST_ATTEMPTS, "failed").otherwise("queued")
    made = known.withColumn("status", status)
    return made.select(*keys, "status", (attempts + F.when(F.col("status") == "queued", 1).otherwise(0)).cast("int").alias("attempts"))


def barrier(scanned: DataFrame) -> DataFrame:
    """One row: partitions by status, their total, and whether all are complete."""
    count = lambda s: F.count_if(F.col("status") == s)
    return scanned.agg(*[count(s).alias(s) for s in ("complete", "running", "checked", "queued", "failed")], F.count("*").alias("total"), (count("complete") == F.count("*")).alias("all_done"))


def resumable(wanted: DataFrame, audits: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Wanted partitions without an audit of this version."""
    return wanted.join(audits.filter(F.col("version") == version).select(*keys), keys, "left_anti")


def partition_path(year: str = "year", month: str = "month", kind: str = "kind"):
    return F.format_string("%04d/%02d/%s", F.col(year).cast("int"), F.col(month).cast("int"), F.col(kind))


def crossed(steps: DataFrame, milestones: DataFrame, key: str, value: str, cell: int) -> DataFrame:
    """key, crossed: the distinct milestones in (low, high] of each step, steps without any included.

    steps: key, low, high. An equi-join on cells of `cell` values: a milestone lies in one, a step reaches over a few.
    """
    marks = milestones.select(F.col(value).alias("at")).filter("at is not null").distinct().withColumn("cell", F.expr(f"cast(floor(at / {cell}) as bigint)"))
    reach = steps.withColumn("cell", F.explode(F.expr(f"sequence(cast(floor((low + 1) / {cell}) as bigint), cast(floor(greatest(high, low + 1) / {cell}) as bigint))")))
    met = reach.join(marks, (reach["cell"] == marks["cell"]) & (F.col("at") > F.col("low")) & (F.col("at") <= F.col("high")), "left")
    return met.groupBy(key).agg(F.count("at").cast("int").alias("crossed"))
