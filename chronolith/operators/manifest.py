"""The manifest of packed partitions: what is missing, why, and totals of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 2


def expected(spark, first: int = 2011, last: int = 2022, last_month: int = 8) -> DataFrame:
    """year, month, kind of every partition that the corpus should have."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    months = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.when(F.col("year") == last, last_month).otherwise(12))))
    return months.withColumn("kind", F.explode(F.array(F.lit("submissions"), F.lit("comments"))))


def reasons(wanted: DataFrame, clean: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason: null where a partition is complete, else the first thing that is wrong with it.

    clean: keys, status; packed: keys, version, windows, rows (counted in its files), first, last (dates found), start, stop
    (the partition's bounds).
    """
    j = wanted.join(clean.select(*keys, F.col("status").alias("__s")), keys, "left").join(packed.withColumn("__p", F.lit(True)), keys, "left")
    reason = (
        F.when(F.col("__s") == "missing_source", "missing source").when(F.col("__s").isNull(), "not cleaned").when(F.col("__p").isNull(), "not packed")
        .when(~F.col("version").eqNullSafe(F.lit(VERSION)), "other version").when(F.col("windows") != F.col("rows"), "window counts differ")
        .when((F.col("first") < F.col("start")) | (F.col("last") >= F.col("stop")), "dates outside the month")
    )
    return j.select(*keys, reason.alias("reason"))


def totals(shards: DataFrame) -> DataFrame:
    """Tokens and documents by split and kind, by split, and overall, in one pass."""
    return shards.rollup("split", "kind").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))


def check_complete(reasons_: DataFrame, require: bool = True) -> None:
    """An error that names some incomplete partitions, unless they are allowed."""
    bad = reasons_.filter("reason is not null").limit(5).collect()
    if require and bad:
        raise ValueError(f"incomplete partitions, among them {[tuple(r) for r in bad]}")


def split_rows(shards: DataFrame, split: str, allow_test: bool = False) -> DataFrame:
    """Shards of a split; the test split only if asked for."""
    if split == "test" and not allow_test:
        raise PermissionError("the test split is locked; pass allow_test=True")
    return shards.filter(F.col("split") == split)
