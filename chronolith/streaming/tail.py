"""Streams that end in the same tables as the batch operators.

Each run reads what is there (availableNow), keeps its progress in a checkpoint below the shared folder, and puts its
result into a table there; a query returns that table.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from chronolith.functions import text as T
from chronolith.shared import fresh_path
from chronolith.sources import logs


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    # As a pattern the path may be a folder of files or a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{path[:-1]}[{path[-1]}]")


@contextlib.contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries started inside have these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_batches(df: DataFrame, out: str, mode: str, made: Callable[[DataFrame, int], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that puts each batch, or what `made` makes of it, into a folder of its own below `out`.

    A batch that runs twice overwrites its own folder, so nothing is there twice. Progress is kept beside the table.
    """

    def keep(batch: DataFrame, no: int) -> None:
        (made(batch, no) if made else batch).write.mode("overwrite").parquet(f"{out}/batch={no}")

    return df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}-progress")


def drain(df: DataFrame, out: str, mode: str, made: Callable[[DataFrame, int], DataFrame] | None = None) -> bool:
    """Runs the stream over what is there; False if there was nothing, now or before."""
    q = keep_batches(df, out, mode, made).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress is not None or bool(q.recentProgress)


def current(spark: SparkSession, out: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Of every key what the latest batch says that changed it."""
    now = F.max_by(F.struct(*[c for c in columns if c not in keys]), "batch").alias("now")
    return spark.read.parquet(out).groupBy(*keys).agg(now).select(*keys, "now.*")


def run_updates(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The final result of an aggregation by `keys`: each batch writes the keys that it changed, of which the latest stand."""
    spark = df.sparkSession
    out = fresh_path(spark, what)
    if not drain(df, out, "update"):
        return spark.createDataFrame([], df.schema)
    return current(spark, out, keys, df.columns)


def log_tail(spark: SparkSession, path: str) -> DataFrame:
    """The latest value of every step of a log that is read as it grows; a step that comes again replaces the old one."""
    return run_updates(logs.latest(logs.parse(logs.event_lines(source(spark, path)))), ["step", "training"], "tail")


def window_counts(spark: SparkSession, path: str, late: str | None = None) -> DataFrame:
    """Counts and sums by day and kind of event. All rows count, however late, and every window stays in the state; with
    `late`, such as '2 days', the state forgets windows that old, and rows that come later than that are not counted."""
    rows = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    made = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    done = run_updates(made, ["window", "event_type"], "windows")
    return done.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def packing_state(spark: SparkSession, path: str) -> DataFrame:
    """Tokens, full windows and tokens left over of every source, carried on from batch to batch."""
    rows = source(spark, path).select(F.col("source").alias("subreddit"), (T.token_count(F.col("text")) + 1).alias("n"))
    done = run_updates(rows.groupBy("subreddit").agg(F.sum("n").alias("tokens")), ["subreddit"], "packing")
    windows = F.expr("(tokens - 1) div 1024")
    return done.select("subreddit", "tokens", windows.alias("windows"), (F.col("tokens") - 1024 * windows).alias("tail"))
