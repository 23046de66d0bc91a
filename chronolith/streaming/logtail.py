"""Growing text logs: polled with an overlap, read as a stream of lines, and kept as a table that can be asked at any time."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chronolith.sources import logs
from chronolith.streaming.tail import current, drain, keep_batches

#: Digits of the time (microseconds), the place of the file's block, and the line's number that go before a landed line.
DIGITS = 20
KEYS = ["step", "training"]


def landed(time: Column, place: Column, no: Column, line: Column) -> Column:
    """A line behind its arrival; arrivals of later lines are larger strings."""
    return F.concat(*[F.concat(F.lpad(c.cast("string"), DIGITS, "0"), F.lit("|")) for c in (time, place, no)], line)


def poll(spark: SparkSession, source: str, landing: str, since: datetime.datetime | None = None, overlap: int = 1) -> datetime.datetime | None:
    """Copies the lines of the log files that changed after `since`, less `overlap` seconds, to new files below `landing`.

    Returns the newest change seen, for the next poll. Files that grew, and those that were only renamed within the overlap,
    come again as a whole; a reader that keeps the last line of each step is not disturbed. A line's arrival is its file's
    time and its place in the file, so lines of one file keep their order.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if since is not None:
        from_ = since - datetime.timedelta(seconds=overlap)
        reader = reader.option("modifiedAfter", from_.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    time = F.unix_micros("_metadata.file_modification_time")
    lines = reader.text(source).select(time.alias("time"), landed(time, F.col("_metadata.file_block_start"), F.monotonically_increasing_id(), F.col("value")).alias("value"))
    newest = lines.agg(F.max("time").alias("t")).first()["t"]
    if newest is None:
        return since
    lines.select("value").write.text(f"{landing}/poll-{uuid.uuid4().hex}")
    seen = datetime.datetime.fromtimestamp(newest / 1e6, datetime.UTC)
    return max(seen, since) if since else seen


def lines(spark: SparkSession, landing: str) -> DataFrame:
    """line, arrival of what was landed, as a stream of text."""
    width = 3 * (DIGITS + 1)
    rows = spark.readStream.option("recursiveFileLookup", True).text(landing)
    return rows.select(F.col("value").substr(F.lit(width + 1), F.length("value")).alias("line"), F.substring("value", 1, width).alias("arrival"))


def latest_steps(spark: SparkSession, landing: str) -> DataFrame:
    """The stream of the last line of every step and kind."""
    return logs.latest(logs.parse(lines(spark, landing)))


def tail(spark: SparkSession, landing: str, out: str) -> DataFrame:
    """Reads what has landed since the last call with the same `out`, and returns the log's table as it is now."""
    stream = latest_steps(spark, landing)
    drain(stream, out, "update")
    return current(spark, out, KEYS, stream.columns)


def serve(spark: SparkSession, landing: str, out: str) -> StreamingQuery:
    """Starts a stream that keeps the table at `out` up to date; metrics() may be asked meanwhile."""
    return keep_batches(latest_steps(spark, landing), out, "update").start()


def metrics(spark: SparkSession, out: str) -> DataFrame:
    """step, tokens_seen, training and validation loss side by side, as the stream has them at this moment."""
    columns = ["step", "training", "loss", "learning_rate", "gradient_norm", "seconds", "tokens_seen"]
    now = current(spark, out, KEYS, columns)
    of = lambda kind, c: F.max(F.when(F.col("training") == kind, F.col(c)))
    return now.groupBy("step").agg(of(True, "loss").alias("training_loss"), of(False, "loss").alias("validation_loss"), of(True, "learning_rate").alias("learning_rate"))
