"""Training logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import patterns as P
from chronolith.functions.timeutil import tokens_seen


def read(spark: SparkSession, path: str) -> DataFrame:
    """line, arrival: lines of text logs; arrival is the file's time and place of the line."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.struct(F.col("_metadata.file_modification_time").alias("time"), F.monotonically_increasing_id().alias("no")).alias("arrival"))


def event_lines(events: DataFrame) -> DataFrame:
    """The events table rendered as a training log, 500 steps logged again and again."""
    line = F.concat(F.lit("step "), (F.col("event_id") % 500).cast("string"), F.lit(" loss "), F.format_string("%.4f", "value"), F.lit(" lr 3e-4 norm 0.5 seconds 1.25"))
    return events.select(line.alias("line"), F.col("event_id").alias("arrival"))


def parse(lines: DataFrame) -> DataFrame:
    """step, training, loss, learning_rate, gradient_norm, seconds, tokens_seen, arrival of lines that are log lines."""
    number = lambda p, k, kind: F.nullif(F.regexp_extract("line", p, k), F.lit("")).try_cast(kind)
    is_train, is_val = F.col("line").rlike(P.TRAIN_LINE), F.col("line").rlike(P.VALIDATION_LINE)
    rows = lines.filter(is_train | is_val).withColumn("training", is_train)
    pick = lambda k, kind: F.when(F.col("training"), number(P.TRAIN_LINE, k, kind)).otherwise(number(P.VALIDATION_LINE, k, kind) if k <= 2 else F.lit(None).cast(kind))
    rows = rows.select(pick(1, "long").alias("step"), "training", pick(2, "double").alias("loss"), pick(3, "double").alias("learning_rate"), pick(4, "double").alias("gradient_norm"), pick(5, "double").alias("seconds"), "arrival")
    return rows.withColumn("tokens_seen", tokens_seen(F.col("step"), F.col("training")))


def latest(parsed: DataFrame) -> DataFrame:
    """One row per step and kind: what arrived last."""
    return parsed.groupBy("step", "training").agg(F.max_by(F.struct("loss", "learning_rate", "gradient_norm", "seconds", "tokens_seen"), "arrival").alias("r")).select("step", "training", "r.*")
