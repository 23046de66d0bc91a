"""Time functions; all times are UTC seconds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolith.functions.patterns import STEP_TOKENS, TIME_END, TIME_START, YEAR_SECONDS


def moment(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def year(seconds: Column) -> Column:
    return F.year(moment(seconds))


def month(seconds: Column) -> Column:
    return F.month(moment(seconds))


def month_bounds(y: Column, m: Column) -> tuple[Column, Column]:
    """First second of a month and of the next."""
    start = F.make_date(y, m, F.lit(1))
    return F.unix_timestamp(start.cast("timestamp")), F.unix_timestamp(F.add_months(start, 1).cast("timestamp"))


def split_of(y: Column, first: int = 2011, validation: int = 2021, test: int = 2022) -> Column:
    """train, val or test by year; an error outside of all of them."""
    return F.when((y >= first) & (y < validation), "train").when(y == validation, "val").when(y == test, "test").otherwise(F.raise_error(F.concat(F.lit("no split for year "), y.cast("string"))))


def normalized(seconds: Column, start: int = TIME_START, end: int = TIME_END) -> Column:
    """0 at the start of training time, 1 at its end, beyond them unclipped."""
    return (seconds - start) / F.lit(float(end - start))


def parse(value: Column) -> Column:
    """Seconds of an ISO date or time; a bare year is its first of July."""
    full = F.when(F.length(value) == 4, F.concat(value, F.lit("-07-01"))).otherwise(value)
    return F.unix_timestamp(F.try_to_timestamp(full))


def elapsed_years(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(float(YEAR_SECONDS))


def tokens_seen(step: Column, training: Column) -> Column:
    return F.when(training, (step + 1) * STEP_TOKENS).otherwise(step * STEP_TOKENS)


def learning_rate(step: Column, warmup: int, steps: int, top: float, low: float) -> Column:
    """Linear warm-up, then half a cosine down to `low`."""
    done = (step - warmup) / F.lit(float(steps - warmup))
    return F.when(step < warmup, F.lit(top) * (step + 1) / warmup).when(step > steps, F.lit(low)).otherwise(F.lit(low) + 0.5 * (1 + F.cos(done * math.pi)) * (top - low))


def month_label(number: Column) -> Column:
    """Year and month of year * 12 + month - 1."""
    return F.format_string("%04d-%02d", F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"))
