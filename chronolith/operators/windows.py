"""Token streams cut into overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.patterns import STRIDE
from chronolith.operators.prefix import running_before


def pack_windows(rows: DataFrame, part: list[str], order: list[str], n: str = "n", date: str = "created_utc") -> DataFrame:
    """part, window_no, documents, date of every full window of STRIDE + 1 tokens at every STRIDE tokens.

    rows carry their number of tokens. A stream of N tokens has (N - 1) div STRIDE windows; the date is the mean over the
    first STRIDE tokens, rounded half to even. No token is ever listed: a row meets the windows that it reaches.
    """
    placed = running_before(rows, order, n, "__at", part)
    totals = rows.groupBy(*part).agg(F.expr(f"(sum({n}) - 1) div {STRIDE}").alias("__windows"))
    met = placed.withColumn("window_no", F.explode(F.expr(f"sequence(__at div {STRIDE}, (__at + {n} - 1) div {STRIDE})")))
    share = F.least(F.col("__at") + F.col(n), STRIDE * (F.col("window_no") + 1)) - F.greatest(F.col("__at"), STRIDE * F.col("window_no"))
    sums = met.withColumn("__s", share * F.col(date)).groupBy(*part, "window_no").agg(F.count("*").alias("documents"), F.sum("__s").alias("__s"))
    full = sums.join(totals, part).filter("window_no < __windows")
    return full.select(*part, "window_no", "documents", F.bround(F.col("__s") / STRIDE, 0).cast("long").alias(date))
