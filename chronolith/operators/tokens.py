"""Token windows through a tokenizer that is passed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.patterns import STRIDE
from chronolith.functions.text import tokens
from chronolith.operators.prefix import running_before

Tokenizer = Callable[[Column], Column]


def word_ids(text: Column) -> Column:
    """A stand-in tokenizer: a word's id are 16 bits of its digest. Others, such as an Arrow UDF, give array<int> too."""
    return F.transform(tokens(text), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int"))


def token_windows(rows: DataFrame, part: list[str], order: list[str], text: str = "text", date: str = "created_utc", tokenizer: Tokenizer = word_ids, end: int = 0, stride: int = STRIDE) -> DataFrame:
    """part, window_no, tokens (stride + 1 ids), date of every full window at every `stride` tokens of a part's stream.

    A row's ids are followed by `end`. The date is the mean over the first `stride` tokens, rounded half to even. What a
    window is made of are slices of its rows, so a row is sent once for each window that it reaches and a window meets in
    one task.
    """
    ids = F.concat(tokenizer(F.col(text)), F.array(F.lit(end)))
    made = rows.select(*part, *order, *[c for c in [date] if c not in order], ids.alias("ids")).withColumn("n", F.size("ids").cast("long"))
    placed = running_before(made, order, "n", "at", part)
    totals = placed.groupBy(*part).agg(F.expr(f"(sum(n) - 1) div {stride}").alias("windows"))
    # The last id of a window is the first of the next: a row that begins there belongs to the one before, too.
    met = placed.withColumn("window_no", F.explode(F.expr(f"sequence(greatest(0L, (at - 1) div {stride}), (at + n - 1) div {stride})")))
    begin, stop = F.greatest(F.col("at"), F.col("window_no") * stride), F.least(F.col("at") + F.col("n"), (F.col("window_no") + 1) * stride + 1)
    met = met.withColumn("begin", begin).withColumn("many", stop - begin).filter("many > 0")
    share = F.least(F.col("begin") + F.col("many"), (F.col("window_no") + 1) * stride) - F.col("begin")
    piece = F.struct("begin", F.slice("ids", (F.col("begin") - F.col("at") + 1).cast("int"), F.col("many").cast("int")).alias("ids"))
    groups = met.groupBy(*part, "window_no").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum(share * F.col(date)).alias("dates"))
    full = groups.join(totals, part).filter("window_no < windows")
    return full.select(*part, "window_no", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("tokens"), F.bround(F.col("dates") / stride, 0).cast("long").alias(date))


def last_ids(ids: Column, k: int = 64) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - k, F.lit(0)) + 1, F.lit(k))


def first_ids(ids: Column, k: int = 128) -> Column:
    return F.slice(ids, F.lit(1), F.lit(k))


def top_ids(rows: DataFrame, keys: list[str], ids: str, k: int = 50) -> DataFrame:
    """keys, token, n, place: the k most frequent tokens of each key, ties to the smaller one."""
    from pyspark.sql import Window

    counts = rows.select(*keys, F.explode(ids).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "token")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
