"""Where a model comes in: score(rows, dates) as a plug-in, and the tables around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.tokens import word_ids
from chronolith.shared import fresh_name

#: Takes a batch of texts and one date for each, returns a number for each.
Scorer = Callable[[pd.Series, pd.Series], Sequence[float]]


def on_dates(rows: DataFrame, dates: Sequence[int]) -> DataFrame:
    """rows once for every date of a short list."""
    return rows.withColumn("date", F.explode(F.array(*[F.lit(int(d)).cast("long") for d in dates])))


def scored(rows: DataFrame, make: Callable[[], Scorer], text: str = "text", date: str = "date", out: str = "score") -> DataFrame:
    """rows plus a model's number. `make` runs once per task, on the worker; batches stay Arrow-sized."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            pdf[out] = list(model(pdf[text], pdf[date]))
            yield pdf

    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", {out} double")


def scored_by_length(rows: DataFrame, make: Callable[[], Scorer], text: str = "text", date: str = "date", out: str = "score", budget: int = 1 << 16, padded: str | None = None, order: list[str] | None = None) -> DataFrame:
    """rows plus a model's number, the model's batches being of nearly equal lengths.

    Rows are dealt by ranges of length and sorted inside; a batch goes on while its rows times its longest text stay within
    `budget` characters, so memory is bounded by padded size, and a longer text is a batch of its own. padded: a column for the
    length that each row was padded to. order: columns by which the result is sorted again. Null texts count as empty.
    """
    names, size = [*rows.columns], fresh_name("size", rows.columns, [out])
    sized = rows.withColumn(size, F.coalesce(F.length(text), F.lit(0)))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sized.repartitionByRange(n, size, *(order or [])).sortWithinPartitions(size, *(order or []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            sizes = pdf[size].to_numpy()
            at = 0
            while at < len(pdf):
                # Sizes rise, so the padded size of pdf[at : k + 1] is (k + 1 - at) * sizes[k].
                cost = np.arange(1, len(pdf) - at + 1) * np.maximum(sizes[at:], 1)
                many = max(1, int(np.searchsorted(cost, budget, "right")))
                part = pdf.iloc[at : at + many].copy()
                part[out] = list(model(part[text].fillna(""), part[date]))
                if padded:
                    part[padded] = int(sizes[at + many - 1])
                yield part.drop(columns=[size])
                at += many

    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"{out} double", *([f"{padded} bigint"] if padded else [])])
    made = dealt.mapInPandas(run, schema).select(*names, out, *([padded] if padded else []))
    return made.orderBy(*order) if order else made


def curves(scored_: DataFrame, key: str, date: str = "date", out: str = "score") -> DataFrame:
    """key, losses: the scores of each key in order of date."""
    return scored_.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(date, out))), lambda x: x[out]).alias("losses"))


def choices(items: DataFrame, tokenizer: Callable[[Column], Column] = word_ids) -> DataFrame:
    """ind, ending, tokens, mask: a row per possible ending of a multiple-choice item(ind, ctx, endings).

    tokens are the context's and those of a blank and the ending; mask is 1 for the ending's, over which a loss is taken.
    """
    rows = items.select("ind", tokenizer(F.col("ctx")).alias("context"), F.posexplode("endings").alias("ending", "tail"))
    tail = tokenizer(F.concat(F.lit(" "), "tail"))
    marks = F.concat(F.array_repeat(F.lit(0), F.size("context")), F.array_repeat(F.lit(1), F.size(tail)))
    return rows.select("ind", "ending", F.concat("context", tail).alias("tokens"), marks.alias("mask"))


def masked_losses(rendered: DataFrame, loss: Callable[[Column, Column], Column]) -> DataFrame:
    """ind, ending, total, mean: the sum and the mean of loss(token, place) over the places that the mask marks."""
    each = F.zip_with("tokens", "mask", lambda t, m: F.struct(t.alias("t"), m.alias("m")))
    kept = F.filter(F.transform(each, lambda x, i: F.when(x["m"] == 1, loss(x["t"], i))), lambda x: x.isNotNull())
    total = F.aggregate("kept", F.lit(0.0), lambda a, x: a + x)
    rows = rendered.select("ind", "ending", kept.alias("kept"))
    return rows.select("ind", "ending", total.alias("total"), F.try_divide(total, F.size("kept")).alias("mean"))


def accuracy(losses: DataFrame) -> DataFrame:
    """items, acc, acc_norm from ind, ending, label, total, mean: the ending with the least loss, summed and averaged."""
    best = losses.groupBy("ind", "label").agg(F.min_by("ending", F.struct("total", "ending")).alias("a"), F.min_by("ending", F.struct("mean", "ending")).alias("b"))
    hit = lambda c: F.avg((F.col(c) == F.col("label")).cast("double"))
    return best.agg(F.count("*").alias("items"), hit("a").alias("acc"), hit("b").alias("acc_norm"))


def contiguous_batches(rows: DataFrame, at: str, batch: int, length: int, ranks: int = 1) -> DataFrame:
    """rows plus step and rank: a stream of tokens read in contiguous batches by several readers in turn."""
    no = F.expr(f"{at} div {batch * length}")
    return rows.withColumn("step", F.expr(f"{at} div {batch * length * ranks}")).withColumn("rank", (no % ranks).cast("int"))


def singular_values(rows: DataFrame, vector: str) -> DataFrame:
    """no, value: singular values of the matrix of all rows' vectors, by their Gram matrix.

    A task adds up the Gram matrix of its rows and sends the upper half, so what is shuffled and collected depends on the
    dimension and the tasks, not on the rows. Null vectors and missing or null entries count as zeros; no rows, no values.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((0, 0))
        for batch in batches:
            lists = batch.column(0)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            m = np.zeros((len(size), size.max(initial=0)))
            m[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(pc.fill_null(pc.list_flatten(lists), 0.0))
            if m.shape[1] > len(gram):
                gram = np.pad(gram, (0, m.shape[1] - len(gram)))
            gram[: m.shape[1], : m.shape[1]] += m.T @ m
        for i in range(len(gram)):
            yield pa.record_batch([pa.array(np.full(len(gram) - i, i, np.int32)), pa.array(np.arange(i, len(gram), dtype=np.int32)), pa.array(gram[i, i:])], ["i", "j", "g"])

    halves = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(partial, "i int, j int, g double")
    entries = halves.groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    n = 1 + max((r["j"] for r in entries), default=-1)
    gram = np.zeros((n, n))
    for r in entries:
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["g"]
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 0)) if n else []
    return rows.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "no int, value double")
