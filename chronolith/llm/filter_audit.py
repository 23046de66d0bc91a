"""How five filters interact: what each order of them keeps, and each one's Shapley share of the removals.

A row's failures are a mask of five bits. The removals of a part are a game on sets of filters, and its multilinear extension,
the removal polynomial, follows from the counts of the masks: a row of mask m adds 1 - prod(1 - x_i for i in m). At the corners
of the cube the polynomial is the number of rows that a set of filters removes, so every order's survivors are read off there.
A filter's Shapley value is the integral of its partial derivative along the diagonal, taken with exact rationals.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import NOT_SPACE
from chronolith.shared import scratch, stored

FILTERS = "ABCDE"
CORNERS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts whose rows are made at once; each has 600.
PARTS = 100


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that decide on a text alone, as a long.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 2 % of the code points are A-Z. D: holds one of
    #$%&*|. Null counts as the empty text, which fails A only.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({NOT_SPACE})"), F.lit(1))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [F.size(words) < 200, F.size(F.array_distinct(words)) * 100 < F.size(words) * 50, capitals * 100 > F.length(text) * 2, text.rlike(r"[#$%&*|]")]
    mask = F.lit(0).cast("long")
    for k, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << k).otherwise(0)
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by their failures, and how many have such a label.

    Bit E: the text occurs with a smaller id anywhere in docs. Texts are the same where their SHA-256 is. Null ids are not
    compared and have no label; a label counts once however often it is given. Rows that repeat id and text are combined
    before any shuffle by text, and the join that finds first copies has the id in its key, so copies never meet in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_failures(F.col(text_col)).alias("mask"),
    )
    rows = stored(rows.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")), "failures")
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = rows.filter("id is not null").join(first, ["digest", "id"], "left")
    marked = marked.withColumn("mask", F.col("mask") + F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    marked = marked.join(known, "id", "left").select("part", "mask", "n", "good", "toxic")
    without = rows.filter("id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    each = [F.coalesce(F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return marked.unionByName(without).groupBy("part", "mask").agg(F.sum("n").alias("all"), *each).withColumnRenamed("all", "n")


def removal_polynomial(counts: np.ndarray) -> np.ndarray:
    """Coefficients int64[parts, 32] of prod(x_i for i in T), by the bits of T, from counts by mask."""
    out = np.zeros_like(counts)
    for m in range(1, CORNERS):
        t = m
        while t:  # every subset of m but the empty one
            out[:, t] += counts[:, m] * (1 if t.bit_count() & 1 else -1)
            t = (t - 1) & m
    return out


def at_corners(poly: np.ndarray) -> np.ndarray:
    """The polynomial's value at every corner of the cube: the rows that the filters of that corner remove together."""
    out = np.zeros_like(poly)
    for s in range(CORNERS):
        t = s
        while t:
            out[:, s] += poly[:, t]
            t = (t - 1) & s
    return out


def shapley_of_all_orders(poly: np.ndarray, k: int) -> np.ndarray:
    """120 times the integral over t of the derivative by x_k at (t, ..., t): removals by filter k summed over all orders."""
    total = np.zeros(len(poly), object)
    for t in range(CORNERS):
        if t >> k & 1:  # the derivative of this term has one factor less, so it is c * t**(size - 1) on the diagonal
            total = total + poly[:, t].astype(object) * Fraction(1, t.bit_count())
    return np.array([int(x * len(ORDERS)) for x in total], np.int64)


def _orders(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Columns int64[parts, 120, 5] of the audit."""
    poly = removal_polynomial(counts)
    gone, good_gone, toxic_gone = at_corners(poly), at_corners(removal_polynomial(good)), at_corners(removal_polynomial(toxic))
    bit = np.array([[1 << FILTERS.index(c) for c in order] for order in ORDERS])
    after = np.cumsum(bit, axis=1)
    before = after - bit
    shapley = np.stack([shapley_of_all_orders(poly, k) for k in range(len(FILTERS))], axis=1)
    removed = gone[:, after] - gone[:, before]
    return {
        "kept": counts.sum(axis=1)[:, None, None] - gone[:, after],
        "removed": removed,
        "redundant": gone[:, bit] - removed,
        "unique_fails": gone[:, -1][:, None, None] - gone[:, CORNERS - 1 - bit],
        "good_lost": good_gone[:, after] - good_gone[:, before],
        "toxic_lost": toxic_gone[:, after] - toxic_gone[:, before],
        "shapley": shapley[:, np.log2(bit).astype(int)],
    }


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of every part, order of the filters and step in it; zeros included.

    kept, removed: after and by the step's filter. redundant: fails it, but an earlier filter took the row. unique_fails: fails
    it alone. good_lost, toxic_lost: removed here with label quality or toxic 1. shapley: the filter's removals summed over
    all 120 orders. A null part counts as the empty string. An empty table gives an empty result; further columns, whatever
    their names, are not read. A part is at most 32 counts here, so its rows never meet.
    """
    with scratch(docs.sparkSession):
        counts = stored(mask_counts(docs, labels, id_col, text_col, part_col), "masks", keep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part = batch.slice(at, PARTS)
                table = np.zeros((3, part.num_rows, CORNERS), np.int64)
                for row, masks in enumerate(part.column("masks").to_pylist()):
                    for x in masks:
                        table[:, row, x["mask"]] = x["n"], x["good"], x["toxic"]
                found = _orders(*table)
                names = part.column("part").take(pa.array(np.repeat(np.arange(part.num_rows), len(ORDERS) * len(FILTERS))))
                orders = pa.array(np.tile(np.repeat(ORDERS, len(FILTERS)), part.num_rows))
                steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), part.num_rows * len(ORDERS)))
                yield pa.RecordBatch.from_arrays([names, orders, steps, *(pa.array(v.ravel()) for v in found.values())], names=["part", "filter_order", "step", *found])

    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    longs = ", ".join(f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return by_part.mapInArrow(run, f"part string, filter_order string, step int, {longs}")
