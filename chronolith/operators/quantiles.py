"""Exact quantiles by counting: ranges of values are counted until what holds a wanted rank is small, or is one value.

No task holds the values of a column or a group: a pass counts rows in CELLS ranges of each stretch that holds a wanted rank,
combined before the shuffle, and the range that holds it is the next pass's stretch. A stretch ends at values that occur, so
every pass parts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.shared import fresh_name, small, stored

#: Ranges of a stretch in one pass, and rows up to which a stretch is ordered instead.
CELLS, FEW = 1024, 20_000


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, n, q: the quantiles of a group's values, an array in the order of shares, linear between neighbouring values.

    Nulls and NaN are no values; groups without values have no row. Values are compared as doubles.
    """
    v, low, high, first, rank, cell, start, many = (fresh_name(x, keys) for x in ("v", "low", "high", "first", "rank", "cell", "start", "many"))
    rows = df.select(*keys, F.col(value).cast("double").alias(v)).filter(F.col(v).isNotNull() & ~F.isnan(v))
    # Null keys are a group, so keys are compared null-safely by their packed form.
    group = fresh_name("group", [*keys, v, low, high, first, rank, cell, start, many])
    rows = rows.withColumn(group, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit(""))
    ends = stored(rows.groupBy(group, *keys).agg(F.count("*").alias(many), F.min(v).alias(low), F.max(v).alias(high)), "ends")
    groups = ends.count()
    at = F.array(*[(F.lit(float(s)) * (F.col(many) - 1)) for s in shares])
    both = F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.least(F.floor(x) + 1, F.col(many) - 1))))
    open_ = ends.select(group, F.explode(F.array_distinct(both)).alias(rank), low, high, F.lit(0).cast("long").alias(first), many)
    values: list[DataFrame] = []
    most = ends.agg(F.max(many).alias("n")).first()["n"] or 0
    while most > FEW:
        stretches = open_.select(group, low, high, first).distinct()
        met = rows.select(group, v).join(small(stretches, groups * 2 * len(shares)), group).filter(F.col(v).between(F.col(low), F.col(high)))
        width = F.col(high) / 2 - F.col(low) / 2
        place = F.when(width > 0, F.least(F.floor(F.try_divide(F.col(v) / 2 - F.col(low) / 2, width) * CELLS), F.lit(CELLS - 1))).otherwise(0)
        counts = met.groupBy(group, first, place.alias(cell)).agg(F.count("*").alias(many), F.min(v).alias(low), F.max(v).alias(high))
        before = F.sum(many).over(Window.partitionBy(group, first).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))  # CELLS rows at most
        counts = counts.withColumn(start, F.col(first) + F.coalesce(before, F.lit(0)))
        hit = open_.select(group, rank, first).join(counts, [group, first]).filter((F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(start) + F.col(many)))
        last = F.col(rank) == F.col(start) + F.col(many) - 1
        done = F.when((F.col(low) == F.col(high)) | (F.col(rank) == F.col(start)), F.col(low)).when(last, F.col(high))
        hit = stored(hit.select(group, rank, low, high, F.col(start).alias(first), many, done.alias(v)), "ranks")
        values.append(hit.filter(F.col(v).isNotNull()).select(group, rank, v))
        open_ = hit.filter(F.col(v).isNull()).drop(v)
        most = open_.agg(F.max(many).alias("n")).first()["n"] or 0
    # Stretches of FEW rows at most: their rows are ordered.
    stretches = open_.select(group, low, high, first).distinct()
    met = rows.select(group, v).join(small(stretches, groups * 2 * len(shares)), group).filter(F.col(v).between(F.col(low), F.col(high)))
    placed = met.withColumn(rank, F.col(first) + F.row_number().over(Window.partitionBy(group, first).orderBy(v)) - 1)
    found = open_.select(group, rank, first).join(placed, [group, rank, first]).select(group, rank, v)
    for more in values:
        found = found.unionByName(more)
    by_rank = found.groupBy(group).agg(F.map_from_entries(F.collect_set(F.struct(rank, v))).alias("by_rank"))
    share = F.array(*[F.lit(float(s)) for s in shares])

    def between(s):
        at = s * (F.col(many) - 1)
        a, b = (F.try_element_at("by_rank", x) for x in (F.floor(at), F.least(F.floor(at) + 1, F.col(many) - 1)))
        return a + (b - a) * (at - F.floor(at))

    return ends.join(by_rank, group).select(*keys, F.col(many).alias("n"), F.transform(share, between).alias("q"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """The quantiles of a whole column, or nulls where it has no values."""
    found = grouped_quantiles(df, [], value, shares).first()
    return list(found["q"]) if found else [None] * len(shares)
