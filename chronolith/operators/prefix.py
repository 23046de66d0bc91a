"""Running sums over an order, without the whole order meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.shared import fresh_name, stored

#: Rows of one bucket, about; there are never fewer buckets than shuffle partitions.
BUCKET_ROWS = 250_000
#: Rows up to which a part's order is one window.
FEW = 10_000


def running_before(df: DataFrame, order: list[str], value: str | dict[str, str], out: str = "", part: list[str] | None = None, buckets: int = 0) -> DataFrame:
    """df plus `out`: the sum of `value` over all rows that come before in `order` (inside `part`).

    value may also be {out: value} of several sums. Rows are dealt by ranges of part and the whole order, so one hot value
    of its first column, or one hot part, spans as many buckets as it needs. Sums form inside a bucket and over bucket
    totals; a task sees a bucket, or a part's bucket totals. Order columns must tell rows apart, else equal rows come in
    any order; part columns are not null.
    """
    values = value if isinstance(value, dict) else {out: value}
    part = part or []
    spark = df.sparkSession
    n = 0 if buckets else df.count()
    if not buckets and n <= FEW:
        here = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[(F.sum(v).over(here) - F.col(v)).alias(o) for o, v in values.items()])
    most = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS))
    bucket, inside, start = (fresh_name(x, df.columns, list(values)) for x in ("bucket", "inside", "start"))
    dealt = df.repartitionByRange(most, *part, *order).withColumn(bucket, F.spark_partition_id())
    rows = stored(dealt, "ordered", n or None)  # written, so that the ranges are the same wherever they are read
    totals = rows.groupBy(*part, bucket).agg(*[F.sum(v).alias(f"{start}_{k}") for k, v in enumerate(values.values())])
    over = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*part, bucket, *[F.coalesce(F.sum(f"{start}_{k}").over(over), F.lit(0)).alias(f"{start}_{k}") for k in range(len(values))])
    here = Window.partitionBy(*part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[(F.sum(v).over(here) - F.col(v)).alias(f"{inside}_{k}") for k, v in enumerate(values.values())])
    joined = rows.join(F.broadcast(starts) if not part else starts, [*part, bucket])
    return joined.select(*df.columns, *[(F.col(f"{start}_{k}") + F.col(f"{inside}_{k}")).alias(o) for k, o in enumerate(values)])


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df plus the average rank of `value`; ties share it. Only distinct values are ordered."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    same = fresh_name("value", df.columns, [out])
    ranked = running_before(counts, ["v"], "n", "before").select(F.col("v").alias(same), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranked, F.col(value).eqNullSafe(F.col(same))).drop(same)
