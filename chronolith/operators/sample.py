"""Deterministic samples: the k smallest hashes, overall or of each stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions.text import stripped, token_count


def eligible(text: Column, board: Column) -> Column:
    """20 to 500 characters, four words and more, no notice of a bot, and a board."""
    t = stripped(text)
    notice = F.lower(t).startswith("i am a bot") | F.lower(t).startswith("your post has been")
    return F.length(t).between(20, 500) & (token_count(t) >= 4) & ~notice & (F.coalesce(board, F.lit("")) != "")


def hash_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def bottom_k(df: DataFrame, strata: list[str], key: Column, k: int, out: str = "sample_rank") -> DataFrame:
    """The k rows of each stratum with the smallest keys. Rank limits prune before the shuffle, so a large stratum
    sends k rows per task."""
    w = Window.partitionBy(*strata).orderBy("__key", "id")
    return df.withColumn("__key", key).withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k).drop("__key")


def evenly_spaced(n: int, k: int) -> list[int]:
    """k of n places at equal distances, ends included; the middle one for k = 1. All where k is not below n."""
    if k <= 0 or k >= n:
        return list(range(n))
    return [n // 2] if k == 1 else [round(i * (n - 1) / (k - 1)) for i in range(k)]


def family_hits(rows: DataFrame, families: dict[str, str]) -> DataFrame:
    """rows once for each family whose pattern they match; one scan tests all patterns."""
    found = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in families.items()]), lambda x: x.isNotNull())
    return rows.withColumn("family", F.explode(found))


def range_pick(counts: DataFrame, key: str, n: str, draws: int, salt: str = "pick", cell: int = 4096) -> DataFrame:
    """i, pick, key, place: `draws` hashed picks among all counted items, and whose item each one is.

    The range join is an equi-join on cells of the running count: a key covers a cell or a few, a pick lies in one.
    """
    from chronolith.functions.text import hash_number
    from chronolith.operators.prefix import running_before

    bounds = running_before(counts, [key], n, "lo").withColumn("hi", F.col("lo") + F.col(n))
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    spark = counts.sparkSession
    picks = spark.range(draws if total else 0).select(F.col("id").alias("i"), F.pmod(hash_number(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string"))), F.lit(max(total, 1))).alias("pick"))
    cells = bounds.withColumn("cell", F.explode(F.expr(f"sequence(lo div {cell}, (hi - 1) div {cell})")))
    joined = picks.withColumn("cell", F.expr(f"pick div {cell}")).join(cells, "cell").filter("pick >= lo and pick < hi")
    return joined.select("i", "pick", key, (F.col("pick") - F.col("lo")).alias("place"))


def annual(posts: DataFrame, root: str, years: list[int], k: int) -> None:
    """Writes the sample of each year that is not below `root` yet: k posts of every board by hash, among the eligible ones."""
    spark = posts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    missing = [y for y in years if not fs.exists(path(f"{root}/year={y}/_done"))]
    if not missing:
        return
    rows = posts.filter(F.col("year").isin(*missing) & eligible(F.col("text"), F.col("subreddit")))
    picked = bottom_k(rows, ["year", "subreddit"], hash_key(F.col("year").cast("string"), F.col("id")), k)
    picked.select("id", "text", "subreddit", "created_utc", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(root)
    for y in missing:  # the mark comes after the data; a year without posts has one, too
        fs.mkdirs(path(f"{root}/year={y}"))
        fs.create(path(f"{root}/year={y}/_done"), True).close()


def read_annual(spark: SparkSession, root: str, years: list[int]) -> DataFrame:
    """The union of the samples of some years."""
    return spark.read.schema("id string, text string, subreddit string, created_utc long, year int").parquet(root).filter(F.col("year").isin(*years))


def report(before: DataFrame, after: DataFrame, scanned: DataFrame) -> DataFrame:
    """figure, key, n: rows before and after copies went, months scanned, and what is left by year and by board, in one pass."""
    sets = after.groupingSets([["year"], ["subreddit"], []], "year", "subreddit").agg(F.count("*").alias("n"), F.grouping("year").alias("no_year"), F.grouping("subreddit").alias("no_board"))
    figure = F.when(F.col("no_year") == 0, "year").when(F.col("no_board") == 0, "board").otherwise("after")
    key = F.when(F.col("no_year") == 0, F.col("year").cast("string")).when(F.col("no_board") == 0, F.col("subreddit")).otherwise("")
    one = lambda name, n: n.select(F.lit(name).alias("figure"), F.lit("").alias("key"), "n")
    months = scanned.select("year", "month").distinct().agg(F.count("*").alias("n"))
    return sets.select(figure.alias("figure"), key.alias("key"), "n").unionByName(one("before", before.agg(F.count("*").alias("n")))).unionByName(one("months", months))
