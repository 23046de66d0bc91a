"""Readers and writers of the corpus: partitions, windows, audits, tables for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from chronolith.functions.text import hash_number
from chronolith.operators.sample import evenly_spaced

CLEAN = S.StructType(
    [S.StructField(n, S.LongType() if n in ("created_utc", "score") else S.StringType()) for n in ("id", "kind", "subreddit", "created_utc", "text", "score", "thread_id", "parent_id")]
)


def read_parts(spark: SparkSession, root: str, years: list[int] | None = None, months: list[int] | None = None) -> DataFrame:
    """The clean table of some years and months; other partitions' files are not opened."""
    df = spark.read.parquet(root)
    if years is not None:
        df = df.filter(F.col("year").isin(*years))
    return df if months is None else df.filter(F.col("month").isin(*months))


def shards(df: DataFrame, most: int = 0) -> list[str]:
    """Sorted file names behind df, or `most` of them at even distances."""
    files = sorted(df.inputFiles())
    return [files[k] for k in evenly_spaced(len(files), most)] if most else files


def file_table(df: DataFrame) -> DataFrame:
    """file, bytes, rows of every file behind a source DataFrame; of Parquet files only the footers are read for it."""
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    return df.select(*at).groupBy("file", "bytes").agg(F.count("*").alias("rows"))


def shard_bytes(files: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, files, bytes, sampled_files, sampled_bytes: what is there of each partition, and in `most` shards of it.

    files: file_table() with the partition's keys. The sampled shards lie at even distances in the order of their paths, both
    ends included; the middle one if `most` is 1, all if there are no more.
    """
    w = Window.partitionBy(*keys)
    placed = files.withColumn("no", F.row_number().over(w.orderBy("file")) - 1).withColumn("n", F.count("*").over(w))
    if most == 1:
        taken = F.col("no") == F.expr("n div 2")
    else:
        spaced = F.transform(F.sequence(F.lit(0), F.lit(max(most - 1, 0))), lambda i: F.bround(i * (F.col("n") - 1) / max(most - 1, 1), 0).cast("long"))
        taken = F.lit(most <= 0) | (F.col("n") <= most) | F.array_contains(spaced, F.col("no").cast("long"))
    placed = placed.withColumn("taken", taken)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("taken"), c)), F.lit(0))
    return placed.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), of(F.lit(1)).alias("sampled_files"), of(F.col("bytes")).alias("sampled_bytes"))


def one_file_each(files: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """keys, file, rows: one file of each partition, chosen by a hash of the seed and the partition; empty files are not there."""
    w = Window.partitionBy(*keys)
    placed = files.withColumn("no", F.row_number().over(w.orderBy("file")) - 1).withColumn("n", F.count("*").over(w))
    pick = hash_number(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys])) % F.col("n")
    return placed.filter(F.col("no") == pick).select(*keys, "file", "rows")


def sampled_rows(spark: SparkSession, chosen: DataFrame, keys: list[str], seed: str, k: int, schema: str) -> DataFrame:
    """keys, row and the columns of `schema` of k rows of each chosen Parquet file, by a hash of seed and row number.

    Only the chosen files are opened, and rank limits keep k rows of each before anything is shuffled.
    """
    files = [r["file"] for r in chosen.select("file").collect()]  # one for each partition
    if not files:
        return spark.createDataFrame([], f"row bigint, {schema}")
    rows = spark.read.schema(schema).parquet(*files).select("*", F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_path").alias("file"))
    turn = Window.partitionBy("file").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("row").cast("string")).cast("binary")), "row")
    picked = rows.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= k)
    return picked.join(chosen.select(*keys, "file"), "file").drop("file", "turn")


def first_rows(spark: SparkSession, path: str, limit: int, columns: list[str] | None = None, look: int = 1) -> DataFrame:
    """The first `limit` rows of a Parquet table in the order of its files' paths and of the rows in them.

    Files are counted by their footers, `look` of them first and twice as many each time, until they hold enough; of the last
    one only the leading rows are taken. Files beyond are never opened.
    """
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles())
    pick = lambda names: spark.read.schema(whole.schema).parquet(*names)
    taken, left, at = [], limit, 0
    while left > 0 and at < len(files):
        some = files[at : at + look]
        counted = {r["file"]: r["rows"] for r in file_table(pick(some)).collect()}
        # A path may be written with or without escapes; a file without rows is in no group.
        by_name = {f.rsplit("/", 2)[-1]: n for f, n in counted.items()}
        for f in some:
            n = by_name.get(f.rsplit("/", 2)[-1], 0)
            if left > 0 and n:
                taken.append((f, min(n, left), n))
                left -= min(n, left)
        at, look = at + len(some), look * 2
    out = pick([f for f, _, _ in taken[:-1]]) if len(taken) > 1 else None
    if taken:
        f, wanted, n = taken[-1]
        last = pick([f]) if wanted == n else pick([f]).filter(F.col("_metadata.row_index") < wanted)
        out = out.unionByName(last) if out is not None else last
    else:
        out = whole.limit(0)
    return out.select(*columns) if columns else out


def write_clean(df: DataFrame, root: str, audit: DataFrame | None = None, audit_root: str | None = None) -> None:
    """Partitioned zstd Parquet first, its audit after it: an audit is there only if its data is."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month", "kind").parquet(root)
    if audit is not None:
        # One audit for each partition, also after a rerun.
        audit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "kind").json(audit_root or f"{root.rstrip('/')}_audit")


def missing_sources(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """A marker for every expected partition that has no source."""
    return expected.join(present.select(*keys).distinct(), keys, "left_anti").withColumn("status", F.lit("missing_source"))


def path_month(df: DataFrame) -> DataFrame:
    """df plus year and month from paths like .../2018/03/submissions.parquet."""
    at = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(at, r"/(\d{4})/(\d{2})/", 1).cast("int").alias("year"), F.regexp_extract(at, r"/(\d{4})/(\d{2})/", 2).cast("int").alias("month"))


def write_windows(windows: DataFrame, path: str, per_file: int = 8192) -> None:
    windows.write.option("maxRecordsPerFile", per_file).parquet(path)


def read_windows(spark: SparkSession, path: str, keys: list[str], date: str = "created_utc") -> DataFrame:
    """Windows that write_windows() has written; keys as in 'subreddit string'."""
    return spark.read.schema(", ".join([*keys, "window_no bigint", "tokens array<int>", f"{date} bigint"])).parquet(path)


def write_token_shards(rows: DataFrame, at: str, path: str, size: int) -> None:
    """rows in shards of `size` tokens by their running count `at`; the first shard is for validation, the others for training."""
    shard = F.expr(f"{at} div {size}")
    split = F.when(shard == 0, "val").otherwise("train")
    dealt = rows.withColumn("shard", shard).withColumn("split", split)
    dealt.repartition("split", "shard").sortWithinPartitions("shard", at).write.partitionBy("split", "shard").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in the order of (part, key), range-partitioned, so the files in name order are the document."""
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.text(path)


def audit_report(rows: DataFrame, keys: list[str], reason: str = "reason") -> DataFrame:
    """keys, counts, by_board, examples: the audit of a cleaning run, one row per partition."""
    counts = rows.groupBy(*keys, reason).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "n")))).alias("counts"))
    boards = rows.filter(F.col(reason) == "kept").groupBy(*keys, "subreddit").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("subreddit", "n")))).alias("by_board"))
    w = Window.partitionBy(*keys, reason).orderBy("created_utc", "id")
    first = rows.filter(F.col(reason) != "kept").withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    shown = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(reason, "rn", "id", F.substring("text", 1, 180).alias("text")))).alias("examples"))
    return counts.join(boards, keys, "left").join(shown, keys, "left")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
