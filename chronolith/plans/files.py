"""Queries that write tables to the shared folder and read them back by their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import scoring, tokens
from chronolith.operators.clean import audit_flags
from chronolith.operators.prefix import running_before
from chronolith.plans.analysis import EDGE_SQL, _edges
from chronolith.plans.registry import query
from chronolith.plans.rest import SHOWN_WINDOWS, shown_windows
from chronolith.plans.streams import LATEST_SQL
from chronolith.shared import fresh_path
from chronolith.sources import files, logs
from chronolith.sources.views import POSTS_SQL, posts, table


def _dealt(key: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % n


@query(
    "shard_bytes",
    """with d as (select source, ('0x' || substr(md5(doc_id::varchar), 1, 4))::int % 5 as shard, strlen(replace(coalesce(text, ''), chr(10), ' ')) + 1 as bytes from documents),
    f as (select source, shard, sum(bytes) as bytes, row_number() over (partition by source order by shard) - 1 as no, count(*) over (partition by source) as n from d group by source, shard),
    t as (select *, n <= 3 or no in (0, round_even((n - 1) / 2, 0)::int, n - 1) as taken from f)
    select source as part, count(*) as files, sum(bytes)::bigint as bytes, count(*) filter (taken) as sampled_files, sum(bytes) filter (taken)::bigint as sampled_bytes from t group by 1""",
)
def shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text shards of each board, at most five: files and bytes there are, and those of three evenly spaced ones."""
    path = fresh_path(spark, "shards")
    rows = table(spark, sf_dir, "documents").select(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("line"), F.col("source").alias("part"), _dealt(F.col("doc_id"), 5).alias("shard"))
    rows.repartition("part", "shard").write.partitionBy("part", "shard").text(path)
    found = files.file_table(spark.read.text(path)).withColumn("part", F.regexp_extract("file", "/part=([^/]*)/", 1))
    return files.shard_bytes(found, ["part"], 3)


@query("scan_limit", "select count(*) as n, max(event_id) as last, round(sum(value), 4) as total from (select * from events order by event_id limit (select count(*) * 2 // 5 from events))")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two fifths of a table of eight files: files beyond are not opened, and the last one is read in part."""
    rows, path = table(spark, sf_dir, "events"), fresh_path(spark, "events")
    rows.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    made = files.first_rows(spark, path, rows.count() * 2 // 5, ["event_id", "value"])
    return made.agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.round(F.sum("value"), 4).alias("total"))


@query("length_batches", "select doc_id, length(coalesce(text, '')) + doc_id % 7 / 10.0 as score from documents")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored in batches of nearly equal lengths by a stand-in model, in their first order again."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 7).alias("date"))
    made = scoring.scored_by_length(rows, lambda: lambda text, date: text.str.len() + date / 10.0, budget=1 << 18, order=["doc_id"])
    return made.select("doc_id", "score")


@query("window_files", SHOWN_WINDOWS)
def window_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token windows written in files of 8,192 at most, and read again."""
    path = fresh_path(spark, "windows")
    files.write_windows(tokens.token_windows(posts(spark, sf_dir).select("id", "subreddit", "created_utc", "text"), ["subreddit"], ["created_utc", "id"]), path)
    return shown_windows(files.read_windows(spark, path, ["subreddit string"]))


@query(
    "token_shards",
    rf"""with {POSTS_SQL}, t as (select created_utc, id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 as n from posts),
    o as (select *, (sum(n) over (order by created_utc, id rows unbounded preceding) - n) // 50000 as shard from t)
    select case when shard = 0 then 'val' else 'train' end as split, count(distinct shard) as shards, count(*) as documents, sum(n)::bigint as tokens from o group by 1""",
)
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in shards of a running count, the first for validation, written by split and read again."""
    rows = posts(spark, sf_dir).select("id", "created_utc", F.concat(tokens.word_ids(F.col("text")), F.array(F.lit(0))).alias("ids")).withColumn("n", F.size("ids").cast("long"))
    path = fresh_path(spark, "tokens")
    files.write_token_shards(running_before(rows, ["created_utc", "id"], "n", "at"), "at", path, 50000)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"))


@query("path_months", f"with {POSTS_SQL} select year, month, count(*) as n, sum(length(text))::bigint as chars from posts where month in (3, 9) and year between 2015 and 2018 group by all")
def path_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under year/month, read by pattern for March and September of four years; the month comes from the path."""
    root, rows = fresh_path(spark, "months"), posts(spark, sf_dir)
    rows.select("id", "text", F.format_string("%04d", "year").alias("y"), F.format_string("%02d", "month").alias("m")).repartition("y", "m").write.partitionBy("y", "m").parquet(f"{root}-by")
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for year in fs.listStatus(path(f"{root}-by")):  # as many as there are months
        name = year.getPath().getName()
        for month in fs.listStatus(year.getPath()) if name.startswith("y=") else ():
            fs.mkdirs(path(f"{root}/{name[2:]}"))
            fs.rename(month.getPath(), path(f"{root}/{name[2:]}/{month.getPath().getName()[2:]}"))
    found = files.path_month(spark.read.schema("id string, text string").parquet(*[f"{root}/{y}/{{03,09}}" for y in range(2015, 2019)]))
    return found.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("json_tables", f"with {EDGE_SQL} select child, parent, round(cosine, 6) as cosine from edge")
def json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links written as JSON lines and read again under a declared schema."""
    path = fresh_path(spark, "edges")
    files.write_jsonl(_edges(spark, sf_dir).select("child", "parent", F.round("cosine", 6).alias("cosine")), path)
    return files.read_jsonl(spark, path, "child bigint, parent bigint, cosine double")


@query("csv_losses", "select event_type as kind, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def csv_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of losses written as CSV with its header, and read by it."""
    path = fresh_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "value"), path)
    back = spark.read.schema("event_id bigint, kind string, value double").option("header", True).option("enforceSchema", False).csv(path)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("batch_log", LATEST_SQL)
def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text logs of eight runs, read as files."""
    path = fresh_path(spark, "logs")
    lines = logs.event_lines(table(spark, sf_dir, "events")).withColumn("run", F.col("arrival") % 500 % 8)
    lines.repartition("run").sortWithinPartitions("run", "arrival").select("line", "run").write.partitionBy("run").text(path)
    return logs.latest(logs.parse(logs.read(spark, path))).select("step", "tokens_seen", "loss")


@query(
    "clean_files",
    f"with {POSTS_SQL}, b as (select max(year) as y from posts) select year, month, count(*) as n, sum((length(text) > 200)::int)::bigint as long_texts from posts, b where year = y group by all",
)
def clean_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table written twice by partition with its audit, and its last year read by partitions that the audit names."""
    rows, root = posts(spark, sf_dir), fresh_path(spark, "clean")
    clean = rows.select("id", "subreddit", "created_utc", "text", "year", "month", "kind")
    audit = clean.groupBy("year", "month", "kind").agg(F.count("*").alias("kept"))
    for _ in range(2):
        files.write_clean(clean, f"{root}/data", audit, f"{root}/audit")
    done = spark.read.json(f"{root}/audit")
    last = done.agg(F.max("year").alias("y")).first()["y"]
    read = files.read_parts(spark, f"{root}/data", years=[last])
    made = read.groupBy("year", "month", "kind").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 200).alias("long_texts"))
    return made.join(done, ["year", "month", "kind"]).filter(F.col("n") == F.col("kept")).select("year", "month", "n", "long_texts")


@query(
    "file_audit",
    f"""with {POSTS_SQL}, f as (select id, subreddit, text, ('0x' || substr(md5(id), 1, 4))::int % 4 as shard, row_number() over (partition by subreddit, ('0x' || substr(md5(id), 1, 4))::int % 4 order by id) - 1 as row from posts),
    n as (select subreddit, shard, count(*) as rows, row_number() over (partition by subreddit order by shard) - 1 as no, count(*) over (partition by subreddit) as files from f group by subreddit, shard),
    c as (select subreddit, shard, rows from n where no = ('0x' || substr(md5('audit:' || subreddit), 1, 8))::bigint % files),
    s as (select f.*, rows from f join c using (subreddit, shard) qualify row_number() over (partition by subreddit order by md5('audit:' || row), row) <= 12)
    select subreddit, any_value(rows) as rows_in_file, count(*) as sampled, count(*) filter (length(text) > 12000 or regexp_matches(text, '(?i)!\\[[^]]*\\]\\([^)]*\\)|<img\\b')) as flagged, string_agg(id, ',' order by id) as ids from s group by 1""",
)
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of each board by a seed, and of it twelve rows, looked through for what cleaning should have removed."""
    path = fresh_path(spark, "clean")
    rows = posts(spark, sf_dir).select("id", "subreddit", "text", F.col("subreddit").alias("part")).withColumn("shard", _dealt(F.col("id"), 4))
    rows.repartition("part", "shard").sortWithinPartitions("part", "shard", "id").write.partitionBy("part", "shard").parquet(path)
    found = files.file_table(spark.read.parquet(path)).withColumn("part", F.regexp_extract("file", "/part=([^/]*)/", 1))
    chosen = files.one_file_each(found, ["part"], "audit")
    sampled = files.sampled_rows(spark, chosen, ["part"], "audit", 12, "id string, subreddit string, text string")
    flagged = F.size(F.filter(audit_flags(F.col("text")), lambda x: x.isin("too_long", "image_markup"))) > 0
    made = sampled.join(chosen.select("part", "rows"), "part").groupBy("subreddit").agg(F.first("rows").alias("rows_in_file"), F.count("*").alias("sampled"), F.count_if(flagged).alias("flagged"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    return made
