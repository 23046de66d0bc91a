"""Queries over logs and streams."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.prefix import running_before
from chronolith.plans.registry import query
from chronolith.plans.rest import SHOWN_WINDOWS, shown_windows
from chronolith.shared import fresh_path, stored
from chronolith.sources import logs
from chronolith.sources.views import POSTS_SQL, posts, table
from chronolith.streaming import jobs, logtail, scan, tail, windows

LOG_SQL = """lines as (select event_id, 'step ' || (event_id % 500) || ' loss ' || format('{:.4f}', value) || ' lr ' || '3e-4' || ' norm ' || '0.5' || ' seconds ' || '1.25' as line from events),
  parsed as (select event_id, regexp_extract(line, 'step (\\d+) loss', 1)::bigint as step, regexp_extract(line, 'loss ([\\d.]+)', 1)::double as loss from lines where regexp_matches(line, 'step \\d+ loss [\\d.]+ lr'))"""
LATEST_SQL = f"with {LOG_SQL} select step, (step + 1) * 262144 as tokens_seen, arg_max(loss, event_id) as loss from parsed group by step"


@query("log_series", LATEST_SQL)
def log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(logs.parse(logs.event_lines(table(spark, sf_dir, "events")))).select("step", "tokens_seen", "loss")


@query("stream_log_tail", LATEST_SQL)
def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.log_tail(spark, f"{sf_dir}/events.parquet").select("step", "tokens_seen", "loss")


# A state is status * 100 + attempts * 10 + checks.
@query(
    "stream_partition_state",
    """with e as (select user_id as part, list(([1, 2, 3, 4, 3])[event_id % 5 + 1]::bigint order by event_id) as reports from events group by 1),
    s as (select part, list_reduce(list_prepend(0::bigint, reports), lambda s, r: case
      when s >= 200 then s
      when r = 1 then case when (s // 10) % 10 < 3 then 110 + s % 100 - s % 10 else 300 + s % 100 end
      when r = 2 then case when (s // 10) % 10 >= 3 then 300 else 0 end + s % 100 - s % 10
      when r = 3 then case when s % 10 < 1 then 101 + s % 100 else s % 100 - s % 10 end
      else 200 + s % 100 end) as s from e)
    select part, (['queued', 'running', 'complete', 'failed'])[s // 100 + 1] as status, (s // 10) % 10 as attempts, s % 10 as checks from s""",
)
def stream_partition_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.partition_states(spark, f"{sf_dir}/events.parquet")


@query("stream_window_counts", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.window_counts(spark, f"{sf_dir}/events.parquet")


@query("stream_packing", f"with {POSTS_SQL}, t as (select subreddit, sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 1)::bigint as tokens from posts group by 1) select subreddit, tokens, ((tokens - 1) // 1024)::bigint as windows, tokens - 1024 * ((tokens - 1) // 1024) as tail from t")
def stream_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.packing_state(spark, f"{sf_dir}/documents.parquet")



@query("stream_window_tokens", SHOWN_WINDOWS)
def stream_window_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in three instalments of time, packed by one stream that is started for each of them."""
    rows = posts(spark, sf_dir).select("id", "subreddit", "created_utc", "text")
    landing, out = fresh_path(spark, "arrived"), fresh_path(spark, "packed")
    span = F.expr("(created_utc - 1293840000) div 122716800").alias("span")
    for k in range(3):
        rows.filter(span == k).write.parquet(f"{landing}/part-{k}")
        arrived = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(landing)
        windows.packed_stream(arrived, ["subreddit"], ["created_utc", "id"], out)
    return shown_windows(windows.packed_windows(spark, out))


PARTS_SQL = "p as (select ts::date::varchar as day, event_type as kind from events group by all), n as (select *, row_number() over (order by day, kind) as no from p)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, kind, no (from 1) of the partitions that events make up, and the audit of each."""
    found = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("kind")).distinct()
    numbered = running_before(found.withColumn("one", F.lit(1)), ["day", "kind"], "one", "before").select("day", "kind", (F.col("before") + 1).alias("no"))
    return numbered.withColumn("status", F.when(F.col("no") % 7 == 0, "missing_source").otherwise("complete"))


AUDIT = "day string, kind string, no bigint, status string"


@query("scan_new_parts", f"with {PARTS_SQL} select day, kind, case when no % 3 > 0 then 1 else 2 end as run from n where no % 7 > 0 and not (no % 3 = 0 and no % 2 = 0)")
def scan_new_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of a folder of audits that grows between them, while some audits are written again and some partitions packed."""
    parts = _parts(spark, sf_dir)
    folder, packed, queue = (fresh_path(spark, x) for x in ("audits", "packed", "queue"))
    parts.filter("no < 0").write.parquet(f"{packed}/at=0")
    parts.filter("no % 3 > 0").write.json(f"{folder}/first")
    done = lambda: spark.read.schema(parts.schema).parquet(packed)
    scan.queue_new(scan.audits(spark, folder, AUDIT), ["day", "kind"], done(), queue)
    first = scan.queued(spark, queue).agg(F.max("batch").alias("b")).first()["b"]
    parts.filter("no % 3 = 0 or no % 4 = 1").write.json(f"{folder}/second")
    parts.filter("no % 3 = 0 and no % 2 = 0").write.parquet(f"{packed}/at=1")
    scan.queue_new(scan.audits(spark, folder, AUDIT), ["day", "kind"], done(), queue)
    return scan.queued(spark, queue).select("day", "kind", F.when(F.col("batch") <= first, 1).otherwise(2).alias("run"))


@query("launch_once", f"with {PARTS_SQL}, m as (select count(*) filter (no % 7 > 0) as present from n) select unnest(['launched', 'refused']) as state, 1::bigint as streams, present from m")
def launch_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams watch the same folder until its last audit is there; one of them launches."""
    parts = _parts(spark, sf_dir)
    wanted = parts.filter("status <> 'missing_source'").select("day", "kind")
    folder, out = fresh_path(spark, "audits"), fresh_path(spark, "launches")
    parts.filter("no > 1").write.json(f"{folder}/most")
    run = lambda who: scan.launch_once(scan.audits(spark, folder, AUDIT), ["day", "kind"], wanted, folder, f"{out}-marker", f"{out}-{who}", who)
    run("a")  # it waits
    parts.filter("no = 1").write.json(f"{folder}/last")
    with ThreadPoolExecutor(2) as both:
        list(both.map(run, "ab"))
    said = spark.read.parquet(f"{out}-a").unionByName(spark.read.parquet(f"{out}-b")).filter("state <> 'waiting'")
    return said.groupBy("state").agg(F.countDistinct("who").alias("streams"), F.max("present").alias("present"))


@query("stream_text_log", LATEST_SQL)
def stream_text_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text logs of eight runs that grow, are rotated once and go on, polled after each change."""
    lines = logs.event_lines(table(spark, sf_dir, "events")).withColumn("run", F.col("arrival") % 500 % 8)
    source, landing, out = (fresh_path(spark, x) for x in ("logs", "landing", "steps"))
    third = F.lit(lines.agg((F.max("arrival") / 3).alias("n")).first()["n"])

    def log(name: str, rows: DataFrame) -> None:
        rows.repartition("run").sortWithinPartitions("run", "arrival").select("line", "run").write.mode("overwrite").partitionBy("run").text(f"{source}/{name}")

    log("now", lines.filter(F.col("arrival") <= third))
    since = logtail.poll(spark, source, landing)
    logtail.tail(spark, landing, out)
    log("now", lines.filter(F.col("arrival") <= 2 * third))  # grown
    since = logtail.poll(spark, source, landing, since)
    logtail.tail(spark, landing, out)
    fs = spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(*[spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{x}") for x in ("now", "rotated")])
    log("now", lines.filter(F.col("arrival") > 2 * third))
    logtail.poll(spark, source, landing, since)
    return logtail.tail(spark, landing, out).filter("training").select("step", "tokens_seen", "loss")


@query(
    "metrics_table",
    """with v as (select event_id, event_id % 500 as step, event_id % 3 > 0 as training, format('{:.4f}', value)::double as loss from events), h as (select max(event_id) / 2 as half from events),
    l as (select b.batch, step, training, arg_max(loss, event_id) as loss from v, h, (values (1), (2)) b(batch) where event_id <= half or b.batch = 2 group by all)
    select batch, step, max(loss) filter (training) as training_loss, max(loss) filter (not training) as validation_loss from l group by all""",
)
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that a running stream keeps, asked after each of two batches of its log."""
    rows = table(spark, sf_dir, "events").select("event_id", F.format_string("%.4f", "value").alias("loss"), (F.col("event_id") % 500).cast("string").alias("step"))
    training = F.concat(F.lit("step "), "step", F.lit(" loss "), "loss", F.lit(" lr 3e-4 norm 0.5 seconds 1.25"))
    line = F.when(F.col("event_id") % 3 > 0, training).otherwise(F.concat(F.lit("validation step "), "step", F.lit(" loss "), "loss"))
    zero = F.lit(0)
    text = rows.select("event_id", logtail.landed(F.col("event_id"), zero, zero, line).alias("value"))
    half = rows.agg((F.max("event_id") / 2).alias("h")).first()["h"]
    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "metrics")
    text.filter(F.col("event_id") <= half).select("value").write.text(f"{landing}/one")
    running = logtail.serve(spark, landing, out)
    running.processAllAvailable()
    first = stored(logtail.metrics(spark, out), "snapshot")
    text.filter(F.col("event_id") > half).select("value").write.text(f"{landing}/two")
    running.processAllAvailable()
    second = stored(logtail.metrics(spark, out), "snapshot")
    running.stop()
    return first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2))).select("batch", "step", "training_loss", "validation_loss")
