"""Queries of manifests, model tables and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import manifest, scoring
from chronolith.plans.analysis import EDGE_SQL, TFIDF_SQL, _edges, _text_links, lex_docs_sql
from chronolith.plans.registry import query
from chronolith.shared import stored
from chronolith.sources.views import table, vectors


@query(
    "expected_partitions",
    """with o as (select min(year(o_orderdate)) as low, max(year(o_orderdate)) as high, max(o_orderdate) as last from orders)
    select y::int as year, m::int as month, k as kind from o, unnest(range(low, high + 1)) a(y), range(1, 13) b(m), (values ('submissions'), ('comments')) c(k) where y < high or m <= month(last)""",
)
def expected_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month from the first year of the table to its last month, of both kinds."""
    ends = table(spark, sf_dir, "orders").agg(F.year(F.min("o_orderdate")).alias("low"), F.year(F.max("o_orderdate")).alias("high"), F.month(F.max("o_orderdate")).alias("month")).first()
    return manifest.expected(spark, ends["low"], ends["high"], ends["month"])


PACKED = """p as (select year(o_orderdate)::int as year, month(o_orderdate)::int as month, 2 as version, count(*) as windows, count(o_totalprice) filter (o_orderkey > 40) as rows_,
  min(epoch(o_orderdate))::bigint as first, max(epoch(o_orderdate))::bigint as last from orders group by all)"""


@query(
    "manifest_reasons",
    f"""with {PACKED}, w as (select y::int as year, m::int as month from range(1994, 2003) a(y), range(1, 13) b(m)),
    c as (select year, month, case when month = 2 and year = 1996 then 'missing_source' else 'ok' end as status from w where year <= 2001)
    select w.year, w.month, case when status = 'missing_source' then 'missing source' when status is null then 'not cleaned' when p.version is null then 'not packed'
      when windows <> rows_ then 'window counts differ' end as reason from w left join c using (year, month) left join p using (year, month)""",
)
def manifest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("s", F.unix_timestamp("o_orderdate")).withColumn("year", F.year("o_orderdate")).withColumn("month", F.month("o_orderdate"))
    packed = o.groupBy("year", "month").agg(F.lit(2).alias("version"), F.count("*").alias("windows"), F.count_if(F.col("o_orderkey") > 40).alias("rows"), F.min("s").alias("first"), F.max("s").alias("last"))
    packed = packed.withColumn("start", F.unix_timestamp(F.make_date("year", "month", F.lit(1)).cast("timestamp"))).withColumn("stop", F.unix_timestamp(F.add_months(F.make_date("year", "month", F.lit(1)), 1).cast("timestamp")))
    wanted = spark.range(1994, 2003).select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    clean = wanted.filter("year <= 2001").withColumn("status", F.when((F.col("month") == 2) & (F.col("year") == 1996), "missing_source").otherwise("ok"))
    return manifest.reasons(wanted, clean, packed, ["year", "month"])


@query("edge_attributes", f"with {EDGE_SQL} select child, edge.parent, c.family as child_family, p.family as parent_family, (['zero','one','two','three','four','five','six','seven','eight','nine'])[c.family + 1] as motif from edge join u c on c.id = child join u p on p.id = edge.parent")
def edge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = vectors(spark, sf_dir).select("id", "family")
    names = spark.createDataFrame(list(enumerate("zero one two three four five six seven eight nine".split())), "child_family int, motif string")
    e = _edges(spark, sf_dir).select("child", "parent")
    e = e.join(f.withColumnsRenamed({"id": "child", "family": "child_family"}), "child").join(f.withColumnsRenamed({"id": "parent", "family": "parent_family"}), "parent")
    return e.join(F.broadcast(names), "child_family").select("child", "parent", "child_family", "parent_family", "motif")  # ten names


@query(
    "low_overlap_links",
    f"""with {EDGE_SQL}, {lex_docs_sql('where id in (select id from u)')}, {TFIDF_SQL},
    own as (select edge.child, edge.parent, sum(a.w * b.w) as lexical from edge join wt a on a.id = edge.child join wt b on b.id = edge.parent and b.term = a.term group by all)
    select edge.child, edge.parent, round(coalesce(lexical, 0), 6) as lexical from edge left join own on own.child = edge.child and own.parent = edge.parent
    where fc <> fp and round(coalesce(lexical, 0), 9) < 0.12""",
)
def low_overlap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = vectors(spark, sf_dir).select("id", "family")
    e = _edges(spark, sf_dir).join(f.withColumnsRenamed({"id": "child", "family": "fc"}), "child").join(f.withColumnsRenamed({"id": "parent", "family": "fp"}), "parent").filter("fc <> fp")
    e = stored(e.select("child", "parent"), "links")
    e = e.join(_text_links(spark, sf_dir, e), ["child", "parent"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0))).filter(F.round("lexical", 9) < 0.12)
    return e.select("child", "parent", F.round("lexical", 6).alias("lexical"))


@query(
    "date_sweep",
    """with g as (select o_orderkey, d, abs(epoch(o_orderdate)::bigint - (788918400 + d * 15778800)) / 1e9 as loss from orders, range(13) r(d))
    select o_orderkey, arg_min(d, {'l': round(loss, 9), 'd': d})::bigint as best, round(avg(loss), 6) as mean_loss, count(*) as dates from g group by 1""",
)
def date_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer on every order's time at 13 dates, through the model's plug-in."""
    w = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("t"))
    dates = [788918400 + d * 15778800 for d in range(13)]
    made = scoring.scored(scoring.on_dates(w, dates), lambda: lambda t, d: (t - d).abs() / 1e9, text="t")
    no = F.expr("(date - 788918400) div 15778800")
    return made.groupBy("o_orderkey").agg(F.min_by(no, F.struct(F.round("score", 9), no)).alias("best"), F.round(F.avg("score"), 6).alias("mean_loss"), F.count("*").alias("dates"))


@query("contiguous_batches", "select l_orderkey, l_linenumber, ((l_orderkey * 8 + l_linenumber) // 2048)::bigint as step, (((l_orderkey * 8 + l_linenumber) // 512) % 4)::int as rank from lineitem")
def contiguous_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return scoring.contiguous_batches(rows, "at", 8, 64, 4).drop("at")


@query("probe_wins", "select l_returnflag as kind, count(*) filter (l_extendedprice > l_quantity * 900) as literal_wins, count(*) filter (l_discount > l_tax) as paraphrase_wins, count(*) as probes from lineitem group by 1")
def probe_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"))
    return rows.agg(F.count_if(F.col("l_extendedprice") > F.col("l_quantity") * 900).alias("literal_wins"), F.count_if(F.col("l_discount") > F.col("l_tax")).alias("paraphrase_wins"), F.count("*").alias("probes"))


@query("singular_values")
def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.singular_values(vectors(spark, sf_dir), "embedding")


@query("step_series", "pivot (select day(ts)::int as step, event_type as kind, value from events) on kind in ('click', 'view', 'purchase') using round(avg(value), 6) group by step")
def step_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("step"), F.col("event_type").alias("kind"), "value")
    return rows.groupBy("step").pivot("kind", ["click", "view", "purchase"]).agg(F.round(F.avg("value"), 6))
