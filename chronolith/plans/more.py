"""Further queries: set operations, schedules, audits and sampling operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import patterns as P
from chronolith.functions import text as T
from chronolith.functions import timeutil
from chronolith.operators import clean
from chronolith.plans.corpus import REASON
from chronolith.operators.quantiles import grouped_quantiles
from chronolith.plans.registry import query
from chronolith.sources.files import audit_report
from chronolith.sources.views import POSTS_SQL, posts, table


@query(
    "sample_report",
    f"with {POSTS_SQL} select year, subreddit, count(*) as eligible, count(distinct md5(lower(text))) as texts from posts group by grouping sets ((year), (subreddit), ())",
)
def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("year", "subreddit", F.md5(F.lower("text").cast("binary")).alias("h"))
    return rows.groupingSets([["year"], ["subreddit"], []], "year", "subreddit").agg(F.count("*").alias("eligible"), F.countDistinct("h").alias("texts"))


@query("learning_rate", "select i as step, round(case when i < 100 then 6e-4 * (i + 1) / 100 when i > 900 then 6e-5 else 6e-5 + 0.5 * (1 + cos(pi() * (i - 100) / 800)) * (6e-4 - 6e-5) end, 12) as lr from (select distinct event_id % 1000 as i from events)")
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at every step that the log has."""
    steps = table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("step")).distinct()
    return steps.select("step", F.round(timeutil.learning_rate(F.col("step"), 100, 900, 6e-4, 6e-5), 12).alias("lr"))


@query("nodes_of_edges", "select l_orderkey as id from lineitem where l_quantity > 45 union select l_partkey from lineitem where l_quantity > 45")
def nodes_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    return rows.select(F.col("l_orderkey").alias("id")).union(rows.select("l_partkey")).distinct()


@query("split_union", "select 'val' as split, o_orderkey, o_totalprice from orders where year(o_orderdate) = 2000 union all select 'test', o_orderkey, o_totalprice from orders where year(o_orderdate) > 2000")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    part = lambda name, test: rows.filter(test).select(F.lit(name).alias("split"), "o_orderkey", "o_totalprice")
    return part("val", "y = 2000").unionByName(part("test", "y > 2000"))


@query("expected_minus_done", "select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def expected_minus_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").distinct().join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    "clean_audit",
    f"""with {POSTS_SQL}, r as (select year, subreddit, {REASON} as reason from posts)
    select year, count(*) filter (reason = 'kept') as kept, count(*) filter (reason <> 'kept') as rejected, count(*) as raw, count(distinct subreddit) filter (reason = 'kept') as boards from r group by 1""",
)
def clean_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).withColumn("reason", clean.reason(F.col("text")))
    audit = audit_report(rows, ["year"])
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, x: s + x)
    kept = F.coalesce(F.try_element_at("counts", F.lit("kept")), F.lit(0).cast("long"))
    return audit.select("year", kept.alias("kept"), (total - kept).alias("rejected"), total.alias("raw"), F.coalesce(F.size("by_board"), F.lit(0)).cast("long").alias("boards"))


@query(
    "token_totals",
    rf"""select source as subreddit, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::bigint as tokens, count(*) as documents from documents group by rollup (source)""",
)
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("subreddit"), T.token_count(F.col("text")).alias("n"))
    return rows.rollup("subreddit").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"))


@query("graph_cleaning", rf"""with {POSTS_SQL}, w as (select *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+') as ws from posts),
    m as (select id, max(c) as top from (select id, w, count(*) as c from (select id, unnest(ws) as w from w) group by all) group by 1),
    r as (select w.id, case when regexp_matches(text, '(?i)https?://|www\.|(?:reddit|imgur)\.com/') then 'url' when regexp_matches(text, '{P.SPAM}') then 'bot_or_spam'
      when (length(text) - length(regexp_replace(text, '\p{{Mn}}', '', 'g'))) / length(text) > 0.03 then 'combining_mark_artifact'
      when len(ws) >= 8 and top / len(ws) >= 0.5 then 'single_word_repetition' else 'kept' end as reason from w left join m using (id))
    select reason, count(*) as n from r group by 1""")
def graph_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:


    text = F.col("text")
    reason = F.when(text.rlike(P.LINK), "url").when(text.rlike(P.SPAM), "bot_or_spam").when(T.mark_share(text) > 0.03, "combining_mark_artifact").when(T.top_word_share(text) >= 0.5, "single_word_repetition").otherwise("kept")
    return posts(spark, sf_dir).select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("median_throughput", "select l_returnflag as kind, round(median(l_extendedprice / l_quantity), 6) as median_rate, round(avg(l_extendedprice / l_quantity), 6) as mean_rate from lineitem group by 1")
def median_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), rate.alias("rate"))
    middle = grouped_quantiles(rows, ["kind"], "rate", [0.5]).select("kind", F.round(F.get("q", F.lit(0)), 6).alias("median_rate"))
    return rows.groupBy("kind").agg(F.round(F.avg("rate"), 6).alias("mean_rate")).join(middle, "kind")


@query("largest_shard", "select o_orderpriority as kind, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as shard, max(o_totalprice) as size from orders group by 1")
def largest_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("shard"), F.max("o_totalprice").alias("size"))
