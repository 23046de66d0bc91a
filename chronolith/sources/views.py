"""The driver's tables as the tables of the forum corpus, and the same bindings in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.timeutil import month, year

SPREAD = "1293840000 + ({} * 28508400) % 368150400"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, subreddit, text, kind, created_utc, year, month from documents."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("subreddit"), "text", F.lit("submissions").alias("kind"), F.expr(SPREAD.format("doc_id")).alias("created_utc"))
    return rows.withColumns({"year": year(F.col("created_utc")), "month": month(F.col("created_utc"))})


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, author, thread_id, subreddit, text, created_utc from conversations."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("author"), F.col("conv_id").cast("string").alias("thread_id"), F.lit("chat").alias("subreddit"), "text", F.expr(SPREAD.format("conv_id") + " + turn * 60").alias("created_utc"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (also the order in time), family, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("family"), "embedding")


POSTS_SQL = f"""posts as (
  select *, year(make_timestamp(created_utc * 1000000)) as year, month(make_timestamp(created_utc * 1000000)) as month
  from (select doc_id::varchar as id, source as subreddit, text, {SPREAD.format('doc_id')} as created_utc from documents))"""
COMMENTS_SQL = f"""comments as (
  select conv_id || '-' || turn as id, role as author, conv_id::varchar as thread_id, 'chat' as subreddit, text,
    {SPREAD.format('conv_id')} + turn * 60 as created_utc from conversations)"""
VECTORS_SQL = "vectors as (select vec_id as id, label as family, embedding from embeddings)"
