"""First copies: by folded text, by id, by canonical text; near copies by blocking and a ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.similarity import ratio_at_least
from chronolith.functions.text import canonical, folded
from chronolith.operators.nearcopies import candidates


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order; combined before the shuffle, so copies of one key never meet in one task."""
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(key).agg(F.min(row).alias("__r")).select("__r.*")


def first_dated(posts: DataFrame) -> DataFrame:
    """Posts without later copies of a text (case and white space aside) and of an id."""
    keyed = posts.withColumn("__k", F.md5(folded(F.col("text")).cast("binary")))
    once = first_by(keyed, "__k", ["created_utc", "id"]).drop("__k")
    return first_by(once, "id", ["created_utc", "id"])


def punctuation_blind(posts: DataFrame, least: int = 12) -> DataFrame:
    """Posts without later ones that differ in punctuation and case only; canonical texts under `least` stay."""
    keyed = posts.withColumn("__c", canonical(F.col("text")))
    short, long_ = keyed.filter(F.length("__c") < least), keyed.filter(F.length("__c") >= least)
    long_ = first_by(long_.withColumn("__k", F.md5(F.col("__c").cast("binary"))), "__k", ["created_utc", "id"])
    return short.drop("__c").unionByName(long_.drop("__c", "__k"))


def _long_canonical(posts: DataFrame) -> DataFrame:
    """id, c of the rows that near copies are looked for among."""
    made = F.transform(F.array(canonical(F.col("text"))), lambda c: F.when(F.length(c) >= 160, c))  # worked out once, for the filter too
    return posts.filter(F.length("text") >= 200).select("id", F.explode(made).alias("c")).filter("c is not null")


def near_copy_members(posts: DataFrame) -> DataFrame:
    """id, representative of every eligible row: the smallest id with the same canonical text.

    Keyed by the text's digest and one of 64 parts of its group, so many copies of one text do not meet in one task.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")
    rows = _long_canonical(posts).select("id", F.sha2(F.col("c").cast("binary"), 256).alias("k"), part)
    parts = rows.groupBy("k", "part").agg(F.min("id").alias("first"))
    named = parts.join(parts.groupBy("k").agg(F.min("first").alias("representative")), "k").drop("first")
    return rows.join(named, ["k", "part"]).select("id", "representative")


def near_copy_pairs(posts: DataFrame, ratio: float = 0.985) -> DataFrame:
    """id_a, id_b, ratio of canonical texts that are nearly equal.

    Candidates share 24 leading characters and lie in neighbouring length buckets. Of equal canonical texts the smallest id
    stands for all in the comparison, and is paired with each other one at ratio 1.0: a group of n has n - 1 such pairs.
    """
    rows = _long_canonical(posts).groupBy("c").agg(F.min("id").alias("class"))
    pairs = candidates(rows, [], ratio).withColumn("ratio", ratio_at_least("c", "c2", ratio)).filter("ratio is not null")
    equal = near_copy_members(posts).filter("id <> representative").select(F.col("representative").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("ratio"))
    return pairs.select(F.col("class").alias("id_a"), F.col("class2").alias("id_b"), "ratio").unionByName(equal)
