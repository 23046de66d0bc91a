"""URL rules by expansion, short hash prefixes, full digests and precedence; built-in expressions only.

A url is expanded into host suffixes x path prefixes, but only of the label counts and path lengths that some rule
has, so the expansion is bounded by the rules and never by the url. The first 32 bits of SHA-256 carry the equi-join;
the full digest confirms it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import ascii_lower
from chronolith.shared import small, stored

SHORT = 8  # hex digits of the digest that the join compares first


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs, a rule being host + path as in 'example.org/es/'."""
    rows = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps([{"verdict": v, "rule": r} for v, r in rules])), "array<struct<verdict:string,rule:string>>")))
    host = F.substring_index("rule", "/", 1)
    return rows.select("verdict", "rule", host.alias("rule_host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict for each row of pages.

    A rule fits its host and every subdomain of it where the path starts with the rule's path. Of the rules that fit,
    the longest wins; of equally long ones the one with the longer host, then block before allow. Without one the
    verdict is `default`. Null urls, and urls without '://', have empty host and path. Repeated rows are judged alike;
    ids are carried and never compared; an empty rule table leaves every url to `default`.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keyed = rules.select("verdict", "rule", F.length("rule").alias("rule_len"), F.length("rule_host").alias("host_len"), F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"))
    keyed = keyed.withColumn("short", F.substring("rule_digest", 1, SHORT))
    shape = rules.agg(F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    labels, lengths = list(shape["labels"] or []), list(shape["lengths"] or [])

    distinct = rows.select("host", "path").distinct()
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.expr("cast(array() as array<int>)")
    hosts = F.transform(F.filter(ints(labels), lambda k: k <= F.size(F.split("host", r"\."))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    paths = F.transform(F.filter(ints(lengths), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    made = distinct.withColumn("h", F.explode(hosts)).withColumn("p", F.explode(paths))
    made = made.select("host", "path", F.sha2(F.concat_ws("\n", "h", "p"), 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    hits = made.join(small(keyed, text=("rule", "rule_digest")), "short").filter("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("rule_len", "host_len", F.col("verdict"))).alias("won"))
    # Only urls that some rule fits are in here. Stored, so that a hot url's rows can be split where it is not broadcast.
    best = stored(best, "judged")
    return rows.join(small(best, text=("host", "path", "won.rule")), ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
