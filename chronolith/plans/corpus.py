"""Queries of the corpus engine: sampling, cleaning, copies, partitions, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import patterns as P
from chronolith.functions import text as T
from chronolith.functions import timeutil
from chronolith.operators import clean, dedup, sample
from chronolith.operators.prefix import running_before
from chronolith.operators.windows import pack_windows
from chronolith.plans.registry import query
from chronolith.sources.views import COMMENTS_SQL, POSTS_SQL, comments, posts, table

TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
COUNT_TOKENS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"
ELIGIBLE = f"""length({TRIM.format('text')}) between 20 and 500 and {COUNT_TOKENS.format(TRIM.format('text'))} >= 4
  and not starts_with(lower({TRIM.format('text')}), 'i am a bot') and not starts_with(lower({TRIM.format('text')}), 'your post has been')
  and coalesce(subreddit, '') <> ''"""


@query(
    "sample_bottomk",
    f"""with {POSTS_SQL}
    select id, subreddit, year, created_utc, sample_rank, length(text)::bigint as chars from (
      select *, row_number() over (partition by year, subreddit order by md5(year || ':' || id), id) as sample_rank
      from posts where {ELIGIBLE}) where sample_rank <= 150""",
)
def sample_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).filter(sample.eligible(F.col("text"), F.col("subreddit")))
    picked = sample.bottom_k(rows, ["year", "subreddit"], sample.hash_key(F.col("year").cast("string"), F.col("id")), 150)
    return picked.select("id", "subreddit", "year", "created_utc", "sample_rank", F.length("text").cast("long").alias("chars"))


#: Families with the forms that the test tables hold, in place of patterns.FAMILIES.
WORD_FAMILIES = {"and": "(?i)(^|[^a-z])and([^a-z]|$)", "der": "(?i)(^|[^a-z])der([^a-z]|$)", "que": "(?i)(^|[^a-z])que([^a-z]|$)", "thing": "(?i)thing", "nothing": "(?i)zzzz"}


@query(
    "phrase_family_sample",
    f"""with {POSTS_SQL}, f(family, pattern) as (values {', '.join(f"('{k}', '{v}')" for k, v in WORD_FAMILIES.items())}),
    hit as (select family, year, id, row_number() over (partition by family, year order by md5(year || ':' || id || ':' || family), id) as sample_rank,
      count(*) over (partition by family, year) as matching from posts join f on regexp_matches(text, pattern)
      where length(text) between 10 and 400)
    select * from hit where sample_rank <= 8""",
)
def phrase_family_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).filter(F.length("text").between(10, 400))
    hits = sample.family_hits(rows, WORD_FAMILIES)
    key = sample.hash_key(F.col("year").cast("string"), F.col("id"), F.col("family"))
    picked = sample.bottom_k(hits, ["family", "year"], key, 8)
    counts = hits.groupBy("family", "year").agg(F.count("*").alias("matching"))
    return picked.join(counts, ["family", "year"]).select("family", "year", "id", "sample_rank", "matching")


@query("global_bottomk", f"with {POSTS_SQL} select id, text[1:240] as text, md5(id) as h from posts order by md5(id), id limit 12")
def global_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("id", F.substring("text", 1, 240).alias("text"), F.md5(F.col("id").cast("binary")).alias("h"))
    return rows.orderBy("h", "id").limit(12)


LEFT = f"trim(regexp_replace(text, '{P.URL}', '', 'g'), ' []()<>-:;,.!' || chr(10) || chr(9))"
REASON = f"""case when lower(text) in ('', '[deleted]', '[removed]') then 'empty_or_removed'
  when regexp_matches(text, '{P.BOT_FOOTER}') then 'bot_or_moderation'
  when regexp_matches(text, '{P.URL}') and (length({LEFT}) = 0 or (length(text) >= 30 and length({LEFT}) / length(text) < 0.2)) then 'url_dominated'
  when length(text) > 12000 then 'pathological_length' else 'kept' end"""


@query(
    "reject_reasons",
    f"""with {POSTS_SQL}, r as (select *, {REASON} as reason from posts),
    k as (select *, row_number() over (partition by reason order by created_utc, id) as turn from r)
    select reason, count(*) as n, string_agg(id, ',' order by created_utc, id) filter (turn <= 3) as examples from k group by reason""",
)
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).withColumn("reason", clean.reason(F.col("text")))
    counts = rows.groupBy("reason").agg(F.count("*").alias("n"))
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy("reason").orderBy("created_utc", "id"))).filter("turn <= 3")
    examples = first.groupBy("reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]), ",").alias("examples"))
    return counts.join(examples, "reason")


@query(
    "clean_staged",
    f"""with {COMMENTS_SQL},
    a as (select * from comments qualify row_number() over (partition by id order by created_utc, id) = 1),
    b as (select * from a where {REASON} = 'kept' and lower(coalesce(author, '')) <> 'automoderator'),
    c as (select * from b qualify lower(coalesce(author, '')) in ('', '[deleted]') or row_number() over (partition by lower(subreddit), lower(author) order by created_utc, id) <= 300),
    d as (select * from c qualify coalesce(thread_id, '') = '' or row_number() over (partition by thread_id order by created_utc, id) <= 3),
    e as (select * from d qualify row_number() over (partition by lower(subreddit), md5(text) order by created_utc, id) <= 1)
    select id, author, thread_id, created_utc from e""",
)
def clean_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.staged(comments(spark, sf_dir), author_cap=300, thread_cap=3, copy_cap=1)
    return kept.select("id", "author", "thread_id", "created_utc")


@query("clean_exact")
def clean_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.exact(comments(spark, sf_dir).withColumn("year", timeutil.year(F.col("created_utc"))).withColumn("month", timeutil.month(F.col("created_utc"))).withColumn("kind", F.lit("comments")))


def _once(c: str) -> str:
    """The entities that the test pages hold, undone in one pass."""
    for name, mark in (("quot", 34), ("copy", 169), ("middot", 183), ("amp", 38)):
        c = f"replace({c}, '&{name};', chr({mark}))"
    return c


@query(
    "html_normalize",
    rf"""with a as (select page_id, nfc_normalize({_once(_once("coalesce(html, '')"))}) as t from pages),
    b as (select page_id, regexp_replace(regexp_replace(t, '(?i)!\[(?:img|image|gif)?\]\([^)]*\)', '', 'g'), '{P.MARKDOWN_IMAGE}', '\1', 'g') as t from a),
    c as (select page_id, regexp_replace(regexp_replace(regexp_replace(t, '{P.HTML_IMAGE}', '', 'g'), '{P.IMAGE_URL}', '', 'g'), '{P.IMAGE_PLACEHOLDER}', '', 'g') as t from b),
    d as (select page_id, replace(regexp_replace(replace(t, chr(8205), chr(57344)), '[\x00-\x08\x0b-\x1f\x7f-\x9f\p{{Cf}}]', '', 'g'), chr(57344), chr(8205)) as t from c)
    select page_id, array_to_string(list_filter(list_transform(string_split_regex(t, '[\n\x{{2028}}\x{{2029}}]'), lambda x: trim(regexp_replace(x, '[\t\p{{Z}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from d""",
)
def html_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normalize(F.col("html")).alias("text"))


@query(
    "dedup_canonical",
    rf"""with {POSTS_SQL},
    n as (select *, array_to_string(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), ' ') as k,
      trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' ') as c from posts),
    a as (select * from n qualify row_number() over (partition by md5(k) order by created_utc, id) = 1),
    b as (select * from a where length(c) < 12 union all (select * from a where length(c) >= 12 qualify row_number() over (partition by md5(c) order by created_utc, id) = 1))
    select id, created_utc, subreddit from b""",
)
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.punctuation_blind(dedup.first_dated(posts(spark, sf_dir))).select("id", "created_utc", "subreddit")


@query("near_copy_pairs")
def near_copy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_copy_pairs(posts(spark, sf_dir))


@query(
    "audit_flags",
    rf"""with {POSTS_SQL}, f as (select id, list_filter([
      case when lower({TRIM.format('text')}) in ('', '[deleted]', '[removed]') then 'empty_or_removed' end,
      case when regexp_matches(text, '(?i)!\[[^]]*\]\([^)]*\)|<img\b') then 'image_markup' end,
      case when regexp_matches(text, '(?i)https?://\S+\.(?:png|jpe?g|gif|webp)') then 'media_url' end,
      case when contains(lower(text), 'i am a bot, and this action was performed automatically') then 'bot_footer' end,
      case when length(text) > 12000 then 'too_long' end], lambda x: x is not null) as flags from posts)
    select id, array_to_string(flags, ',') as flags from f where len(flags) > 0""",
)
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("id", clean.audit_flags(F.col("text")).alias("flags"))
    return rows.filter(F.size("flags") > 0).select("id", F.array_join("flags", ",").alias("flags"))


PARTS = """e as (select distinct day, kind from (select unnest(range(date '2024-01-01', date '2024-02-01', interval 1 day))::date as day), (select distinct event_type as kind from events)),
    o as (select ts::date as day, event_type as kind, count(*) as n, sum(value) as total from events group by all)"""


@query(
    "partition_status",
    f"""with {PARTS} select e.day::varchar as day, e.kind, coalesce(n, 0) as n,
      case when n is null then 'missing_source' when n < 60 then 'running' else 'complete' end as status
    from e left join o using (day, kind)""",
)
def partition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    days = spark.sql("select explode(sequence(date '2024-01-01', date '2024-01-31')) as day")
    expected = days.crossJoin(F.broadcast(events.select(F.col("event_type").alias("kind")).distinct()))  # a grid of few days and kinds
    seen = events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return clean.status(expected, seen, ["day", "kind"], full=60).withColumn("day", F.col("day").cast("string"))


@query(
    "unfinished_partitions",
    f"with {PARTS} select e.day::varchar as day, e.kind from e where not exists (select 1 from o where o.day = e.day and o.kind = e.kind and n >= 60)",
)
def unfinished_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_status(spark, sf_dir).filter("status <> 'complete'").select("day", "kind")


@query(
    "manifest_rollup",
    """with o as (select case when year(o_orderdate) < 2000 then 'train' when year(o_orderdate) = 2000 then 'val' else 'test' end as split,
      year(o_orderdate) as year, o_orderkey, o_totalprice from orders)
    select split, year, count(*) as documents, sum(floor(o_totalprice))::bigint as tokens, min(o_orderkey) as first_key, max(o_orderkey) as last_key
    from o group by rollup (split, year)""",
)
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    rows = rows.withColumn("split", timeutil.split_of(F.col("year"), 1990, 2000, 2001))
    return rows.rollup("split", "year").agg(F.count("*").alias("documents"), F.sum(F.floor("o_totalprice")).alias("tokens"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(
    "tokens_by_year_and_kind",
    """pivot (select year(l_shipdate) as year, l_returnflag as kind, l_quantity from lineitem) on kind in ('A', 'N', 'R') using sum(l_quantity)::bigint group by year""",
)
def tokens_by_year_and_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("kind"), "l_quantity")
    return rows.groupBy("year").pivot("kind", ["A", "N", "R"]).agg(F.sum("l_quantity").cast("long"))


OFFSETS = f"""t as (select id, subreddit, created_utc, {COUNT_TOKENS.format('text')} + 1 as n from posts),
    o as (select *, sum(n) over (partition by subreddit order by created_utc, id rows unbounded preceding) - n as at from t)"""


@query(
    "pack_windows",
    f"""with {POSTS_SQL}, {OFFSETS.replace(' as at', ' as pos')},
    total as (select subreddit, (sum(n) - 1) // 1024 as windows from t group by 1),
    w as (select subreddit, created_utc, pos, n, unnest(range((pos // 1024)::bigint, ((pos + n - 1) // 1024)::bigint + 1)) as window_no from o)
    select w.subreddit, window_no, count(*) as documents,
      round_even(sum((least(pos + n, 1024 * (window_no + 1)) - greatest(pos, 1024 * window_no)) * created_utc) / 1024, 0)::bigint as created_utc
    from w join total using (subreddit) where window_no < windows group by all""",
)
def pack_windows_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("id", "subreddit", "created_utc", (T.token_count(F.col("text")) + 1).alias("n"))
    return pack_windows(rows, ["subreddit"], ["created_utc", "id"])


@query(
    "shard_by_running_tokens",
    f"""with {POSTS_SQL}, t as (select created_utc, id, {COUNT_TOKENS.format('text')} + 1 as n from posts),
    o as (select *, sum(n) over (order by created_utc, id rows unbounded preceding) - n as pos from t)
    select (pos // 50000)::bigint as shard, case when pos // 50000 = 0 then 'val' else 'train' end as split, count(*) as documents, sum(n)::bigint as tokens
    from o group by all""",
)
def shard_by_running_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("id", "created_utc", (T.token_count(F.col("text")) + 1).alias("n"))
    placed = running_before(rows, ["created_utc", "id"], "n", "pos").withColumn("shard", F.expr("pos div 50000"))
    return placed.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens")).withColumn("split", F.when(F.col("shard") == 0, "val").otherwise("train"))


@query(
    "range_pick",
    """with c as (select l_orderkey as k, count(*) as n from lineitem group by 1),
    b as (select k, sum(n) over (order by k) - n as lo, sum(n) over (order by k) as hi from c),
    t as (select count(*) as total from lineitem),
    p as (select i, ('0x' || substr(md5('pick:' || i), 1, 8))::bigint % total as pick from t, range(1000) r(i))
    select i, pick::bigint as pick, k as l_orderkey, (pick - lo)::bigint as place from p join b on pick >= lo and pick < hi""",
)
def range_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return sample.range_pick(counts, "l_orderkey", "n", draws=1000)


@query(
    "stratified_windows",
    """select o_orderkey, y as year, o_orderpriority, sample_rank from (
      select o_orderkey, year(o_orderdate) as y, o_orderpriority,
        row_number() over (partition by year(o_orderdate), o_orderpriority order by md5('w:' || o_orderkey), o_orderkey) as sample_rank from orders) where sample_rank <= 12""",
)
def stratified_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), "o_orderpriority")
    picked = sample.bottom_k(rows, ["year", "o_orderpriority"], sample.hash_key(F.lit("w"), F.col("id").cast("string")), 12)
    return picked.withColumnRenamed("id", "o_orderkey")


@query(
    "normalized_time",
    f"""select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month, round((epoch(o_orderdate) - {P.TIME_START}) / {P.TIME_END - P.TIME_START}.0, 9) as t,
      round((epoch(o_orderdate) - 820454400) / {P.YEAR_SECONDS}.0, 6) as years, strftime(o_orderdate, '%Y-%m-%d') as day,
      epoch(date_trunc('month', o_orderdate))::bigint as month_start, (year(o_orderdate) || '-07-01') as middle from orders""",
)
def normalized_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("s", F.unix_timestamp("o_orderdate"))
    y, m = timeutil.year(F.col("s")), timeutil.month(F.col("s"))
    return rows.select("o_orderkey", y.alias("year"), m.alias("month"), F.round(timeutil.normalized(F.col("s")), 9).alias("t"), F.round(timeutil.elapsed_years(F.col("s"), F.lit(820454400)), 6).alias("years"), F.date_format(timeutil.moment(F.col("s")), "yyyy-MM-dd").alias("day"), timeutil.month_bounds(y, m)[0].alias("month_start"), F.date_format(timeutil.moment(timeutil.parse(y.cast("string"))), "yyyy-MM-dd").alias("middle"))
