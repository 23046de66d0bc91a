"""Queries of whole reports: phrase emergence, link metrics and review, component profiles, paired window losses, samples."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import text as T
from chronolith.functions import timeutil
from chronolith.functions import vectors as V
from chronolith.operators import clean, dedup, graph, neighbors, phrases, requests, sample, scoring, tokens
from chronolith.operators.quantiles import quantiles
from chronolith.plans.analysis import CONTEXT_SQL, DOT, EDGE_SQL, FLOOR, ROOT_SQL, TFIDF_SQL, UNIT_SQL, _edges, _labelled, _links, _text_links, lex_docs_sql
from chronolith.plans.corpus import ELIGIBLE, REASON
from chronolith.plans.registry import query
from chronolith.plans.rest import WINDOWS_SQL
from chronolith.shared import fresh_path, stored
from chronolith.sources.files import audit_report
from chronolith.sources.views import POSTS_SQL, posts, table, vectors

# ---------------------------------------------------------------- phrases: scores, counts and growth in one table

#: July 2018, 2019 and 2020, in seconds.
DATES = (1530403200, 1561939200, 1593561600)
ID_LIST = r"list_transform(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), lambda w: ('0x' || substr(md5(w), 1, 4))::int)"
EMERGENCE_SQL = f"""{POSTS_SQL}, {CONTEXT_SQL.replace('from posts)', 'from posts where year between 2017 and 2020)', 1)},
  chosen as (select phrase from o group by 1 having count(*) between 2 and 300 and count(context) >= 2 order by md5(phrase), phrase limit 1000),
  first as (select phrase, context from o join chosen using (phrase) where context is not null qualify row_number() over (partition by phrase order by created_utc, id) <= 2),
  ids as (select phrase, {ID_LIST.format('context')} as a, {ID_LIST.format("' ' || phrase")} as b from first),
  grid as (select phrase, d, -(('0x' || substr(md5(array_to_string(a[greatest(len(a) - 63, 1):], ' ') || '|' || array_to_string(b, ' ') || '|' || d), 1, 6))::bigint / 1e6) as lp from ids, (values {', '.join(f'({d})' for d in DATES)}) z(d)),
  slope as (select phrase, avg(lp) filter (d = {DATES[2]}) - avg(lp) filter (d = {DATES[0]}) as model_slope from grid group by 1),
  words as (select id, year, regexp_extract_all(lower((regexp_extract(text, '^[^\\n]*'))[1:300]), '([a-z][a-z'']*)') as w from posts),
  run as (select distinct id, year, array_to_string(w[s + 1:s + k], ' ') as phrase from words, unnest(range(0, len(w))) r(s), (values (2), (3), (4)) z(k) where s + k <= len(w)),
  hits as (select phrase, year, count(*) as h from run join chosen using (phrase) group by all),
  sums as (select phrase, coalesce(sum(h) filter (year = 2018), 0) as h18, coalesce(sum(h) filter (year = 2019), 0) as h19, coalesce(sum(h) filter (year = 2020), 0) as h20, coalesce(sum(h) filter (year in (2021, 2022)), 0) as hf from hits group by 1),
  docs as (select count(*) filter (year = 2018) as d18, count(*) filter (year = 2019) as d19, count(*) filter (year = 2020) as d20, count(*) filter (year in (2021, 2022)) as df from posts),
  rate as (select phrase, model_slope, h19 + h20 as train_hits, hf as future_hits, (h18 + 0.5) / d18 * 1e6 as r18, (h19 + 0.5) / d19 * 1e6 as r19, (h20 + 0.5) / d20 * 1e6 as r20,
    (h19 + h20 + 0.5) / (d19 + d20) * 1e6 as rp, (hf + 0.5) / df * 1e6 as rf from slope join sums using (phrase), docs),
  report as (select phrase, model_slope, ln(r20 / r19) as frequency_slope, ln(rf / rp) as future_growth, train_hits, future_hits, r18, r19, r20, rf from rate)"""


def _emergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2017 to 2020, scored behind their mined contexts at three dates by a scorer that is passed in, with counts by year."""
    rows = posts(spark, sf_dir)
    chosen = stored(phrases.candidates(phrases.occurrences(rows.filter(F.col("year").between(2017, 2020))), least=2, contexts=2), "chosen", 1000)
    join = lambda ids: F.array_join(ids.cast("array<string>"), " ")
    scorer = lambda prefix, ids, date: -(F.conv(F.substring(F.md5(F.concat_ws("|", join(prefix), join(ids), date.cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") / 1e6)
    scores = phrases.score_contexts(chosen, scorer, list(DATES))
    hits = phrases.line_hits(rows, chosen).groupBy("year", "phrase").agg(F.sum("hits").alias("hits"))
    documents = rows.groupBy("year").agg(F.count("*").alias("documents"))
    return phrases.emergence(scores, hits, documents, DATES[0], DATES[2])


@query(
    "emergence_report",
    f"""with {EMERGENCE_SQL} select phrase, round(model_slope, 9) as model_slope, round(frequency_slope, 6) as frequency_slope, round(future_growth, 6) as future_growth,
      train_hits::bigint as train_hits, future_hits::bigint as future_hits, round(r18, 4) as rate_2018, round(r19, 4) as rate_2019, round(r20, 4) as rate_2020, round(rf, 4) as rate_2021_2022 from report""",
)
def emergence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _emergence(spark, sf_dir)
    return rows.select(*[F.round(c, 9 if c == "model_slope" else 4 if c.startswith("rate") else 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query(
    "emergence_summary",
    f"""with {EMERGENCE_SQL},
    k as (select rank() over (order by model_slope) + (count(*) over (partition by model_slope) - 1) / 2 as a, rank() over (order by frequency_slope) + (count(*) over (partition by frequency_slope) - 1) / 2 as b,
      rank() over (order by future_growth) + (count(*) over (partition by future_growth) - 1) / 2 as c, model_slope, future_growth from (select round(model_slope, 9) as model_slope, round(frequency_slope, 9) as frequency_slope, round(future_growth, 9) as future_growth from report)),
    q as (select quantile_cont(model_slope, 0.9) as cut from k)
    select count(*) as n, round(corr(a, c), 6) as model_rho, round(corr(b, c), 6) as trend_rho, round(avg(future_growth) filter (model_slope >= cut), 6) as top_mean, round(avg(future_growth), 6) as mean from k, q""",
)
def emergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _emergence(spark, sf_dir).select("phrase", *[F.round(c, 9).alias(c) for c in ("model_slope", "frequency_slope", "future_growth")])
    made = phrases.emergence_summary(rows)
    return made.select("n", *[F.round(c, 6).alias(c) for c in ("model_rho", "trend_rho", "top_mean", "mean")])


# ---------------------------------------------------------------- links

PLACE_SQL = f"{EDGE_SQL}, {POSTS_SQL}, place as (select u.id, family, year, subreddit, text, created_utc from u join posts p on p.id = u.id::varchar)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, family, year, subreddit, text, created_utc of every vector's post."""
    p = posts(spark, sf_dir).select(F.col("id").cast("long").alias("id"), "year", "subreddit", "text", "created_utc")
    return vectors(spark, sf_dir).select("id", "family").join(p, "id")


def _both_ends(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """edges with the columns of `rows` of their two ends, under the ends' names."""
    for side in ("child", "parent"):
        edges = edges.join(rows.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "id"]), side)
    return edges


@query(
    "link_groups",
    f"""with {PLACE_SQL}, e as (select gap, c.year, c.family = p.family as same, c.subreddit <> p.subreddit as across from edge join place c on c.id = child join place p on p.id = parent),
    g(scope, low, high) as (values ('all', 0, 9999), ('through_2020', 0, 2020), ('2021_2022', 2021, 9999))
    select scope, count(year) as edges, round(avg(same::int), 6) as same_family, round(avg(gap) / 100, 6) as mean_gap, round(avg(across::int), 6) as cross_board from g left join e on year between low and high group by scope""",
)
def link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four figures of all links, of those to children until 2020, and of later ones."""
    e = _both_ends(_edges(spark, sf_dir), _places(spark, sf_dir).select("id", "year", "family", "subreddit"))
    return graph.link_groups(e.select("gap", F.col("child_year").alias("year"), (F.col("child_family") == F.col("parent_family")).alias("same"), (F.col("child_subreddit") != F.col("parent_subreddit")).alias("across")))


@query(
    "low_overlap_review",
    f"""with {PLACE_SQL}, {lex_docs_sql('where id in (select id from u)')}, {TFIDF_SQL},
    own as (select edge.child, edge.parent, sum(a.w * b.w) as lexical from edge join wt a on a.id = edge.child join wt b on b.id = edge.parent and b.term = a.term group by all)
    select edge.child, edge.parent, c.year as child_year, p.year as parent_year, c.subreddit as child_board, p.subreddit as parent_board, c.text[1:120] as child_text, p.text[1:120] as parent_text, round(cosine, 6) as cosine, round(coalesce(lexical, 0), 6) as lexical
    from edge join place c on c.id = edge.child join place p on p.id = edge.parent left join own on own.child = edge.child and own.parent = edge.parent
    where c.family <> p.family and length(c.text) >= 15 and length(p.text) >= 15 and round(coalesce(lexical, 0), 9) < 0.12 order by edge.cosine desc, edge.child limit 30""",
)
def low_overlap_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between families whose texts hardly share words, the nearest 30, for people to read."""
    text = posts(spark, sf_dir).select(F.col("id").cast("long").alias("id"), "year", "subreddit", F.length("text").alias("chars"), F.xxhash64("text").alias("mark"), F.substring("text", 1, 120).alias("text"))
    places = vectors(spark, sf_dir).select("id", "family").join(text.drop("text"), "id")
    e = _both_ends(_edges(spark, sf_dir).select("child", "parent", "cosine"), places).filter((F.col("child_family") != F.col("parent_family")) & (F.col("child_chars") >= 15) & (F.col("parent_chars") >= 15))
    e = stored(e, "links")
    e = e.join(_text_links(spark, sf_dir, e), ["child", "parent"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0))).filter(F.round("lexical", 9) < 0.12)
    top = stored(e.orderBy(F.desc("cosine"), "child").limit(30), "review")
    ends = top.select(F.col("child").alias("id")).union(top.select("parent")).distinct()
    shown = text.select("id", "mark", "text").join(F.broadcast(ends), "id", "left_semi").distinct()  # texts of thirty links only
    for side in ("child", "parent"):
        top = top.join(shown.select(F.col("id").alias(side), F.col("mark").alias(f"{side}_mark"), F.col("text").alias(f"{side}_text")), [side, f"{side}_mark"])
    top = top.orderBy(F.desc("cosine"), "child")
    return top.select("child", "parent", "child_year", "parent_year", F.col("child_subreddit").alias("child_board"), F.col("parent_subreddit").alias("parent_board"), "child_text", "parent_text", F.round("cosine", 6).alias("cosine"), F.round("lexical", 6).alias("lexical"))


@query(
    "floored_edges",
    f"""with {EDGE_SQL}, k as (select *, row_number() over (order by id) - 1 as no from u),
    d as (select ('0x' || substr(md5('null:a:' || i), 1, 8))::bigint % (select count(*) from u) as a, ('0x' || substr(md5('null:b:' || i), 1, 8))::bigint % (select count(*) from u) as b from range(100000) r(i)),
    f as (select greatest(quantile_cont({DOT.format('x.embedding', 'y.embedding')} / (x.len * y.len), 0.999), {FLOOR}) as floor from d join k x on x.no = a join k y on y.no = b where a <> b)
    select child, parent, round(cosine, 6) as cosine, round(floor, 6) as floor from best, f where round(cosine, 9) >= round(floor, 9)""",
)
def floored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose cosine reaches the 99.9 % quantile of random pairs, and a least floor."""
    null = stored(neighbors.random_pairs(vectors(spark, sf_dir), 100000, "null"), "null", 100000)
    floor = max(quantiles(null, "cosine", [0.999])[0] or 0.0, FLOOR)
    links = _links(spark, sf_dir).filter(F.round("cosine", 9) >= round(floor, 9))
    return links.select("child", "parent", F.round("cosine", 6).alias("cosine"), F.round(F.lit(floor), 6).alias("floor"))


@query(
    "selection_drift",
    f"""with {EDGE_SQL}, plain as (select child, unnest(arg_max({{'parent': parent, 'cosine': cosine}}, cosine)) from pair group by child),
    chosen as (select child, parent from plain order by plain.cosine desc, child limit 60)
    select count(*) as selected, count(*) filter (edge.parent = chosen.parent) as present, count(*) filter (edge.parent <> chosen.parent) as other_parent, count(*) filter (edge.parent is null) as gone
    from chosen left join edge on edge.child = chosen.child""",
)
def selection_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that were chosen from a graph without time penalty, looked up in the present one."""
    plain = neighbors.earlier_neighbour(vectors(spark, sf_dir), alpha=0.0)
    chosen = plain.orderBy(F.desc("cosine"), "child").limit(60).select("child", "parent")
    return graph.drift(chosen, _edges(spark, sf_dir))


@query(
    "component_report",
    f"""with recursive {ROOT_SQL}, {POSTS_SQL}, m as (select root, u.id, year, subreddit, created_utc from lab join u using (id) join posts p on p.id = u.id::varchar),
    deg as (select parent as id, count(*) as children from edge group by 1),
    big as (select root, count(*) as size from m group by 1 having count(*) >= 3),
    boards as (select root, string_agg(subreddit || ':' || n, ',' order by subreddit) as boards from (select root, subreddit, count(*) as n from m group by all) group by 1),
    early as (select root, string_agg(id::varchar, ',' order by created_utc, id) as early from (select * from m qualify row_number() over (partition by root order by created_utc, id) <= 3) group by 1),
    hub as (select root, string_agg(id || ':' || children, ',' order by children desc, id) as hubs from (select * from m join deg using (id) qualify row_number() over (partition by root order by children desc, id) <= 3) group by 1),
    span as (select root, min(year) as first_year, max(year) as last_year, arg_min(id, (created_utc, id)) as earliest from m group by 1)
    select (row_number() over (order by size desc, root) - 1)::int as index, root, size, first_year, last_year, earliest, boards, early, hubs
    from span join big using (root) join boards using (root) join early using (root) join hub using (root)""",
)
def component_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of three posts and more: span, earliest post, boards with their posts, first posts, and hubs."""
    edges = _edges(spark, sf_dir)
    rows = _labelled(spark, sf_dir, edges).join(_places(spark, sf_dir).select("id", "year", "subreddit", "created_utc"), "id")
    made = graph.profiles(stored(rows, "members"), edges, least=3)
    pairs = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string"))), ",")
    return made.select("index", "root", "size", "first_year", "last_year", "earliest", pairs("boards", "subreddit", "n").alias("boards"), F.array_join(F.col("early").cast("array<string>"), ",").alias("early"), pairs("hubs", "id", "children").alias("hubs"))


# ---------------------------------------------------------------- windows scored at two dates


class HashLoss:
    """A stand-in model: a window's loss at a date is a number of its digest."""

    def __call__(self, text: pd.Series, date: pd.Series) -> list[float]:
        return [int(hashlib.md5(f"{t}:{d}".encode()).hexdigest()[:6], 16) / 1e6 for t, d in zip(text, date, strict=True)]


@query(
    "window_losses",
    f"""with {WINDOWS_SQL}, w as (select string_agg(token::varchar, ' ' order by place) as text, round_even(sum(created_utc) filter (place < 1024 * (w + 1)) / 1024, 0)::bigint as t from every_ join last using (subreddit) where w < windows group by every_.subreddit, w),
    l as (select case when year(make_timestamp(t * 1000000)) < 2021 then 'train' when year(make_timestamp(t * 1000000)) = 2021 then 'val' else 'test' end as split, strftime(make_timestamp(t * 1000000), '%Y-%m') as month,
      ('0x' || substr(md5(text || ':' || t), 1, 6))::bigint / 1e6 as a, ('0x' || substr(md5(text || ':' || {DATES[2]}), 1, 6))::bigint / 1e6 as b from w)
    select split, month, count(*) as windows, round(avg(a), 9) as actual_loss, round(avg(b), 9) as fixed_loss, round(avg(b - a), 9) as gain from l group by grouping sets ((split, month), (split))""",
)
def window_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window scored at its own date and at July 2020, in batches of equal lengths: means by split and month, and by split."""
    made = tokens.token_windows(posts(spark, sf_dir).select("id", "subreddit", "created_utc", "text"), ["subreddit"], ["created_utc", "id"])
    rows = made.select("subreddit", "window_no", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("text"), "created_utc")
    dates = F.explode(F.array(*[F.struct(F.lit(n).alias("at"), d.cast("long").alias("date")) for n, d in (("actual", F.col("created_utc")), ("fixed", F.lit(DATES[2])))]))
    scored = scoring.scored_by_length(rows.withColumn("d", dates).select("subreddit", "window_no", "text", "created_utc", "d.*"), HashLoss, budget=1 << 20, out="loss")
    of = lambda at: F.max(F.when(F.col("at") == at, F.col("loss")))
    paired = scored.groupBy("subreddit", "window_no", "created_utc").agg(of("actual").alias("a"), of("fixed").alias("b"))
    paired = paired.withColumn("split", timeutil.split_of(timeutil.year(F.col("created_utc")))).withColumn("month", F.date_format(timeutil.moment(F.col("created_utc")), "yyyy-MM"))
    out = paired.groupingSets([["split", "month"], ["split"]], "split", "month").agg(F.count("*").alias("windows"), F.avg("a").alias("actual_loss"), F.avg("b").alias("fixed_loss"), F.avg(F.col("b") - F.col("a")).alias("gain"))
    return out.select("split", "month", "windows", *[F.round(c, 9).alias(c) for c in ("actual_loss", "fixed_loss", "gain")])


# ---------------------------------------------------------------- samples, audits, months

FOLD = r"array_to_string(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), ' ')"


@query(
    "annual_samples",
    f"""with {POSTS_SQL}, s as (select *, {FOLD} as k from posts where {ELIGIBLE} qualify row_number() over (partition by year, subreddit order by md5(year || ':' || id), id) <= 20),
    a as (select * from s qualify row_number() over (partition by md5(k) order by created_utc, id) = 1)
    select 'before' as figure, '' as key, count(*) as n from s union all select 'after', '', count(*) from a
    union all select 'months', '', count(distinct (year, month)) from posts union all select 'year', year::varchar, count(*) from a group by year union all select 'board', subreddit, count(*) from a group by subreddit""",
)
def annual_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of each year in a table of its own, years that are there kept, their union without copies, and its report."""
    rows = posts(spark, sf_dir)
    root = fresh_path(spark, "samples")
    years = sorted(r["year"] for r in rows.select("year").distinct().collect())  # a dozen
    for some in (years[: len(years) // 2], years):
        sample.annual(rows, root, some, k=20)  # the second call makes only the years that are missing
    union = sample.read_annual(spark, root, years)
    return sample.report(union, dedup.first_dated(union), rows)


@query("kept_by_board", f"with {POSTS_SQL}, r as (select year, subreddit, {REASON} as reason from posts) select year, subreddit as board, count(*) as kept from r where reason = 'kept' group by all")
def kept_by_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = audit_report(posts(spark, sf_dir).withColumn("reason", clean.reason(F.col("text"))), ["year"])
    return audit.select("year", F.explode("by_board").alias("board", "kept"))


SUBMISSIONS = """raw as (select doc_id, case when doc_id % 23 = 0 then null else doc_id::varchar end as id, case when doc_id % 11 = 0 then 'pics' else 'Memes' end as subreddit,
    case when doc_id % 17 = 0 then '-86400' when doc_id % 19 = 0 then '1e99' when doc_id % 13 = 0 then '1300000000' else (1362096000 + doc_id)::varchar end as created_utc,
    case when doc_id % 7 = 0 then 'https://i.redd.it/x.png' else 'https://a.example/b' end as url, case when doc_id % 5 = 0 then '' else 'Title ' || doc_id end as title,
    case when doc_id % 3 = 0 then '[removed]' when doc_id % 2 = 0 then 'see ![cat](http://a.example/c) there' else '' end as selftext from documents)"""


@query(
    "submission_reasons",
    f"""with {SUBMISSIONS}, t as (select *, try_cast(created_utc as bigint) as created, case when doc_id % 3 > 0 and doc_id % 2 = 0 then 'see cat there' else '' end as body from raw),
    s as (select *, trim(title || chr(10) || body, ' ' || chr(10)) as text, case when subreddit = 'pics' then 'other_subreddit' when created is null then 'bad_timestamp'
      when strftime(make_timestamp(created * 1000000), '%Y-%m') <> '2013-03' then 'outside_month' end as early from t),
    r as (select *, coalesce(early, case when id is null then 'missing_or_duplicate_id' when text = '' then 'empty_or_removed' else 'kept' end) as reason from s)
    select reason, count(*) as n, count(*) filter (early is null and id is not null and doc_id % 7 = 0) as media_sources, count(*) filter (early is null and id is not null and contains(selftext, '![')) as image_references from r group by 1""",
)
def submission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw month of submissions: times before 1970 and beyond all years, media sources, titles without text and texts without title."""
    n, when = F.col("doc_id"), F.when
    rows = table(spark, sf_dir, "documents").select(
        F.lit(2013).alias("year"), F.lit(3).alias("month"), F.lit("submissions").alias("kind"),
        when(n % 23 == 0, None).otherwise(n.cast("string")).alias("id"), F.lit("someone").alias("author"), when(n % 11 == 0, "pics").otherwise("Memes").alias("subreddit"),
        when(n % 17 == 0, "-86400").when(n % 19 == 0, "1e99").when(n % 13 == 0, "1300000000").otherwise((n + 1362096000).cast("string")).alias("created_utc"),
        when(n % 7 == 0, "https://i.redd.it/x.png").otherwise("https://a.example/b").alias("url"), when(n % 5 == 0, "").otherwise(F.concat(F.lit("Title "), n.cast("string"))).alias("title"),
        when(n % 3 == 0, "[removed]").when(n % 2 == 0, "see ![cat](http://a.example/c) there").otherwise("").alias("selftext"), F.lit(None).cast("string").alias("body"),
    )
    made = clean.raw_reason(rows)
    return made.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("media_source").alias("media_sources"), F.count_if("image_reference").alias("image_references"))


# ---------------------------------------------------------------- model inputs


@query(
    "pooled_states",
    """with s as (select l_orderkey as id, l_quantity::double as a, l_discount::double as b from lineitem where l_linestatus = 'O')
    select o_orderkey as id, round(avg(a), 6) as a, round(avg(b), 6) as b from orders left join s on s.id = o_orderkey where exists (select 1 from lineitem where l_orderkey = o_orderkey) group by 1""",
)
def pooled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a sequence's states over the places that its mask keeps; lines of orders as tokens."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("state"), (F.col("l_linestatus") == "O").cast("int").alias("mask")))).alias("t"))
    mean = V.masked_mean(F.col("t.state"), F.col("t.mask"))
    return rows.select("id", mean.alias("m")).select("id", F.round(F.get("m", F.lit(0)), 6).alias("a"), F.round(F.get("m", F.lit(1)), 6).alias("b"))


@query(
    "rendered_choices",
    f"""with items as (select conv_id, text from conversations where turn = 0), e as (select c.conv_id, turn - 1 as ending, i.text as ctx, c.text as tail from conversations c join items i using (conv_id) where turn between 1 and 4),
    r as (select conv_id, ending, {ID_LIST.format("coalesce(ctx, '')")} as a, {ID_LIST.format("' ' || coalesce(tail, '')")} as b from e),
    l as (select conv_id, ending, list_sum([0.0] || list_transform(range(1, len(b) + 1), lambda i: ((b[i] + len(a) + i - 1) % 97) / 10.0)) as total, len(b) as n from r),
    p as (select conv_id, arg_min(ending, (round(total, 6), ending)) as by_sum, arg_min(ending, (round(total / n, 6), ending)) filter (n > 0) as by_mean from l group by 1)
    select count(*) as items, sum(by_sum)::bigint as by_sum, sum(by_mean)::bigint as by_mean, (select sum(len(a) + len(b))::bigint from r) as tokens, (select sum(n)::bigint from l) as scored from p""",
)
def rendered_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items: the first turn is the context, the next four are endings, rendered to tokens and a mask and judged by a stand-in loss."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    endings = rows.filter(F.col("turn").between(1, 4)).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("endings"))
    items = rows.filter("turn = 0").select(F.col("conv_id").alias("ind"), F.col("text").alias("ctx")).join(endings.withColumnRenamed("conv_id", "ind"), "ind")
    made = stored(scoring.choices(items), "rendered")
    losses = scoring.masked_losses(made, lambda token, place: ((token + place) % 97) / 10.0)
    rounded = losses.select("ind", "ending", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))
    best = rounded.groupBy("ind").agg(F.min_by("ending", F.struct("total", "ending")).alias("a"), F.min_by("ending", F.when(F.col("mean").isNotNull(), F.struct("mean", "ending"))).alias("b"))
    sizes = made.agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)).alias("scored"))
    return best.agg(F.count("*").alias("items"), F.sum("a").cast("long").alias("by_sum"), F.sum("b").cast("long").alias("by_mean")).crossJoin(sizes)  # two single rows


@query("unit_vectors", f"with {UNIT_SQL} select id, round(embedding[1]::double / len, 6) as first, round(list_sum(list_transform(embedding, lambda x: (x::double / len) * (x::double / len))), 6) as square from u")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", V.unit(F.col("embedding")).alias("v"))
    return rows.select("id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(V.dot(F.col("v"), F.col("v")), 6).alias("square"))


@query(
    "marked_texts",
    f"""with {POSTS_SQL} select id, md5('<|subreddit_' || subreddit || '|> ' || text) as marked_md5, split_part(text || '<|endoftext|>' || subreddit || '<|endoftext|>x', '<|endoftext|>', 2) as after_mark,
      strftime(make_timestamp(created_utc * 1000000), '%Y-%m') as month from posts""",
)
def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tokenizer reads of a post, the text behind an end mark, and a month from its running number."""
    rows = posts(spark, sf_dir)
    generated = F.concat("text", F.lit("<|endoftext|>"), "subreddit", F.lit("<|endoftext|>x"))
    number = F.col("year") * 12 + F.col("month") - 1
    return rows.select("id", F.md5(T.marked(F.col("subreddit"), F.col("text")).cast("binary")).alias("marked_md5"), T.after_mark(generated).alias("after_mark"), timeutil.month_label(number).alias("month"))


@query(
    "probe_scores",
    f"""with {UNIT_SQL}, {lex_docs_sql('where id in (select id from u)')}, {TFIDF_SQL},
    pr as (select a.id as probe, role, b.id as other, {DOT.format('a.embedding', 'b.embedding')} / (a.len * b.len) as cosine from u a, (values ('literal', 1), ('paraphrase', 2), ('unrelated', 3)) r(role, k), u b where a.id % 7 = 0 and b.id = a.id + k),
    s as (select 'embedding' as method, probe, role, round(cosine, 9) as score from pr union all select 'tfidf', probe, role, round(coalesce(lexical, 0), 9) from pr left join lex on child = other and parent = probe),
    w as (select method, probe, max(score) filter (role = 'literal') as l, max(score) filter (role = 'paraphrase') as p, max(score) filter (role = 'unrelated') as n from s group by all)
    select method, count(*) as probes, count(*) filter (l > n) as literal_wins, count(*) filter (p > n) as paraphrase_wins from w group by 1""",
)
def probe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector with the next three as its literal, paraphrased and unrelated companions, by vectors and by words."""
    rows = vectors(spark, sf_dir).select("id", "embedding")
    roles = F.array(*[F.struct(F.lit(name).alias("role"), (F.col("id") + k).alias("other")) for k, name in enumerate(("literal", "paraphrase", "unrelated"), 1)])
    probes = rows.filter("id % 7 = 0").select(F.col("id").alias("probe"), F.col("embedding").alias("a"), F.explode(roles).alias("r")).select("probe", "a", "r.*")
    met = probes.join(rows.select(F.col("id").alias("other"), F.col("embedding").alias("b")), "other").select("probe", "role", "other", F.round(V.cosine(F.col("a"), F.col("b")), 9).alias("cosine"))
    met = stored(met, "probes")
    lexical = _text_links(spark, sf_dir, met.select(F.col("other").alias("child"), F.col("probe").alias("parent"))).withColumnsRenamed({"child": "other", "parent": "probe"})
    by_vector = met.select(F.lit("embedding").alias("method"), "probe", "role", F.col("cosine").alias("score"))
    by_words = met.join(lexical, ["probe", "other"], "left").select(F.lit("tfidf").alias("method"), "probe", "role", F.round(F.coalesce("lexical", F.lit(0.0)), 9).alias("score"))
    return neighbors.probe_wins(by_vector.unionByName(by_words))


REQUESTS = """q as (select conv_id, turn, case when turn % 5 = 0 then left(coalesce(text, ''), 20) else ' ' || left(coalesce(text, ''), 100 + turn * 15) || ' ' end as prompt,
  case when conv_id % 11 = 0 then 'soon' when conv_id % 3 = 0 then (2003 + conv_id % 25)::varchar else (2009 + conv_id % 15)::varchar || '-0' || (1 + conv_id % 9)::varchar || '-15' end as date,
  case when conv_id % 13 = 0 then 'many' else (conv_id % 70)::varchar end as n from conversations)"""


@query(
    "generation_requests",
    f"""with {REQUESTS}, t as (select *, trim(prompt, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as p, try_cast(case when length(date) = 4 then date || '-07-01' else date end as date) as d, try_cast(date[1:4] as int) as y, try_cast(n as int) as k from q),
    r as (select *, case when d is null or y is null or k is null then 'invalid parameter' when not (length(p) between 1 and 160 and y between 2008 and 2024 and k between 1 and 64) then 'out of range'
      when len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')) not between 1 and 64 then 'prompt tokens' else 'ok' end as reason from t)
    select conv_id, turn, reason, case when reason = 'ok' then round((epoch(d) - 1293840000) / (1609459199 - 1293840000)::double, 9) end as tau from r""",
)
def generation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of conversations, some with bad dates, counts or prompts."""
    c, t = F.col("conv_id"), F.coalesce("text", F.lit(""))
    prompt = F.when(F.col("turn") % 5 == 0, F.substring(t, 1, 20)).otherwise(F.concat(F.lit(" "), F.substring(t, F.lit(1), (F.col("turn") * 15 + 100).cast("int")), F.lit(" ")))
    day = F.concat((c % 15 + 2009).cast("string"), F.lit("-0"), (c % 9 + 1).cast("string"), F.lit("-15"))
    date = F.when(c % 11 == 0, "soon").when(c % 3 == 0, (c % 25 + 2003).cast("string")).otherwise(day)
    reason, tau = requests.judged(prompt, date, F.when(c % 13 == 0, "many").otherwise((c % 70).cast("string")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"), F.round(tau, 9).alias("tau"))
