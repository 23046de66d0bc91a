"""Queries of token windows, schedules, raw months, phrase scores and link review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import patterns as P
from chronolith.functions import text as T
from chronolith.functions.vectors import softmax
from chronolith.operators import clean, schedule, tokens
from chronolith.plans.analysis import DOT, EDGE_SQL, FLOOR, VECTORS_SQL, _edges
from chronolith.plans.corpus import OFFSETS, REASON
from chronolith.plans.registry import query
from chronolith.sources.views import POSTS_SQL, posts, table, vectors

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
IDS = f"list_append(list_transform({WORDS}, lambda w: ('0x' || substr(md5(w), 1, 4))::int), 0)"
WINDOWS_SQL = f"""{POSTS_SQL}, {OFFSETS.replace(' as at', ' as pos')},
  flat as (select subreddit, created_utc, pos + i as place, ids[i + 1] as token from (select o.*, {IDS} as ids from o join posts using (id, subreddit, created_utc)), unnest(range(0, len(ids))) r(i)),
  last as (select subreddit, (max(place)) // 1024 as windows from flat group by 1),
  every_ as (select *, place // 1024 as w from flat union all select *, place // 1024 - 1 from flat where place % 1024 = 0 and place > 0)"""


SHOWN_WINDOWS = f"""with {WINDOWS_SQL} select every_.subreddit, w::bigint as window_no, count(*)::int as n, md5(string_agg(token::varchar, ' ' order by place)) as tokens_md5,
      round_even(sum(created_utc) filter (place < 1024 * (w + 1)) / 1024, 0)::bigint as created_utc
    from every_ join last using (subreddit) where w < windows group by all"""


def shown_windows(made: DataFrame) -> DataFrame:
    return made.select("subreddit", "window_no", F.size("tokens").alias("n"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), " ").cast("binary")).alias("tokens_md5"), "created_utc")


@query("window_tokens", SHOWN_WINDOWS)
def window_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_windows(tokens.token_windows(posts(spark, sf_dir).select("id", "subreddit", "created_utc", "text"), ["subreddit"], ["created_utc", "id"]))


@query(
    "token_ends",
    f"""with t as (select doc_id, {IDS} as ids from documents) select doc_id, array_to_string(ids[greatest(len(ids) - 63, 1):], ' ') as tail, array_to_string(ids[1:128], ' ') as head from t""",
)
def token_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("ids", F.concat(tokens.word_ids(F.col("text")), F.array(F.lit(0))))
    join = lambda c: F.array_join(c.cast("array<string>"), " ")
    return rows.select("doc_id", join(tokens.last_ids(F.col("ids"))).alias("tail"), join(tokens.first_ids(F.col("ids"))).alias("head"))


@query(
    "vocabulary_top",
    f"""with t as (select source, unnest({IDS}) as token from documents), c as (select source, token, count(*) as n from t group by all)
    select source, token, n, row_number() over (partition by source order by n desc, token)::int as place from c qualify place <= 50""",
)
def vocabulary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.concat(tokens.word_ids(F.col("text")), F.array(F.lit(0))).alias("ids"))
    return tokens.top_ids(rows, ["source"], "ids", 50)


#: A raw partition made of documents: boards, times, ids and links such that every static rule has rows.
RAW = f"""raw as (select case when doc_id % 23 = 0 then null when doc_id % 29 = 0 then 'x7' else doc_id::varchar end as id,
    case when doc_id % 19 = 0 then 'AutoModerator' else 'User' || (doc_id % 5) end as author, case when doc_id % 11 = 0 then 'pics' when doc_id % 2 = 0 then 'Memes' else 'dogelore' end as subreddit,
    case when doc_id % 17 = 0 then 'abc' when doc_id % 13 = 0 then '1300000000' else (1362096000 + doc_id)::varchar end as created_utc, doc_id,
    case when doc_id % 7 = 0 then 'https://i.redd.it/x.png' else 'https://a.example/b' end as url,
    case when doc_id % 31 = 0 then '[removed]' when doc_id % 37 = 0 then 'http://a.example/' || repeat('b', 60) when doc_id % 41 = 0 then '<img src=x>' || 'picture text' else substr(regexp_replace(text, '[^a-z ]', '', 'g'), 1, 13000) end as body from documents)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, when = F.col("doc_id"), F.when
    rows = table(spark, sf_dir, "documents")
    body = when(n % 31 == 0, "[removed]").when(n % 37 == 0, "http://a.example/" + "b" * 60).when(n % 41 == 0, "<img src=x>picture text").otherwise(F.substring(F.regexp_replace("text", "[^a-z ]", ""), 1, 13000))
    return rows.select(
        F.lit(2013).alias("year"), F.lit(3).alias("month"), F.lit("comments").alias("kind"), "doc_id",
        when(n % 23 == 0, None).when(n % 29 == 0, "x7").otherwise(n.cast("string")).alias("id"), when(n % 19 == 0, "AutoModerator").otherwise(F.concat(F.lit("User"), (n % 5).cast("string"))).alias("author"),
        when(n % 11 == 0, "pics").when(n % 2 == 0, "Memes").otherwise("dogelore").alias("subreddit"), when(n % 17 == 0, "abc").when(n % 13 == 0, "1300000000").otherwise((n + 1362096000).cast("string")).alias("created_utc"),
        when(n % 7 == 0, "https://i.redd.it/x.png").otherwise("https://a.example/b").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("selftext"), body.alias("body"),
    )


@query(
    "month_reasons",
    f"""with {RAW}, t as (select *, try_cast(created_utc as bigint) as created, trim(regexp_replace(replace(body, '<img src=x>', ''), ' +', ' ', 'g')) as text from raw),
    s as (select *, case when lower(subreddit) not in ({', '.join(f"'{b}'" for b in P.BOARDS)}) then 'other_subreddit' when created is null then 'bad_timestamp'
      when strftime(make_timestamp(created * 1000000), '%Y-%m') <> '2013-03' then 'outside_month' end as early from t),
    d as (select *, row_number() over (partition by id, early is null order by created) as turn from s),
    r as (select *, coalesce(early, case when id is null or turn > 1 then 'missing_or_duplicate_id' when lower(text) in ('', '[deleted]', '[removed]') then 'empty_or_removed'
      when lower(author) = 'automoderator' then 'bot_or_moderation' else {REASON} end) as reason from d)
    select reason, count(*) as n, count(*) filter (early is null and not (id is null or turn > 1) and contains(body, '<img')) as image_references from r group by 1""",
)
def month_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clean.raw_reason(_raw(spark, sf_dir))
    return made.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("image_reference").alias("image_references"))


SCAN_SQL = """p as (select distinct ts::date as day, event_type as kind from events), n as (select *, row_number() over (order by day, kind) as no from p),
  s as (select *, no % 5 = 0 as done, case no % 4 when 0 then 'running' when 1 then 'failed' when 2 then 'success' end as state, (no % 4)::int as attempts, (no % 3 = 0)::int as checks from n),
  q as (select day::varchar as day, kind, case when done then 'complete' when state = 'running' then 'running' when state = 'success' and checks + 1 < 2 then 'checked'
    when coalesce(attempts, 0) >= 3 then 'failed' else 'queued' end as status, attempts as was from s)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.operators.prefix import running_before

    parts = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("kind")).distinct()
    no = running_before(parts.withColumn("one", F.lit(1)), ["day", "kind"], "one", "before").withColumn("no", F.col("before") + 1)
    state = F.when(F.col("no") % 4 == 0, "running").when(F.col("no") % 4 == 1, "failed").when(F.col("no") % 4 == 2, "success")
    jobs = no.select("day", "kind", state.alias("state"), (F.col("no") % 4).cast("int").alias("attempts"), (F.col("no") % 3 == 0).cast("int").alias("checks"))
    return schedule.scan(no.select("day", "kind"), no.filter("no % 5 = 0"), jobs, ["day", "kind"])


@query("scheduled_scan", f"with {SCAN_SQL} select day, kind, status, (was + (status = 'queued')::int)::int as attempts from q")
def scheduled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir)


@query(
    "completion_barrier",
    f"""with {SCAN_SQL} select count(*) filter (status = 'complete') as complete, count(*) filter (status = 'running') as running, count(*) filter (status = 'checked') as checked,
      count(*) filter (status = 'queued') as queued, count(*) filter (status = 'failed') as failed, count(*) as total, count(*) filter (status = 'complete') = count(*) as all_done from q""",
)
def completion_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.barrier(_scanned(spark, sf_dir))


@query("partition_paths", "select distinct printf('%04d/%02d/%s', year(o_orderdate), month(o_orderdate), lower(o_orderstatus)) as path from orders")
def partition_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.lower("o_orderstatus").alias("kind")).distinct()
    return rows.select(schedule.partition_path().alias("path"))


@query("resumable_partitions", "select distinct o_orderpriority as part from orders where o_orderpriority not in (select o_orderpriority from orders where year(o_orderdate) = 1995 group by 1 having count(*) % 2 = 0)")
def resumable_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.year("o_orderdate").alias("year"))
    audits = rows.filter("year = 1995").groupBy("part").agg(F.count("*").alias("n")).select("part", F.concat(F.lit("v"), (F.col("n") % 2).cast("string")).alias("version"))
    return schedule.resumable(rows.select("part").distinct(), audits, ["part"], "v0")


@query(
    "link_review",
    f"""with {EDGE_SQL}, t as (select vec_id as id, length(text) as n from embeddings join documents on doc_id = vec_id)
    select child, parent, round(cosine, 6) as cosine from edge join t a on a.id = child join t b on b.id = parent
    where fc <> fp and a.n >= 15 and b.n >= 15 order by edge.cosine desc, child limit 30""",
)
def link_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between families whose texts have 15 characters and more, the nearest 30."""
    rows = vectors(spark, sf_dir).select("id", "family").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n")), "id").filter("n >= 15")
    ends = lambda side: rows.select(F.col("id").alias(side), F.col("family").alias(f"family_{side}"))
    both = _edges(spark, sf_dir).join(ends("child"), "child").join(ends("parent"), "parent").filter("family_child <> family_parent")
    return both.orderBy(F.desc("cosine"), "child").limit(30).select("child", "parent", F.round("cosine", 6).alias("cosine"))


@query(
    "selection_consistency",
    f"""with {EDGE_SQL}, top as (select child, parent from edge order by edge.cosine desc, child limit 30)
    select count(*) as selected, count(edge.child) as present, count(*) filter (edge.cosine < {FLOOR}) as below from top left join edge using (child, parent)""",
)
def selection_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the reviewed links exist in the graph, at or above its floor."""
    edges = _edges(spark, sf_dir).select("child", "parent", "cosine")
    top = edges.orderBy(F.desc("cosine"), "child").limit(30).select("child", "parent")
    found = top.join(edges, ["child", "parent"], "left")
    return found.agg(F.count("*").alias("selected"), F.count("cosine").alias("present"), F.count_if(F.col("cosine") < FLOOR).alias("below"))


@query(
    "aligned_series",
    """with s as (select event_type, event_id % 500 as step, avg(value) as v from events group by all)
    select a.step, round(a.v, 6) as click, round(b.v, 6) as view, round(a.v - b.v, 6) as gap from s a join s b using (step)
    where a.event_type = (select min(event_type) from events) and b.event_type = (select max(event_type) from events)""",
)
def aligned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series joined on their steps."""
    rows = table(spark, sf_dir, "events")
    ends = rows.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    s = rows.groupBy("event_type", (F.col("event_id") % 500).alias("step")).agg(F.avg("value").alias("v"))
    one = lambda kind, name: s.filter(F.col("event_type") == kind).select("step", F.col("v").alias(name))
    both = one(ends["a"], "click").join(one(ends["b"], "view"), "step")
    return both.select("step", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"), F.round(F.col("click") - F.col("view"), 6).alias("gap"))


@query("distinct_months", "select array_to_string(list_sort(list_distinct(list(strftime(o_orderdate, '%Y-%m')))), ',') as months from orders")
def distinct_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.array_join(F.sort_array(F.collect_set(F.date_format("o_orderdate", "yyyy-MM"))), ",").alias("months"))


@query(
    "milestones",
    """with m as (select distinct (l_quantity * 1000)::bigint as m from lineitem), w as (select o_orderkey, o_orderkey % 60000 as low from orders)
    select o_orderkey, count(m)::int as crossed from w left join m on m > low and m <= low + 3000 group by o_orderkey""",
)
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the distinct milestones lie in (before, after] of each step."""
    found = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 1000).cast("long").alias("m"))
    steps = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 60000).alias("low"))
    return schedule.crossed(steps.withColumn("high", F.col("low") + 3000), found, "o_orderkey", "m", cell=3000)


@query("valid_requests", "select event_id, value between 0 and 20 and length(event_type) between 1 and 6 and user_id % 10 <= 5 as ok from events")
def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value").between(0, 20) & F.length("event_type").between(1, 6) & (F.col("user_id") % 10 <= 5)
    return table(spark, sf_dir, "events").select("event_id", ok.alias("ok"))


@query("shards_by_split", "select count(*) as shards, sum(n)::bigint as rows from (select o_orderpriority, count(*) as n from orders group by 1)")
def shards_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).agg(F.count("*").alias("shards"), F.sum("n").alias("rows"))


@query(
    "pooled_vectors",
    f"""with {VECTORS_SQL}, d as (select id, family, i, embedding[i]::double as x from vectors, unnest(range(1, 65)) r(i)), m as (select family, i, avg(x) filter (id % 3 > 0) as m from d group by all)
    select family, round(sum(m * m), 6) as square from m group by 1""",
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each family over the rows that the mask keeps."""
    flat = vectors(spark, sf_dir).filter("id % 3 > 0").select("family", F.posexplode("embedding").alias("i", "x"))
    return flat.groupBy("family", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("family").agg(F.round(F.sum(F.col("m") * F.col("m")), 6).alias("square"))


@query(
    "cross_entropy",
    f"""with {VECTORS_SQL}, s as (select id, family, embedding, list_sum(list_transform(embedding, lambda x: exp(x::double))) as z from vectors)
    select family, round(avg(ln(z) - embedding[family + 1]::double), 6) as loss from s group by 1""",
)
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean negative log softmax of the label's place."""
    rows = vectors(spark, sf_dir).select("family", softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return rows.groupBy("family").agg(F.round(F.avg(-F.ln(F.get("p", F.col("family").cast("int")))), 6).alias("loss"))


HITS_SQL = rf"""{POSTS_SQL}, line as (select id, year, month, regexp_extract_all(lower((regexp_extract(text, '^[^\n]*'))[1:300]), '([a-z][a-z'']*)') as w from posts),
  wanted as (select distinct array_to_string(w[s + 1:s + k], ' ') as phrase from (select regexp_extract_all(lower(text), '([a-z][a-z'']*)') as w from benchmark), unnest(range(0, len(w))) r(s), (values (2), (3), (4)) z(k) where s + k <= len(w) and s < 3),
  run as (select distinct id, year, month, array_to_string(w[s + 1:s + k], ' ') as phrase from line, unnest(range(0, len(w))) r(s), (values (2), (3), (4)) z(k) where s + k <= len(w)),
  hit as (select year, month, phrase, count(*) as hits from run join wanted using (phrase) group by all)"""


def _phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.operators.phrases import line_hits

    ws = table(spark, sf_dir, "benchmark").select(T.phrase_words(F.col("text")).alias("w"))
    wanted = ws.select(F.explode(F.concat(*[F.slice(T.runs(F.col("w"), k), 1, 3) for k in (2, 3, 4)])).alias("phrase")).distinct()
    return line_hits(posts(spark, sf_dir), wanted)


@query("phrase_line_hits", f"with {HITS_SQL} select year, month, phrase, hits, documents from hit join (select year, month, count(*) as documents from posts group by all) using (year, month)")
def phrase_line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = posts(spark, sf_dir).groupBy("year", "month").agg(F.count("*").alias("documents"))
    return _phrase_hits(spark, sf_dir).join(documents, ["year", "month"])


@query(
    "phrase_score_slopes",
    f"""with {HITS_SQL}, g as (select phrase, d, c, -(('0x' || substr(md5(phrase || ':' || d || ':' || c), 1, 6))::bigint / 1e6) as lp from (select distinct phrase from hit), range(2) a(d), range(3) b(c)),
    m as (select phrase, avg(lp) filter (d = 1) - avg(lp) filter (d = 0) as slope from g group by 1), n as (select phrase, sum(hits)::bigint as hits from hit group by 1)
    select phrase, round(slope, 6) as slope, hits from m join n using (phrase) order by m.slope desc, phrase limit 30""",
)
def phrase_score_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases scored in three contexts at two dates by a scorer that is passed in, joined with their counts; the 30 steepest."""
    from chronolith.operators.phrases import score_slopes

    counts = _phrase_hits(spark, sf_dir).groupBy("phrase").agg(F.sum("hits").alias("hits"))
    scorer = lambda phrase, date, context: -(F.conv(F.substring(F.md5(F.concat_ws(":", phrase, date.cast("string"), context.cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") / 1e6)
    made = score_slopes(counts.select("phrase"), scorer, contexts=3)
    return made.join(counts, "phrase").orderBy(F.desc("slope"), "phrase").limit(30).select("phrase", F.round("slope", 6).alias("slope"), "hits")
