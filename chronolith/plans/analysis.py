"""Queries of the similarity and statistics engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import text as T
from chronolith.functions.vectors import divergence
from chronolith.operators import graph, methods, neighbors, phrases, scoring, stats
from chronolith.operators.quantiles import quantiles
from chronolith.plans.registry import query
from chronolith.shared import stored
from chronolith.sources.views import POSTS_SQL, VECTORS_SQL, posts, table, vectors

#: The links' cosine floor; 0.85 in production, lower for the test vectors, whose cosines stay below 0.6.
FLOOR = 0.3

DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::double * {1}[i]::double))"
UNIT_SQL = f"{VECTORS_SQL}, u as (select id, family, embedding, sqrt({DOT.format('embedding', 'embedding')}) as len from vectors)"
PAIR_SQL = f"""{UNIT_SQL}, pair as (select c.id as child, p.id as parent, c.family as fc, p.family as fp, (c.id - p.id)::double as gap,
    {DOT.format('c.embedding', 'p.embedding')} / (c.len * p.len) as cosine from u c join u p on p.id < c.id)"""
EDGE_SQL = f"""{PAIR_SQL}, best as (select child, unnest(arg_max({{'parent': parent, 'cosine': cosine, 'gap': gap, 'fc': fc, 'fp': fp}}, cosine - 0.0002 * gap)) from pair group by child),
  edge as (select * from best where cosine >= {FLOOR})"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.earlier_neighbour(vectors(spark, sf_dir), alpha=0.02, per_year=100.0)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph._written(_links(spark, sf_dir).filter(F.col("cosine") >= FLOOR))


@query("earlier_neighbor", f"with {EDGE_SQL} select child, parent, round(cosine, 6) as cosine, round(gap / 100, 6) as gap from best")
def earlier_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("child", "parent", F.round("cosine", 6).alias("cosine"), F.round("gap", 6).alias("gap"))


@query("bounded_neighbor", f"with {EDGE_SQL} select child, parent, round(cosine, 6) as cosine, round(gap / 100, 6) as gap from best")
def bounded_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from clusters whose bounds decide which blocks are multiplied."""
    made, _ = neighbors.bounded_neighbour(vectors(spark, sf_dir), alpha=0.02, per_year=100.0, block=64, pivots=16)
    return made.select("child", "parent", F.round("cosine", 6).alias("cosine"), F.round("gap", 6).alias("gap"))


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def lex_docs_sql(where: str = "") -> str:
    """Words are found once a document, before the pairs of neighbours are made."""
    return f"""lex_words as (select doc_id as id, {WORDS} as w from documents),
  lex_docs as (select id, list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as ws from lex_words {where})"""


TFIDF_SQL = """n as (select count(*) as n from lex_docs),
  tf as (select id, term, count(*) as tf from (select id, unnest(ws) as term from lex_docs) group by all),
  df as (select term, count(*) as df from tf group by 1),
  raw as (select id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) as x from tf join df using (term), n),
  wt as (select id, term, x / sqrt(sum(x * x) over (partition by id)) as w from raw),
  lex as (select a.id as child, b.id as parent, sum(a.w * b.w) as lexical from wt a join wt b using (term) where b.id < a.id group by all)"""


def _text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.word_grams(F.col("text")).alias("ws"))


def _text_links(spark: SparkSession, sf_dir: str, links: DataFrame) -> DataFrame:
    """child, parent, lexical of links by the texts of the vectors' documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return neighbors.text_links(docs, vectors(spark, sf_dir).select("id"), links, T.word_grams)


@query(
    "neighbor_methods",
    f"""with {PAIR_SQL}, {lex_docs_sql('where id in (select id from vectors)')}, {TFIDF_SQL},
    p as (select pair.*, coalesce(lexical, 0) as lexical from pair left join lex using (child, parent)),
    q as (select *, case when max(cosine) over w > min(cosine) over w then (cosine - min(cosine) over w) / (max(cosine) over w - min(cosine) over w) else 0 end as scaled,
      row_number() over (partition by child order by round(lexical, 9) desc, parent) as place from p window w as (partition by child)),
    s as (select 'semantic' as method, *, cosine as s from q union all select 'semantic_time', *, cosine - 0.0003 * gap from q union all select 'lexical', *, lexical from q
      union all select 'hybrid', *, 0.5 * scaled + 0.5 * lexical - 0.0003 * gap from q union all select 'lexical_gate20', *, cosine from q where place <= 20),
    b as (select * from s qualify row_number() over (partition by method, child order by round(s, 9) desc, parent) = 1)
    select method, count(*) as links, round(avg((fc = fp)::int), 6) as same_family, round(avg(gap), 6) as mean_gap, round(avg(cosine), 6) as mean_cosine from b group by method""",
)
def neighbor_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    best = methods.five_methods(vectors(spark, sf_dir), docs, T.word_grams, gate=20, alpha=0.03, per_year=100.0)
    return best.groupBy("method").agg(F.count("*").alias("links"), F.round(F.avg((F.col("family_c") == F.col("family_p")).cast("int")), 6).alias("same_family"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.avg("cosine"), 6).alias("mean_cosine"))


@query(
    "null_threshold",
    f"""with {UNIT_SQL}, k as (select *, row_number() over (order by id) - 1 as no, count(*) over () as n from u),
    d as (select i, ('0x' || substr(md5('null:a:' || i), 1, 8))::bigint % (select count(*) from u) as a, ('0x' || substr(md5('null:b:' || i), 1, 8))::bigint % (select count(*) from u) as b from range(100000) r(i))
    select count(*) as pairs, round(quantile_cont({DOT.format('x.embedding', 'y.embedding')} / (x.len * y.len), 0.999), 6) as floor,
      round(avg({DOT.format('x.embedding', 'y.embedding')} / (x.len * y.len)), 6) as mean
    from d join k x on x.no = a join k y on y.no = b where a <> b""",
)
def null_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = stored(neighbors.random_pairs(vectors(spark, sf_dir), 100000, "null"), "null", 100000)
    floor = F.lit(quantiles(null, "cosine", [0.999])[0]).cast("double")
    return null.agg(F.count("*").alias("pairs"), F.round(floor, 6).alias("floor"), F.round(F.avg("cosine"), 6).alias("mean"))


ROOT_SQL = f"""{EDGE_SQL}, up(id, top) as (select id, id from u union all select up.id, edge.parent from up join edge on edge.child = up.top),
  lab as (select id, min(top) as root from up group by id)"""


def _labelled(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    return graph.roots(vectors(spark, sf_dir).select("id"), edges)


@query("forest_components", f"with recursive {ROOT_SQL}, c as (select root, count(*) as size from lab group by 1) select root, size, (row_number() over (order by size desc, root) - 1)::int as index from c where size >= 3")
def forest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_labelled(spark, sf_dir, _edges(spark, sf_dir)), least=3)


@query(
    "component_profile",
    f"""with recursive {ROOT_SQL}, m as (select lab.*, family from lab join u using (id))
    select root, count(*) as size, min(id) as first_id, max(id) as last_id, array_to_string(list_sort(list(id))[1:3], ',') as early,
      count(distinct family) as families from m group by root having count(*) >= 3""",
)
def component_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labelled(spark, sf_dir, _edges(spark, sf_dir))
    lab = labels.join(vectors(spark, sf_dir).select("id", "family"), "id")
    made = lab.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("family").alias("families")).filter("size >= 3")
    early = labels.withColumn("rn", F.row_number().over(stats.Window.partitionBy("root").orderBy("id"))).filter("rn <= 3").groupBy("root").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("early"))
    return made.join(early, "root")


@query(
    "component_hubs",
    f"""with recursive {ROOT_SQL}, deg as (select parent as id, count(*) as children from edge group by 1)
    select root, id, children, (row_number() over (partition by root order by children desc, id))::int as place from lab join deg using (id)
    qualify row_number() over (partition by root order by children desc, id) <= 3""",
)
def component_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.hubs(_labelled(spark, sf_dir, edges), edges).select("root", "id", "children", "place")


@query("branch_candidates", f"with {EDGE_SQL} select parent, count(*) as children from edge group by 1 having count(*) >= 2 order by children desc, parent limit 15")
def branch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("children")).filter("children >= 2").orderBy(F.desc("children"), "parent").limit(15)


@query("top_edges", f"with {EDGE_SQL} select child, parent, round(cosine, 6) as cosine from edge order by edge.cosine desc, child limit 30")
def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).orderBy(F.desc("cosine"), "child").limit(30).select("child", "parent", F.round("cosine", 6).alias("cosine"))


@query("link_metrics", f"with {EDGE_SQL} select count(*) as links, round(count(*) / ((select count(*) from u) - 1), 6) as rate, round(avg((fc = fp)::int), 6) as same_family, round(avg(gap) / 100, 6) as mean_gap, round(avg((fc <> fp)::int) filter (child <= 250), 6) as cross_early from edge")
def link_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    f = rows.select("id", "family")
    e = _edges(spark, sf_dir).join(f.withColumnsRenamed({"id": "child", "family": "fc"}), "child").join(f.withColumnsRenamed({"id": "parent", "family": "fp"}), "parent")
    same = (F.col("fc") == F.col("fp")).cast("int")
    return e.agg(F.count("*").alias("links"), F.round(F.count("*") / (rows.count() - 1), 6).alias("rate"), F.round(F.avg(same), 6).alias("same_family"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.avg(F.when(F.col("child") <= 250, 1 - same)), 6).alias("cross_early"))


@query(
    "induced_subgraph",
    f"""with recursive {ROOT_SQL}, big as (select root from lab group by 1 having count(*) >= 3), keep as (select id from lab where root in (select root from big))
    select child, parent, round(cosine, 6) as cosine from edge where child in (select id from keep) and parent in (select id from keep)""",
)
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    lab = _labelled(spark, sf_dir, edges)
    big = lab.groupBy("root").agg(F.count("*").alias("n")).filter("n >= 3").select("root")
    return graph.induced(edges, lab.join(big, "root", "left_semi")).select("child", "parent", F.round("cosine", 6).alias("cosine"))


@query(
    "graph_faults",
    f"""with {EDGE_SQL}, nodes as (select id from u union all select id from u where id % 97 = 0), planted as (select child, parent from edge
      union all select parent, child from edge where child % 5 = 0 union all select child, -parent - 1 from edge where child % 7 = 0)
    select (select count(*) from (select id from nodes group by 1 having count(*) > 1)) as repeated,
      (select count(*) from (select child as id from planted union all select parent from planted) where id not in (select id from nodes)) as dangling,
      (select count(*) from planted where parent >= child) as backward""",
)
def graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links with some turned round and some to no node, and some nodes twice: all of it must be counted."""
    ids, edges = vectors(spark, sf_dir).select("id"), _edges(spark, sf_dir).select("child", "parent")
    turned = edges.filter("child % 5 = 0").select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    lost = edges.filter("child % 7 = 0").select("child", (-F.col("parent") - 1).alias("parent"))
    return graph.faults(ids.unionByName(ids.filter("id % 97 = 0")), edges.unionByName(turned).unionByName(lost))


def _shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("child", "parent", F.round("cosine", 6).alias("cosine"), F.round("gap", 6).alias("gap"))


GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="n_family" for="node" attr.name="family" attr.type="int"/>',
    '<key id="e_cosine" for="edge" attr.name="cosine" attr.type="double"/>', '<key id="e_gap" for="edge" attr.name="gap" attr.type="double"/>', '<graph edgedefault="directed">',
)


@query(
    "graph_export",
    f"""with {EDGE_SQL} select * from (values {", ".join(f"(0, '{k:04}', '{x}')" for k, x in enumerate(GRAPHML_HEAD))}, (3, '0', '</graph></graphml>')) t(part, key, line)
    union all select 1, id::varchar, '<node id="' || id || '"><data key="n_family">' || family || '</data></node>' from u
    union all select 2, parent || '->' || child, '<edge source="' || parent || '" target="' || child || '"><data key="e_cosine">' || round(cosine, 6) || '</data><data key="e_gap">' || round(gap / 100, 6) || '</data></edge>' from edge""",
)
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graphml_lines(vectors(spark, sf_dir).select("id", "family"), _shown_edges(spark, sf_dir))


@query(
    "cytoscape_export",
    f"""with {EDGE_SQL} select 'node' as kind, '{{"data":{{"id":"' || id || '","family":' || family || '}}}}' as json from u
    union all select 'edge', '{{"data":{{"id":"' || parent || '->' || child || '","source":"' || parent || '","target":"' || child || '","cosine":' || round(cosine, 6) || ',"gap":' || round(gap / 100, 6) || '}}}}' from edge""",
)
def cytoscape_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cytoscape_rows(vectors(spark, sf_dir).select("id", "family"), _shown_edges(spark, sf_dir))


@query("tfidf_parent", f"with {lex_docs_sql()}, {TFIDF_SQL} select child, parent, round(lexical, 6) as lexical from lex qualify row_number() over (partition by child order by round(lexical, 9) desc, parent) = 1")
def tfidf_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = neighbors.lexical_parent(neighbors.tfidf(_text_words(spark, sf_dir), F.col("ws")))
    return best.select("child", "parent", F.round("lexical", 6).alias("lexical"))


OCC_SQL = rf"""line as (select id, created_utc, (regexp_extract(text, '^[^\n]*'))[1:300] as line from posts),
  ws as (select *, regexp_extract_all(lower(line), '([a-z][a-z'']*)') as ws from line),
  g as (select id, created_utc, line, s::int as s, array_to_string(ws[s + 1:s + k], ' ') as phrase, ws[s + 1:s + k] as t from ws, unnest(range(4, greatest(len(ws), 4))) r(s), (values (2), (3), (4)) z(k) where s + k <= len(ws)),
  f as (select id, created_utc, line, phrase, min(s) as s from g
    where not (list_contains(stop(), t[1]) and list_contains(stop(), t[-1])) and len(list_filter(t, lambda x: length(x) >= 5 and not list_contains(stop(), x))) > 0 group by all)"""
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in phrases.P.STOP) + "]"
OCC_SQL = OCC_SQL.replace("stop()", STOP_SQL)


@query(
    "ngram_candidates",
    f"""with {POSTS_SQL}, {OCC_SQL}, c as (select phrase, count(*) as sample_count from f group by 1 having count(*) between 3 and 300)
    select phrase, sample_count from c order by md5(phrase), phrase limit 1000""",
)
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = phrases.occurrences(posts(spark, sf_dir))
    return occ.groupBy("phrase").agg(F.count("*").alias("sample_count")).filter(F.col("sample_count").between(3, 300)).orderBy(F.md5(F.col("phrase").cast("binary")), "phrase").limit(1000)


# The text before a phrase: the words in front of it, each with what precedes it, and what precedes the phrase itself.
CONTEXT_SQL = rf"""{OCC_SQL}, x as (select *, regexp_extract_all(line, '[^A-Za-z]*[A-Za-z][A-Za-z'']*') as piece from f),
  v as (select id, created_utc, phrase, regexp_extract_all(array_to_string(piece[1:s], '') || regexp_extract(piece[s + 1], '^[^A-Za-z]*'), '[^\x20\x09-\x0D]+') as shown from x),
  o as (select id, created_utc, phrase, case when len(shown) >= 4 then array_to_string(shown[greatest(len(shown) - 15, 1):len(shown)], ' ') end as context from v)"""


@query(
    "phrase_contexts",
    f"""with {POSTS_SQL}, {CONTEXT_SQL},
    c as (select phrase, count(*) as sample_count from o group by 1 having count(*) between 3 and 300 and count(context) >= 3 order by md5(phrase), phrase limit 1000),
    t as (select o.*, sample_count from o join c using (phrase) where context is not null qualify row_number() over (partition by phrase order by created_utc, id) <= 3)
    select phrase, sample_count, string_agg(context, ' | ' order by created_utc, id) as contexts from t group by all""",
)
def phrase_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = phrases.candidates(phrases.occurrences(posts(spark, sf_dir)))
    return made.select("phrase", "sample_count", F.array_join("contexts", " | ").alias("contexts"))


MONTH_SQL = rf"""wanted as (select distinct unnest(list_transform(range(0, greatest(len(w) - 2, 0)), lambda i: array_to_string(w[i + 1:i + 3], ' '))) as phrase
    from (select regexp_extract_all(lower(text), '([a-z][a-z'']*)') as w from benchmark)),
  run as (select id, year, month, unnest(list_distinct(list_transform(range(0, greatest(len(w) - 2, 0)), lambda i: array_to_string(w[i + 1:i + 3], ' ')))) as phrase
    from (select id, year, month, regexp_extract_all(lower(text), '([a-z][a-z'']*)') as w from posts)),
  hits as (select year, month, phrase, count(*) as hits from run join wanted using (phrase) group by all)"""


def _month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "benchmark").select(T.phrase_words(F.col("text")).alias("w")).select(F.explode(T.runs(F.col("w"), 3)).alias("phrase"))
    return phrases.month_counts(posts(spark, sf_dir), wanted, 3)


@query("phrase_month_counts", f"with {POSTS_SQL}, {MONTH_SQL} select year, month, phrase, hits from hits")
def phrase_month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month_counts(spark, sf_dir)


@query(
    "phrase_growth",
    f"""with {POSTS_SQL}, {MONTH_SQL}, d as (select sum((year <= 2016)::int) as before, sum((year > 2016)::int) as after from posts),
    s as (select phrase, coalesce(sum(hits) filter (year <= 2016), 0) as b, coalesce(sum(hits) filter (year > 2016), 0) as a from hits group by 1)
    select phrase, b::bigint as hits_before, a::bigint as hits_after, round(ln(((a + 0.5) / after * 1e6) / ((b + 0.5) / before * 1e6)), 6) as growth from s, d""",
)
def phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("year") <= 2016
    d = posts(spark, sf_dir).agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after")).first()
    s = _month_counts(spark, sf_dir).groupBy("phrase").agg(F.coalesce(F.sum(F.when(early, F.col("hits"))), F.lit(0)).alias("hits_before"), F.coalesce(F.sum(F.when(~early, F.col("hits"))), F.lit(0)).alias("hits_after"))
    growth = F.ln(stats.smoothed_rate(F.col("hits_after"), F.lit(d["after"])) / stats.smoothed_rate(F.col("hits_before"), F.lit(d["before"])))
    return s.withColumn("growth", F.round(growth, 6))


@query(
    "spearman",
    """with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2 as b from part)
    select round(corr(a, b), 6) as rho, count(*) as n from r""",
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("rho", 6).alias("rho"), "n")


@query("top_decile", "with c as (select quantile_cont(c_acctbal, 0.9) as cut from customer) select round(any_value(cut), 6) as cut, round(avg(c_custkey) filter (c_acctbal >= cut), 6) as top_mean, round(avg(c_custkey), 6) as mean from customer, c")
def top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stats.top_share_mean(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey")
    return made.select(*[F.round(c, 6).alias(c) for c in made.columns])


@query(
    "block_bootstrap",
    """with s as (select ts::date as day, sum(value) as s, count(value) as n, row_number() over (order by ts::date) - 1 as no from events group by 1),
    d as (select i as draw, ('0x' || substr(md5('boot:' || i || ':' || j), 1, 8))::bigint % (select count(*) from s) as no from range(10000) a(i), range((select count(*) from s)) b(j)),
    m as (select draw, sum(s) / sum(n) as m from d join s using (no) group by 1)
    select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, (select round(avg(value), 6) from events) as mean from m""",
)
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stats.block_bootstrap(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", "value", 10000)
    return made.select(*[F.round(c, 6).alias(c) for c in made.columns])


@query(
    "permutation_null",
    f"""with {EDGE_SQL}, fixed as (select id, family, row_number() over (order by id) - 1 as no, count(*) over () as n from u),
    keys as (select i as draw, list({{'c': ('0x' || substr(h, 1, 8))::bigint % n, 'a': ('0x' || substr(h, 9, 8))::bigint % 2147483646 + 1, 'b': ('0x' || substr(h, 17, 8))::bigint % 2147483647}} order by j) as ks
      from (select i, j, md5('perm:' || i || ':' || j) as h, (select count(*) from u) as n from range(100) a(i), range(24) b(j)) group by 1),
    dealt as (select draw, id, list_reduce(list_prepend({{'c': no::bigint, 'a': n::bigint, 'b': 0::bigint}}, ks), lambda x, k: {{'c':
      case when ((greatest(x.c, (k.c - x.c + x.a) % x.a) * k.a + k.b) % 2147483647 >> 16) % 2 = 1 then (k.c - x.c + x.a) % x.a else x.c end, 'a': x.a, 'b': 0::bigint}}).c as place from fixed, keys),
    drawn as (select draw, dealt.id, fixed.family from dealt join fixed on fixed.no = place),
    r as (select a.draw, avg((a.family = b.family)::int) as r from edge join drawn a on a.id = child join drawn b on b.id = parent and a.draw = b.draw group by 1)
    select round(avg(r), 6) as null_mean, round(stddev_pop(r), 6) as null_sd, (select round(avg((fc = fp)::int), 6) from edge) as observed from r""",
)
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stats.permutation_null(_edges(spark, sf_dir), vectors(spark, sf_dir).select("id", "family"), 100)
    return made.select(*[F.round(c, 6).alias(c) for c in made.columns])


@query("paired_gain", "select l_returnflag as kind, month(l_shipdate)::int as month, count(*) as n, round(avg(l_tax), 6) as a, round(avg(l_discount), 6) as b, round(avg(l_discount - l_tax), 6) as gain, round(exp(avg(l_tax)), 6) as perplexity from lineitem group by all")
def paired_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.month("l_shipdate").alias("month"), "l_tax", "l_discount")
    made = stats.paired_gain(rows, "l_tax", "l_discount", ["kind", "month"])
    return made.select("kind", "month", "n", *[F.round(c, 6).alias(c) for c in ("a", "b", "gain", "perplexity")])


@query("weighted_loss_rollup", "select l_returnflag as kind, round(sum(l_extendedprice) / sum(l_quantity), 4) as loss, sum(l_quantity)::bigint as tokens from lineitem group by rollup (l_returnflag)")
def weighted_loss_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), "l_extendedprice", "l_quantity")
    return rows.rollup("kind").agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("loss"), F.sum("l_quantity").cast("long").alias("tokens"))


@query(
    "argmin_date",
    """with a as (select user_id, avg(value) as m from events group by 1), g as (select user_id, d, abs(m - 5.0 * d) as loss from a, range(13) r(d)),
    m as (select user_id, arg_min(d, {'l': round(loss, 9), 'd': d}) as best from g group by 1) select best::bigint as date_no, count(*) as users from m group by 1""",
)
def argmin_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    grid = means.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long")))).withColumn("loss", F.abs(F.col("m") - 5.0 * F.col("d")))
    losses = scoring.curves(grid.withColumn("loss", F.round("loss", 9)), "user_id", date="d", out="loss")
    best = losses.select((F.array_position("losses", F.array_min("losses")) - 1).alias("date_no"))  # the first of equal ones
    return best.groupBy("date_no").agg(F.count("*").alias("users"))


@query(
    "js_divergence",
    """with c as (select day(ts) <= 15 as early, user_id as token, count(*) as n from events group by all),
    p as (select token, n / sum(n) over () as p from c where early), q as (select token, n / sum(n) over () as q from c where not early),
    a as (select coalesce(p, 0) as p, coalesce(q, 0) as q from p full join q using (token))
    select round(sum(0.5 * case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + 0.5 * case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end), 6) as js, round(sum(0.5 * abs(p - q)), 6) as tv from a""",
)
def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("token")).agg(F.count_if(F.dayofmonth("ts") <= 15).alias("a"), F.count_if(F.dayofmonth("ts") > 15).alias("b"))
    whole = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).first()
    js, tv = divergence(F.col("a") / (whole["na"] or 1), F.col("b") / (whole["nb"] or 1))
    return counts.agg(F.round(F.sum(js), 6).alias("js"), F.round(F.sum(tv), 6).alias("tv"))


@query(
    "multiple_choice_accuracy",
    """with e as (select conv_id, turn % 4 as ending, sum(length(text)) as total, avg(length(text)) as mean, conv_id % 4 as label from conversations group by all),
    b as (select conv_id, label, arg_min(ending, (total, ending)) as by_sum, arg_min(ending, (round(mean, 9), ending)) as by_mean from e group by all)
    select count(*) as items, round(avg((by_sum = label)::int), 6) as acc, round(avg((by_mean = label)::int), 6) as acc_norm from b""",
)
def multiple_choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("ending", F.col("turn") % 4).withColumn("label", F.col("conv_id") % 4).withColumn("n", F.length("text"))
    e = rows.groupBy("conv_id", "label", "ending").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 9).alias("mean"))
    return scoring.accuracy(e.withColumnRenamed("conv_id", "ind")).select("items", F.round("acc", 6).alias("acc"), F.round("acc_norm", 6).alias("acc_norm"))
