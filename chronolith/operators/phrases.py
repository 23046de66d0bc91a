"""Phrases: candidates with contexts, counts by month, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import patterns as P
from chronolith.functions import text as T
from chronolith.operators.stats import smoothed_rate, spearman, top_share_mean
from chronolith.operators.tokens import last_ids, word_ids
from chronolith.shared import small, stored


def occurrences(posts: DataFrame, first: int = 4, limit: int = 300) -> DataFrame:
    """id, created_utc, phrase, pieces, start: the first place of each distinct phrase of a post's first line.

    Phrases have two to four words from word `first` on, do not begin and end with stop words, and hold a word of five
    letters. pieces: the line's words, each with what precedes it; start: which of them begins the phrase.
    """
    line = F.substring(T.first_line(F.col("text")), 1, limit)
    rows = posts.select("id", "created_utc", line.alias("line")).withColumn("ws", T.phrase_words(F.col("line")))
    # The line is cut once into words, each with what precedes it; in front of a phrase are the pieces up to its first word.
    cut = F.regexp_extract_all("line", F.lit(r"([^A-Za-z]*[A-Za-z][A-Za-z']*)"), 1)
    rows = rows.select("id", "created_utc", cut.alias("pieces"), F.array_sort(T.phrases(F.col("ws"), first)).alias("ps"))
    firsts = F.filter("ps", lambda p, i: (i == 0) | (F.get("ps", i - 1)["phrase"] != p["phrase"]))
    each = rows.withColumn("p", F.explode(firsts)).select("id", "created_utc", "pieces", "p.phrase", "p.start", F.split("p.phrase", " ").alias("t"))
    stop = F.array(*[F.lit(w) for w in P.STOP])
    ends = F.array_contains(stop, F.element_at("t", 1)) & F.array_contains(stop, F.element_at("t", -1))
    strong = F.exists("t", lambda w: (F.length(w) >= 5) & ~F.array_contains(stop, w))
    return each.filter(~ends & strong).select("id", "created_utc", "phrase", "pieces", "start")


def with_context(occ: DataFrame) -> DataFrame:
    """id, created_utc, phrase, context: the up to 16 visible words in front of the phrase, or null under four."""
    lead = F.regexp_extract(F.get("pieces", F.col("start")), r"^([^A-Za-z]*)", 1)
    shown = T.tokens(F.concat(F.array_join(F.slice("pieces", F.lit(1), F.col("start")), ""), lead))
    context = F.transform(F.array(shown), lambda s: F.when(F.size(s) >= 4, F.array_join(F.slice(s, F.greatest(F.size(s) - 15, F.lit(1)), F.lit(16)), " ")))
    return occ.select("id", "created_utc", "phrase", F.element_at(context, 1).alias("context"))


def candidates(occ: DataFrame, least: int = 3, most: int = 300, contexts: int = 3, limit: int = 1000) -> DataFrame:
    """phrase, sample_count, contexts: phrases of a middling count with enough contexts, the first by hash."""
    # Only where a phrase of the right count occurs are contexts looked for; those occurrences are written once.
    counts = occ.groupBy("phrase").agg(F.count("*").alias("sample_count")).filter(F.col("sample_count").between(least, most))
    some = stored(counts, "counted")
    occ = stored(with_context(occ.join(small(some), "phrase").drop("sample_count")), "contexts")
    enough = occ.groupBy("phrase").agg(F.count("context").alias("c")).filter(F.col("c") >= contexts).select("phrase")
    chosen = some.join(enough, "phrase").orderBy(F.md5(F.col("phrase").cast("binary")), "phrase").limit(limit)
    w = Window.partitionBy("phrase").orderBy("created_utc", "id")
    first = occ.filter("context is not null").join(F.broadcast(chosen.select("phrase")), "phrase").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= contexts)  # `limit` phrases
    shown = first.groupBy("phrase").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "context"))), lambda x: x["context"]).alias("contexts"))
    return chosen.join(shown, "phrase").select("phrase", "sample_count", "contexts")


def month_counts(posts: DataFrame, phrases: DataFrame, size: int) -> DataFrame:
    """year, month, phrase, hits: posts of each month whose words hold the phrase, each post once.

    phrases(phrase): of `size` words. All runs of that many words of a post meet the phrases in an equi-join.
    """
    rows = posts.select("id", "year", "month", T.phrase_words(F.col("text")).alias("ws"))
    each = rows.select("id", "year", "month", F.explode(F.array_distinct(T.runs(F.col("ws"), size))).alias("phrase"))
    return each.join(phrases.select("phrase").distinct(), "phrase").groupBy("year", "month", "phrase").agg(F.count("*").alias("hits"))


def line_hits(posts: DataFrame, wanted: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), most: int = 200_000) -> DataFrame:
    """year, month, phrase, hits: rows of a month whose first line, cut at 300 characters, holds the phrase.

    A row names its distinct runs of all widths in one pass; up to `most` wanted phrases are sent to every task, which drops
    the other runs before anything is shuffled.
    """
    from chronolith.functions.text import first_line, phrase_words, runs

    wanted = wanted.select("phrase").distinct()
    ws = posts.select("year", "month", phrase_words(F.substring(first_line(F.col("text")), 1, 300)).alias("w"))
    each = ws.select("year", "month", F.explode(F.array_distinct(F.concat(*[runs(F.col("w"), k) for k in sizes]))).alias("phrase"))
    found = each.join(F.broadcast(wanted) if wanted.count() <= most else wanted, "phrase", "left_semi")
    return found.groupBy("year", "month", "phrase").agg(F.count("*").alias("hits"))


def score_contexts(chosen: DataFrame, scorer, dates: list[int], tokenizer=word_ids, most: int = 64) -> DataFrame:
    """phrase, date, contexts, logprob: a phrase's mean score over its contexts at each of a few dates.

    chosen: phrase, contexts. scorer(prefix ids, phrase ids, date) is a column, an expression or an Arrow UDF; the prefix are
    the last `most` ids of a context. Contexts or phrases without ids are left out.
    """
    rows = chosen.select("phrase", F.explode("contexts").alias("context"))
    rows = rows.select("phrase", last_ids(tokenizer(F.col("context")), most).alias("prefix"), tokenizer(F.concat(F.lit(" "), "phrase")).alias("ids")).filter((F.size("prefix") > 0) & (F.size("ids") > 0))
    grid = rows.withColumn("date", F.explode(F.array(*[F.lit(int(d)).cast("long") for d in dates])))
    scored = grid.withColumn("score", scorer(F.col("prefix"), F.col("ids"), F.col("date")))
    return scored.groupBy("phrase", "date").agg(F.count("*").alias("contexts"), F.avg("score").alias("logprob"))


def emergence(scores: DataFrame, hits: DataFrame, documents: DataFrame, early: int, late: int) -> DataFrame:
    """One row per scored phrase: model_slope, frequency_slope, future_growth, train_hits, future_hits, and rates per million.

    scores: phrase, date, logprob; the slope is from the date `early` to `late`. hits: year, phrase, hits; documents: year,
    documents, of 2018 to 2022. The trend is from 2019 to 2020, growth from both to 2021 and 2022; half a hit is added.
    """
    at = lambda d: F.max(F.when(F.col("date") == d, F.col("logprob")))
    slopes = scores.groupBy("phrase").agg((at(late) - at(early)).alias("model_slope"))
    spans = {"2018": (2018,), "2019": (2019,), "2020": (2020,), "prior": (2019, 2020), "future": (2021, 2022)}
    total = {r["year"]: r["documents"] for r in documents.filter(F.col("year").between(2018, 2022)).collect()}  # five years
    inside = lambda years: F.coalesce(F.sum(F.when(F.col("year").isin(*years), F.col("hits"))), F.lit(0))
    counts = hits.groupBy("phrase").agg(*[inside(y).alias(f"h_{n}") for n, y in spans.items()])
    rows = slopes.join(counts, "phrase", "left")
    for n, years in spans.items():
        rows = rows.withColumn(f"h_{n}", F.coalesce(f"h_{n}", F.lit(0))).withColumn(f"r_{n}", smoothed_rate(F.col(f"h_{n}"), F.lit(max(1, sum(total.get(y, 0) for y in years)))))
    return rows.select(
        "phrase", "model_slope", F.ln(F.col("r_2020") / F.col("r_2019")).alias("frequency_slope"), F.ln(F.col("r_future") / F.col("r_prior")).alias("future_growth"),
        F.col("h_prior").alias("train_hits"), F.col("h_future").alias("future_hits"), F.col("r_2018").alias("rate_2018"), F.col("r_2019").alias("rate_2019"), F.col("r_2020").alias("rate_2020"), F.col("r_future").alias("rate_2021_2022"),
    )


def emergence_summary(rows: DataFrame) -> DataFrame:
    """One row: n, both rank correlations with growth, and the mean growth of the steepest tenth and of all."""
    rows = stored(rows, "emergence")
    model = spearman(rows, "model_slope", "future_growth").select("n", F.col("rho").alias("model_rho"))
    trend = spearman(rows, "frequency_slope", "future_growth").select(F.col("rho").alias("trend_rho"))
    top = top_share_mean(rows, "model_slope", "future_growth").select("top_mean", "mean")
    return model.crossJoin(trend).crossJoin(top)  # three single rows


def score_slopes(phrases: DataFrame, scorer, contexts: int = 3) -> DataFrame:
    """phrase, slope: the mean log probability over the contexts at the later date less that at the earlier one.

    scorer(phrase, date no, context no) is a column: an expression or an Arrow UDF.
    """
    grid = phrases.withColumn("date", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("context", F.explode(F.sequence(F.lit(0), F.lit(contexts - 1))))
    scored = grid.withColumn("score", scorer(F.col("phrase"), F.col("date"), F.col("context")))
    mean = lambda d: F.avg(F.when(F.col("date") == d, F.col("score")))
    return scored.groupBy("phrase").agg((mean(1) - mean(0)).alias("slope"))
