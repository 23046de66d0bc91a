"""Files, limited scans, batches of lengths, contexts and reports on small inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import vectors
from chronolith.operators import clean, graph, neighbors, phrases, requests, sample, schedule, scoring
from chronolith.sources import files


def test_shard_bytes(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("part"))
    for k in range(5):
        df.filter(F.col("id") % 5 == k).coalesce(1).write.partitionBy("part").mode("append").parquet(f"{tmp_path}/t")
    found = files.file_table(spark.read.parquet(f"{tmp_path}/t")).withColumn("part", F.regexp_extract("file", "part=(.)", 1))
    sizes = {p: [os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) if d.endswith(f"part={p}") for f in sorted(fs) if f.endswith(".parquet")] for p in "01"}
    for most, places in ((0, range(5)), (1, [2]), (2, [0, 4]), (3, [0, 2, 4]), (4, [0, 1, 3, 4]), (9, range(5))):
        got = {r["part"]: r for r in files.shard_bytes(found, ["part"], most).collect()}
        for p in "01":
            assert (got[p]["files"], got[p]["bytes"]) == (5, sum(sizes[p]))
            assert (got[p]["sampled_files"], got[p]["sampled_bytes"]) == (len(places), sum(sizes[p][k] for k in places))
            assert list(places) == sample.evenly_spaced(5, most)
    plan = found._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in plan or "ReadSchema: struct<part" in plan


def test_files_past_the_limit_are_not_opened(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(0, 1000, 1, 10).select("id", F.lit("x").alias("c")).write.parquet(path)
    names = sorted(x for x in os.listdir(path) if x.endswith(".parquet"))
    assert len(names) == 10
    for n in names[4:]:  # whoever opens one of these fails
        with open(f"{path}/{n}", "wb") as f:
            f.write(b"no parquet")
        os.unlink(f"{path}/.{n}.crc")
    schema = spark.read.schema("id bigint, c string").parquet(path)
    assert schema.inputFiles()
    for limit in (0, 1, 100, 101, 250, 300):
        made = files.first_rows(spark, path, limit, ["id"])
        assert sorted(r["id"] for r in made.collect()) == list(range(limit))
        assert len(made.inputFiles()) <= -(-limit // 100) or limit == 0
    made = files.first_rows(spark, path, 150, ["id"])
    assert "ReadSchema: struct<id:bigint>" in made._jdf.queryExecution().toString()


def test_more_than_there_is(spark, tmp_path):
    spark.range(0, 30, 1, 3).write.parquet(f"{tmp_path}/t")
    spark.range(0).write.mode("append").parquet(f"{tmp_path}/t")
    assert files.first_rows(spark, f"{tmp_path}/t", 99).count() == 30 and files.first_rows(spark, f"{tmp_path}/t", 0).count() == 0


def test_batches_of_equal_lengths(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 400, size=600).tolist() + [5000]
    df = spark.createDataFrame([(k, "x" * n if n else None, k) for k, n in enumerate(sizes)], "id long, text string, date long")
    made = scoring.scored_by_length(df, lambda: lambda t, d: t.str.len() * 1000 + d, budget=8000, padded="padded", order=["id"]).collect()
    assert [r["id"] for r in made] == list(range(601)) and [r["score"] for r in made] == [n * 1000 + k for k, n in enumerate(sizes)]
    assert all(r["padded"] >= n for r, n in zip(made, sizes, strict=True))
    waste = sum(r["padded"] for r in made) - sum(sizes)
    # Batches of the same budget in the order of the rows are padded to their longest text.
    plain, batch = 0, []
    for n in [*sizes, None]:
        if n is None or (batch and (len(batch) + 1) * max([*batch, n]) > 8000):
            plain += len(batch) * max(batch) - sum(batch)
            batch = []
        batch.append(n)
    assert waste < plain / 5


def test_choices_are_rendered_with_a_mask(spark):
    ids = lambda c: F.transform(F.split(F.trim(c), " "), F.length)
    items = spark.createDataFrame([(1, "a bb", ["ccc", "d eeee"])], "ind int, ctx string, endings array<string>")
    made = scoring.choices(items, ids)
    assert [tuple(r) for r in made.orderBy("ending").collect()] == [(1, 0, [1, 2, 3], [0, 0, 1]), (1, 1, [1, 2, 1, 4], [0, 0, 1, 1])]
    losses = scoring.masked_losses(made, lambda token, place: token.cast("double") * 10 + place)
    assert sorted((r["ending"], r["total"], r["mean"]) for r in losses.collect()) == [(0, 32.0, 32.0), (1, 12.0 + 43.0, 27.5)]


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "s array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(vectors.masked_mean(F.col("s"), F.col("m"))).collect()] == [[2.0, 3.0], None]


def test_contexts_of_first_occurrences(spark):
    text = "Well, it's (one) TWO three four: many monkeys eat; many monkeys sleep"
    df = spark.createDataFrame([("1", text, 5)], "id string, text string, created_utc long")
    got = {r["phrase"]: r["context"] for r in phrases.with_context(phrases.occurrences(df)).collect()}
    assert got["many monkeys"] == "Well, it's (one) TWO three four:" and got["monkeys sleep"] == "Well, it's (one) TWO three four: many monkeys eat; many"
    assert "one two" not in got


def test_emergence_of_two_phrases(spark):
    scores = spark.createDataFrame([("a", 1, -3.0), ("a", 2, -1.0), ("b", 1, -1.0), ("b", 2, -2.0)], "phrase string, date long, logprob double")
    hits = spark.createDataFrame([(2019, "a", 1), (2020, "a", 3), (2021, "a", 8), (2018, "b", 2)], "year int, phrase string, hits long")
    docs = spark.createDataFrame([(y, 100) for y in range(2017, 2023)], "year int, documents long")
    got = {r["phrase"]: r for r in phrases.emergence(scores, hits, docs, 1, 2).collect()}
    a, b = got["a"], got["b"]
    assert a["model_slope"] == 2.0 and b["model_slope"] == -1.0 and (a["train_hits"], a["future_hits"], b["train_hits"]) == (4, 8, 0)
    assert a["frequency_slope"] == pytest.approx(np.log(3.5 / 1.5)) and a["future_growth"] == pytest.approx(np.log((8.5 / 200) / (4.5 / 200))) and b["future_growth"] == pytest.approx(0.0)
    one = phrases.emergence_summary(phrases.emergence(scores, hits, docs, 1, 2)).first()
    assert one["n"] == 2 and one["model_rho"] == pytest.approx(1.0) and one["top_mean"] == pytest.approx(a["future_growth"])


def test_groups_without_links_and_drift(spark):
    links = spark.createDataFrame([(1.0, 2019, True, False), (3.0, 2020, False, False)], "gap double, year int, same boolean, across boolean")
    got = {r["scope"]: tuple(r)[1:] for r in graph.link_groups(links).collect()}
    assert got == {"all": (2, 0.5, 2.0, 0.0), "through_2020": (2, 0.5, 2.0, 0.0), "2021_2022": (0, None, None, None)}
    chosen = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "child long, parent long")
    now = spark.createDataFrame([(1, 0), (2, 1)], "child long, parent long")
    assert tuple(graph.drift(chosen, now).first()) == (3, 1, 1, 1)


def test_profiles_of_components(spark):
    members = spark.createDataFrame([(0, 0, 2011, "a", 9), (0, 3, 2012, "b", 5), (0, 4, 2013, "a", 7), (0, 7, 2013, "a", 8), (1, 1, 2011, "a", 1)], "root long, id long, year int, subreddit string, created_utc long")
    edges = spark.createDataFrame([(3, 0), (4, 0), (7, 3)], "child long, parent long")
    r = graph.profiles(members, edges).collect()
    assert len(r) == 1 and r[0]["index"] == 0 and r[0]["size"] == 4 and r[0]["earliest"] == 3 and r[0]["early"] == [3, 4, 7]
    assert [tuple(x) for x in r[0]["boards"]] == [("a", 3), ("b", 1)] and [tuple(x) for x in r[0]["hubs"]] == [(0, 2), (3, 1)] and (r[0]["first_year"], r[0]["last_year"]) == (2011, 2013)


def test_annual_samples_are_made_once(spark, tmp_path):
    text = "four words of text and more"
    rows = [(f"{y}{k}", text, "memes", 1000 * y + k, y, 1) for y in (2011, 2012) for k in range(5)]
    df = spark.createDataFrame(rows, "id string, text string, subreddit string, created_utc long, year int, month int")
    sample.annual(df, f"{tmp_path}/s", [2011, 2013], 2)
    sample.annual(df.withColumn("text", F.concat("text", F.lit(" other"))), f"{tmp_path}/s", [2011, 2012, 2013], 2)
    got = sample.read_annual(spark, f"{tmp_path}/s", [2011, 2012, 2013]).collect()
    assert sorted((r["year"], r["text"]) for r in got) == [(2011, text)] * 2 + [(2012, text + " other")] * 2


def test_times_before_1970_are_outside_the_month(spark):
    rows = [(2013, 3, "comments", f"{k}", "u", "memes", t, None, None, None, "a text") for k, t in enumerate(["-86400", "-62135596801", "1e99", None, "1362100000"])]
    df = spark.createDataFrame(rows, "year int, month int, kind string, id string, author string, subreddit string, created_utc string, url string, title string, selftext string, body string")
    assert {r["id"]: r["reason"] for r in clean.raw_reason(df).collect()} == {"0": "outside_month", "1": "bad_timestamp", "2": "bad_timestamp", "3": "bad_timestamp", "4": "kept"}


def test_requests_are_judged_in_order(spark):
    rows = [
        ("hello there", "2020", "60", "ok"), ("  ", "2020", "60", "out of range"), (None, "2020", "60", "out of range"), ("x" * 161, "2020-02-03", "1", "out of range"), ("x", "2020-02-30", "1", "invalid parameter"),
        ("x", "2007", "1", "out of range"), ("x", "2024-12-31", "64", "ok"), ("x", "2024", "65", "out of range"), ("x", "2024", "0", "out of range"), ("x", None, "1", "invalid parameter"), ("x", "2020", "ten", "invalid parameter"),
        ("a " * 65, "2020", "5", "prompt tokens"), ("a " * 64, "2020", "5", "ok"),
    ]
    df = spark.createDataFrame(rows, "prompt string, date string, n string, want string")
    reason, tau = requests.judged(F.col("prompt"), F.col("date"), F.col("n"))
    got = df.select("date", "want", reason.alias("got"), tau.alias("tau")).collect()
    assert all(r["got"] == r["want"] and (r["tau"] is None) == (r["got"] != "ok") for r in got)
    assert next(r["tau"] for r in got if r["date"] == "2024-12-31") > 1  # beyond the years of training


def test_probe_wins(spark):
    scores = [("m", p, role, s) for p, three in enumerate([(0.9, 0.5, 0.1), (0.1, 0.5, 0.3), (0.3, 0.3, 0.3)]) for role, s in zip(("literal", "paraphrase", "unrelated"), three, strict=True)]
    df = spark.createDataFrame(scores, "method string, probe int, role string, score double")
    assert tuple(neighbors.probe_wins(df).first()) == ("m", 3, 1, 2)


def test_rows_of_one_chosen_file(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 2).alias("part"), (F.col("id") % 5).alias("shard"))
    df.repartition("part", "shard").write.partitionBy("part", "shard").parquet(f"{tmp_path}/t")
    found = files.file_table(spark.read.parquet(f"{tmp_path}/t")).withColumn("part", F.regexp_extract("file", "part=(.)", 1))
    chosen = files.one_file_each(found, ["part"], "s")
    assert sorted(r["part"] for r in chosen.collect()) == ["0", "1"]
    got = files.sampled_rows(spark, chosen, ["part"], "s", 7, "id bigint").collect()
    assert sorted(r["part"] for r in got) == ["0"] * 7 + ["1"] * 7
    assert all(len({r["id"] % 5 for r in got if r["part"] == p}) == 1 and all(r["id"] % 2 == int(p) for r in got if r["part"] == p) for p in "01")
    again = files.sampled_rows(spark, files.one_file_each(found, ["part"], "s"), ["part"], "s", 7, "id bigint").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert files.sampled_rows(spark, chosen.limit(0), ["part"], "s", 7, "id bigint").count() == 0


def test_milestones_of_steps(spark):
    steps = spark.createDataFrame([(1, 0, 10), (2, 10, 10), (3, 9, 31), (4, 100, 200), (5, -12, -1)], "k int, low long, high long")
    marks = spark.createDataFrame([(10,), (10,), (20,), (30,), (31,), (-12,), (-5,), (None,)], "m long")
    got = dict(schedule.crossed(steps, marks, "k", "m", 7).collect())
    assert got == {1: 1, 2: 0, 3: 4, 4: 0, 5: 1}
