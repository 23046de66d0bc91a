import contextlib
import io
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith import shared
from chronolith.functions import timeutil, vectors
from chronolith.operators import dedup, graph, manifest, neighbors, prefix, sample, scoring, stats
from chronolith.operators.windows import pack_windows
from chronolith.sources import logs
from chronolith.streaming import tail


def test_evenly_spaced():
    assert sample.evenly_spaced(10, 1) == [5]
    assert sample.evenly_spaced(10, 3) == [0, 4, 9]
    assert sample.evenly_spaced(2, 5) == [0, 1]


def test_running_sums_and_ranks(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(1000), rng.randrange(1, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, o long, v long")
    got = {r["id"]: r["s"] for r in prefix.running_before(df, ["o", "id"], "v", "s").collect()}
    total = 0
    for k, _o, v in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[k] == total
        total += v
    ranked = {r["id"]: r["r"] for r in prefix.average_rank(df, "v", "r").collect()}
    order = sorted(r[2] for r in rows)
    assert all(ranked[k] == np.mean([i + 1 for i, x in enumerate(order) if x == v]) for k, _, v in rows[:20])


def test_packing_identity(spark):
    rng = random.Random(5)
    rows = [(f"{k:03d}", "s", 1000 + k, rng.randrange(1, 900)) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, part string, created_utc long, n long")
    got = {r["window_no"]: r["created_utc"] for r in pack_windows(df, ["part"], ["created_utc", "id"]).collect()}
    dates = [d for _, _, d, n in rows for _ in range(n)]
    assert len(got) == (len(dates) - 1) // 1024
    for k, d in got.items():
        assert d == round(sum(dates[1024 * k : 1024 * k + 1024]) / 1024)


def test_earlier_neighbour_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, v[k].tolist()) for k in range(60)], "id long, embedding array<double>")
    got = {r["child"]: r["parent"] for r in neighbors.earlier_neighbour(df, alpha=0.01, block=17).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for c in range(1, 60):
        assert got[c] == max(range(c), key=lambda p: (u[c] @ u[p] - 0.01 * (c - p), -p))
    assert 0 not in got
    more = {r["child"]: r["parent"] for r in neighbors.earlier_neighbour(df.filter("id < 40"), alpha=0.01, block=17).collect()}
    assert all(more[c] == got[c] for c in more)  # later rows change nothing


def test_forest(spark):
    edges = spark.createDataFrame([(k, k - 1 if k % 7 else k - 2, 0.5, 1.0) for k in range(2, 50)], "child long, parent long, cosine double, gap double")
    nodes = spark.range(52)
    got = {r["id"]: r["root"] for r in graph.roots(nodes, edges).collect()}
    up = {r["child"]: r["parent"] for r in edges.collect()}
    for k in range(52):
        top = k
        while top in up:
            top = up[top]
        assert got[k] == top
    assert graph.faults(nodes, edges).first().asDict() == {"repeated": 0, "dangling": 0, "backward": 0}
    lines = graph.graphml_lines(nodes.withColumn("text", F.lit('a<b&"')), edges).collect()
    assert any("a&lt;b&amp;&quot;" in r["line"] for r in lines) and len(lines) == 52 + 48 + 6 + 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_long_chains_take_few_tables(spark, monkeypatch, tmp_path, kind):
    """Chains of 1,500 links over several ranges, a tree beside them and an end that is no node: little is written, and only the labels stay."""
    rng = random.Random(11)
    up = {k: k - 2 for k in range(2, 3000)} | {k: rng.randrange(3000, k) for k in range(3001, 3400)} | {5000: 4990}
    ids = [k for k in range(3500)] + [5000]
    name = (lambda k: k) if kind == "long" else (lambda k: f"{k:05d}")
    edges = spark.createDataFrame([(name(c), name(p)) for c, p in up.items()], f"child {kind}, parent {kind}")
    nodes = spark.createDataFrame([(name(k),) for k in ids], f"id {kind}")
    monkeypatch.setattr(shared, "fresh_path", lambda _spark, what: f"{tmp_path}/{what}-{len(made) + 1}")
    made, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda *a, **b: made.append(stored(*a, **b)) or made[-1])
    got = {r["id"]: r["root"] for r in graph.roots(nodes, edges).collect()}
    top = {}
    for k in ids:
        top[k] = top.get(up[k], up[k]) if k in up else k
    assert got == {name(k): name(v) for k, v in top.items()}
    assert len(os.listdir(tmp_path)) == 1 and len(made) <= 6  # a round for each doubling of 1,500 made twelve tables that stayed


def test_faults_are_counted_in_one_pass(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,), (None,)], "id long")
    edges = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (3, 9), (9, 3), (9, 8), (None, 1)], "child long, parent long")
    made = graph.faults(nodes, edges)
    assert made.first().asDict() == {"repeated": 2, "dangling": 5, "backward": 3}
    assert graph.faults(nodes.limit(0), edges.limit(0)).first().asDict() == {"repeated": 0, "dangling": 0, "backward": 0}
    with contextlib.redirect_stdout(io.StringIO()) as out:
        made.explain()
    plan = out.getvalue().split("Initial Plan")[-1]
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan  # three passes shuffled ids twice and ends once


def test_canonical_dedup(spark):
    rows = [("1", 5, "Hello, World and more"), ("2", 4, "hello world  AND more"), ("3", 6, "short!"), ("4", 7, "short"), ("1", 9, "another text of this id")]
    df = spark.createDataFrame(rows, "id string, created_utc long, text string")
    once = dedup.first_dated(df)
    assert sorted((r["id"], r["created_utc"]) for r in once.collect()) == [("1", 5), ("2", 4), ("3", 6), ("4", 7)]
    assert sorted(r["id"] for r in dedup.punctuation_blind(once).collect()) == ["2", "3", "4"]


def test_spearman_and_divergence(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b double")
    rank = lambda xs: [np.mean([i + 1 for i, y in enumerate(sorted(xs)) if y == x]) for x in xs]
    want = np.corrcoef(rank([r[0] for r in rows]), rank([r[1] for r in rows]))[0, 1]
    assert math.isclose(stats.spearman(df, "a", "b").first()["rho"], want, abs_tol=1e-9)
    js, tv = vectors.divergence(F.lit(1.0), F.lit(0.0))
    r = spark.range(1).select(js.alias("js"), tv.alias("tv")).first()
    assert math.isclose(r["js"], 0.5 * math.log(2)) and r["tv"] == 0.5


def test_times(spark):
    df = spark.createDataFrame([("2016",), ("2020-02-03",), ("x",)], "d string").select(timeutil.parse(F.col("d")).alias("s"))
    assert [r["s"] for r in df.collect()] == [1467331200, 1580688000, None]
    r = spark.range(1).select(timeutil.normalized(F.lit(1293840000)).alias("a"), timeutil.normalized(F.lit(1609459199)).alias("b"), timeutil.month_label(F.lit(2018 * 12 + 2)).alias("m")).first()
    assert (r["a"], r["b"], r["m"]) == (0.0, 1.0, "2018-03")


def test_logs(spark):
    lines = ["step 5 loss 3.5 lr 6e-4 norm 0.9 seconds 1.2", "validation step 5 loss 3.25", "noise", "step 5 loss 3.4 lr 6e-4 norm 0.8 seconds 1.1"]
    df = spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "line string, arrival long")
    got = {r["training"]: r for r in logs.latest(logs.parse(df)).collect()}
    assert got[True]["loss"] == 3.4 and got[True]["tokens_seen"] == 6 * 262144
    assert got[False]["loss"] == 3.25 and got[False]["tokens_seen"] == 5 * 262144


def test_near_copy_pairs(spark):
    base = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([("a", base), ("b", base + " x"), ("c", base[::-1]), ("d", "short")], "id string, text string")
    assert [(r["id_a"], r["id_b"]) for r in dedup.near_copy_pairs(df).collect()] == [("a", "b")]


def test_near_copy_pairs_link_every_copy(spark):
    base = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"term{k}" for k in range(60))
    rows = [("a", base), ("b", base + " x"), ("c", base), ("d", base.upper().replace(" ", ", ")), ("e", base + "! X."), ("f", other), ("g", "short")]
    df = spark.createDataFrame(rows, "id string, text string")
    assert sorted((r["id_a"], r["id_b"]) for r in dedup.near_copy_pairs(df).collect()) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "e")]
    assert dict(dedup.near_copy_members(df).collect()) == {"a": "a", "b": "b", "c": "a", "d": "a", "e": "b", "f": "f"}


def test_singular_values(spark):
    rows = np.random.default_rng(5).normal(size=(50, 7))
    df = spark.createDataFrame([(r.tolist(),) for r in rows] + [(None,)], "v array<double>").repartition(3)
    got = [r["value"] for r in scoring.singular_values(df, "v").orderBy("no").collect()]
    assert np.allclose(got, np.linalg.svd(rows, compute_uv=False))
    ragged = spark.createDataFrame([([1.0, 2.0],), ([3.0],), ([],)], "v array<double>")
    got = [r["value"] for r in scoring.singular_values(ragged, "v").orderBy("no").collect()]
    assert np.allclose(got, np.linalg.svd([[1.0, 2.0], [3.0, 0.0]], compute_uv=False))
    assert scoring.singular_values(df.limit(0), "v").count() == 0


def test_stream_updates_over_batches(spark, tmp_path):
    """Three files read one at a time: every key has the state after the last batch that changed it."""
    for k in range(3):
        spark.createDataFrame([(1, k), (k + 1, 10)], "a int, b int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("a int, b int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    done = tail.run_updates(rows.groupBy("a").agg(F.sum("b").alias("b")), ["a"], "sums")
    assert {tuple(r) for r in done.collect()} == {(1, 13), (2, 10), (3, 10)}


def test_lexical_products_in_blocks(spark):
    rng = random.Random(4)
    w = {(k, t): rng.random() for k in range(23) for t in "abcdefgh" if t == "a" or rng.random() < 0.3}
    del w[7, "a"]
    df = spark.createDataFrame([(k, t, x) for (k, t), x in w.items()], "id long, term string, w double")
    want = {(c, p): sum(w[c, t] * w[p, t] for t in "abcdefgh" if (c, t) in w and (p, t) in w) for c in range(23) for p in range(c)}
    want = {k: v for k, v in want.items() if v > 0}
    got = {(r["child"], r["parent"]): r["lexical"] for r in neighbors.lexical(df, block=5, chunk=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    links = spark.createDataFrame([(5, 2), (9, 0), (7, 3)], "child long, parent long")
    some = {(r["child"], r["parent"]): r["lexical"] for r in neighbors.lexical_links(df, links).collect()}
    assert some.keys() == {(5, 2), (9, 0), (7, 3)} & want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in some.items())
    rows = spark.range(11).select("id", F.lit(0).alias("family"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    assert sorted((r["child"], r["parent"]) for r in neighbors.pairs(rows, block=4).collect()) == [(c, p) for c in range(11) for p in range(c)]


def test_incomplete_partitions_and_the_locked_split(spark):
    shards = spark.createDataFrame([("train", 1), ("test", 2)], "split string, no int")
    assert [r["no"] for r in manifest.split_rows(shards, "train").collect()] == [1]
    assert [r["no"] for r in manifest.split_rows(shards, "test", allow_test=True).collect()] == [2]
    with pytest.raises(PermissionError):
        manifest.split_rows(shards, "test")
    reasons = spark.createDataFrame([(1, None), (2, "no shards")], "part int, reason string")
    manifest.check_complete(reasons.filter("part = 1"))
    manifest.check_complete(reasons, require=False)
    with pytest.raises(ValueError, match="no shards"):
        manifest.check_complete(reasons)
