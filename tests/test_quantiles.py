"""Quantiles by counting against numpy, and the shuffle that needs no order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import quantiles, stats

SHARES = [0.0, 0.025, 0.1, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("few", [0, 7, 20_000])
def test_grouped_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "CELLS", 4)
    rng = random.Random(3)
    groups = {
        "wide": [rng.choice([-1e308, 1e308, rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300)]) for _ in range(200)],
        "ties": [float(rng.randrange(5)) for _ in range(300)],
        "one": [2.5],
        "hot": [7.0] * 200 + [rng.random() for _ in range(100)],
        "close": [1.0 + k * 2.0**-52 for k in range(50)],
        None: [float(k) for k in range(11)],
    }
    rows = [(g, 1, v) for g, vs in groups.items() for v in vs] + [("ties", 1, None), ("one", 1, float("nan")), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, v int, x double")
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.grouped_quantiles(df, ["g", "v"], "x", SHARES).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g][0] == len(vs)
        ordered = np.sort(vs)
        at = np.array(SHARES) * (len(vs) - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, len(vs) - 1)
        want = ordered[low] + (ordered[high] - ordered[low]) * (at - low)
        assert all(a == b or abs(a - b) <= 1e-9 * abs(b) or not np.isfinite(b) for a, b in zip(got[g][1], want, strict=True)), g


def test_quantiles_of_a_column(spark):
    df = spark.range(0, 100_001).select((F.col("id") * 7919 % 100_001).alias("x"))
    assert quantiles.quantiles(df, "x", [0.5, 0.999]) == [50_000.0, 99_900.0]
    assert quantiles.quantiles(df.limit(0), "x", [0.5]) == [None]
    made = quantiles.grouped_quantiles(df.withColumn("g", F.col("x") % 2), ["g"], "x", [0.5])
    plan = made._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan


def test_top_share_mean(spark):
    df = spark.createDataFrame([(float(k), float(k * k)) for k in range(11)], "a double, b double")
    r = stats.top_share_mean(df, "a", "b", 0.1).first()
    assert r["cut"] == 9.0 and r["top_mean"] == (81 + 100) / 2 and r["mean"] == sum(k * k for k in range(11)) / 11


@pytest.mark.parametrize("n", [1, 2, 7, 64, 101])
def test_shuffles_are_permutations(spark, n):
    rows = spark.range(n).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("keys", stats.shuffle_keys(F.col("draw"), n))
    rows = rows.select("id", "draw", stats.shuffled_place(F.col("id"), F.col("keys"), n).alias("to")).collect()
    to = np.full((40, n), -1)
    for r in rows:
        to[r["draw"], r["id"]] = r["to"]
    assert all(sorted(x) == list(range(n)) for x in to.tolist())
    if n == 101:  # every place goes anywhere, and neighbours do not stay together
        assert len({tuple(x) for x in to.tolist()}) == 40 and abs(to.mean(axis=0) - 50).max() < 20
        assert (np.abs(np.diff(to, axis=1)) == 1).mean() < 0.05


def test_permutation_null_of_two_families(spark):
    """With two halves, a shuffled link joins equal families in (m - 1) / (2 m - 1) of the draws, m being half of the nodes."""
    nodes = spark.range(100).select("id", (F.col("id") % 2).alias("family"))
    edges = spark.range(2, 100).select(F.col("id").alias("child"), (F.col("id") - 2).alias("parent"))
    made = stats.permutation_null(edges, nodes, 60)
    r = made.first()
    assert r["observed"] == 1.0 and abs(r["null_mean"] - 49 / 99) < 0.03 and 0.02 < r["null_sd"] < 0.1
    plan = made._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Cross" not in plan and "Window" not in plan


@pytest.mark.parametrize("most", [4_000_000, 30])
def test_links_are_not_multiplied_by_draws(spark, monkeypatch, most):
    """The same draws node by node, with families that are missing, and families cut into stretches."""
    n, draws = 70, 12
    family = [None if k % 11 == 0 else f"f{k * k % 5}" for k in range(n)]
    pairs = [(k, k * 7 % k) if k % 2 else (k, k - 1) for k in range(1, n)]
    monkeypatch.setattr(stats, "MOST_FAMILIES", most, raising=False)
    edges = spark.createDataFrame(pairs, "child long, parent long")
    made = stats.permutation_null(edges, spark.createDataFrame(list(enumerate(family)), "id long, family string"), draws)
    to = spark.range(n).crossJoin(spark.range(draws).select(F.col("id").alias("draw"))).withColumn("keys", stats.shuffle_keys(F.col("draw"), n))
    to = {(r["draw"], r["id"]): r["to"] for r in to.select("id", "draw", stats.shuffled_place(F.col("id"), F.col("keys"), n).alias("to")).collect()}
    share = lambda of: np.mean([a == b for a, b in of if a is not None and b is not None])
    rates = [share([(family[to[d, c]], family[to[d, p]]) for c, p in pairs]) for d in range(draws)]
    r = made.first()
    assert abs(r["null_mean"] - np.mean(rates)) < 1e-12 and abs(r["null_sd"] - np.std(rates)) < 1e-12
    assert abs(r["observed"] - share([(family[c], family[p]) for c, p in pairs])) < 1e-12
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "keys#" not in plan and "drawn_" not in plan
