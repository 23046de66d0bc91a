"""The five ways to choose an earlier row, against plain loops, and what is written on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_no_row_is_written_for_a_pair(spark, monkeypatch):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    written, kind = [], type(spark.range(1).write)
    parquet = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda self, path, *a, **b: (parquet(self, path, *a, **b), written.append(spark.read.parquet(path).count()))[0])
    assert QUERIES["neighbor_methods"](spark, SF).count() == 5
    assert 0 < max(written) <= 5 * n  # all pairs are n * (n - 1) / 2


@pytest.mark.parametrize(("children", "tile", "gate", "alpha"), [(16, 8, 5, 0.03), (100, 7, 20, 0.002), (9, 64, 3, 0.5)])
def test_five_methods(spark, monkeypatch, children, tile, gate, alpha):
    """Blocks and tiles of few rows; repeated, missing, empty and equal documents, a zero vector, equal vectors, gaps in the ids."""
    from chronolith.operators import methods

    for name, value in (("CHILDREN", children), ("TILE", tile), ("TOGETHER", 8), ("TEXT_BYTES", 200)):
        monkeypatch.setattr(methods, name, value)
    n, rng = 70, np.random.default_rng(23)
    ids = np.sort(rng.choice(200, n, replace=False))
    v = rng.normal(size=(n, 6))
    v[5], v[20] = 0.0, v[10]
    texts = [(k, " ".join(f"w{x}" for x in rng.zipf(1.5, size=rng.integers(0, 30)) % 40)) for k in range(200) if k % 7]
    texts += [(int(ids[3]), "w1 w2 own"), (int(ids[60]), None), (int(ids[61]), "only here")]
    texts = [(k, dict(texts)[int(ids[30])] if k in (ids[31], ids[50]) else t) for k, t in texts]
    rows = spark.createDataFrame([(int(i), int(k % 4), x.tolist()) for k, (i, x) in enumerate(zip(ids, v))], "id long, family int, embedding array<double>")
    docs = spark.createDataFrame(texts, "id long, text string")
    made = methods.five_methods(rows, docs, lambda c: F.filter(F.split(c, " "), lambda w: w != ""), gate, alpha)
    got = {(r["method"], r["child"]): r for r in made.collect()}

    mine = [(k, t) for k, t in texts if k in ids]
    bags = [[w for k, t in mine if k == i for w in (t or "").split()] for i in ids]
    names = sorted({w for ws in bags for w in ws})
    tf = np.array([[ws.count(x) for x in names] for ws in bags])
    w = tf * (np.log((1 + len(mine)) / (1 + (tf > 0).sum(0))) + 1)
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for c in range(1, n):
        cos, lex, late = u[:c] @ u[c], w[:c] @ w[c], alpha * (ids[c] - ids[:c])
        span = cos.max() - cos.min()
        scaled = (cos - cos.min()) / span if span > 0 else 0 * cos
        first = sorted(range(c), key=lambda p: (-round(lex[p], 9), p))[:gate]
        gated = np.where(np.isin(np.arange(c), first), cos, -9)
        for method, score in (("semantic", cos), ("semantic_time", cos - late), ("lexical", lex), ("hybrid", 0.5 * scaled + 0.5 * lex - late), ("lexical_gate20", gated)):
            p, r = int(np.round(score, 9).argmax()), got[method, ids[c]]
            assert (r["parent"], r["family_c"], r["family_p"], r["gap"]) == (ids[p], c % 4, p % 4, ids[c] - ids[p]), (method, c)
            assert abs(r["cosine"] - cos[p]) < 1e-9
    assert len(got) == 5 * (n - 1)
    for few in (0, 1, 2):
        assert methods.five_methods(rows.limit(few), docs, lambda c: F.split(c, " "), gate, alpha).count() == 5 * max(0, few - 1)
