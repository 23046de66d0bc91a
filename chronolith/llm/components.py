"""Connected components of an undirected edge list: in one task where the edges are few, else by alternating large-star and
small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.shared import stored

#: Edges up to which one task joins them all; a million are two arrays of 8 MB.
ALONE = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored first, so that both sides of the join are plain exchanges and a centre's rows can be split among tasks.
    low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "stars")
    return both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = stored(down.groupBy("u").agg(F.min("v").alias("m")), "stars")
    moved = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges, and the smallest end that each can reach."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, low = place[: len(a)], place[len(a) :], np.arange(len(ids))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return ids, ids[low]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def components(edges: DataFrame, most: int = 60, alone: int = ALONE) -> DataFrame:
    """(id, comp) for every end of an edge (a, b); comp is the smallest id reachable. Self-loops and repeats are fine.

    edges are read several times: pass a stored table.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if edges.count() <= alone:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches]
            if held:
                ids, low = _joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], names=["id", "comp"])

        return edges.repartition(1).mapInArrow(run, "id bigint, comp bigint")
    now = stored(edges.filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(most):
        nxt = stored(_small_star(_large_star(now)), "edges")
        state = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now, same, before = nxt, state == before, state
        if same:
            return now.select(F.col("b").alias("id"), F.col("a").alias("comp")).union(now.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")
