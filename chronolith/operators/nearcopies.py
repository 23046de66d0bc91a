"""Candidates for near copies: texts with the same head and nearly the same length, below all pairs.

Few texts of a head are paired by their length bands. Where a head has many, only texts that share a rare run of characters
meet: at a ratio of `least` a text has all but a bounded number of its runs in common with its partner, so of both texts'
rarest ones, one more than that bound, at least one is the same. That holds for any order of the runs; how rare a run is,
is read from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from chronolith.functions.similarity import code_points, run_hashes, spoiled_runs
from chronolith.shared import scratch, stored

#: Leading characters that copies share, and the width of a length band.
HEAD, BAND = 24, 32
#: Texts of a head up to which its bands are paired directly.
DIRECT = 64
#: Texts from which the runs' frequencies are estimated; a choice of order, which cannot lose a pair.
SAMPLE = 2000


def most_gap(n: Column, m: Column) -> Column:
    """The largest difference in length of near copies."""
    return F.greatest(F.lit(3).cast("long"), F.floor(F.greatest(n, m) / 50))


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Runs that repeat in a text told apart by their turn."""
    order = np.argsort(hashes, kind="stable")
    first = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]) if len(hashes) else np.zeros(0, bool)
    turn = np.empty(len(hashes), np.uint64)
    turn[order] = np.arange(len(hashes)) - np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
    with np.errstate(over="ignore"):
        return (hashes + turn * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _widest(n: int) -> int:
    """The length of the longest partner that the gap allows."""
    m = n + 3
    while m + 1 - n <= max(3, (m + 1) // 50):
        m += 1
    return m


def _rare_runs(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, head, class, run: each text's rarest runs, as many as its partner may lack, and one more."""
    picked = rows.orderBy(F.xxhash64("class")).limit(SAMPLE).select("c")

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("c").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_numbered(run_hashes(code_points(text))))], names=["run"])

    seen = picked.mapInArrow(runs_of, "run bigint").groupBy("run").agg(F.count("*").alias("n")).filter("n > 1")
    # At most the runs of SAMPLE texts; the frequent ones alone decide, so the tasks hold the 200,000 most frequent.
    common = seen.orderBy(F.desc("n"), "run").limit(200_000).collect()
    order = np.array(sorted((r["run"], r["n"]) for r in common), np.int64).reshape(-1, 2)
    known = rows.sparkSession.sparkContext.broadcast(order)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = known.value[:, 0], known.value[:, 1]
        for batch in batches:
            for k, text in enumerate(batch.column("c").to_pylist()):
                own = _numbered(run_hashes(code_points(text)))
                m = _widest(len(text))
                # the bound grows with the partner's length but for what the partner has more, so both ends are asked
                wanted = max(spoiled_runs(len(text), x, least) for x in (m, len(text), 2 * len(text) - m)) + 1
                if len(runs):
                    at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
                    often = np.where(runs[at] == own, counts[at], 0)
                else:
                    often = np.zeros(len(own), np.int64)
                chosen = own[np.lexsort((own, often))[:wanted]]
                if len(own) < wanted:  # too short to be told apart by its runs: it meets every other such text of its head
                    chosen = np.append(chosen, 0)
                row = pa.array(np.full(len(chosen), k))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(row) for c in [*keys, "head", "class"]] + [pa.array(chosen)], names=[*keys, "head", "class", "run"])

    kinds = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in [*keys, "head", "class"])
    return rows.select(*keys, "head", "class", "c").mapInArrow(rarest, f"{kinds}, run bigint")


#: Counters of a text's runs of SIGNED characters; a pair of texts is sent only if these allow the ratio.
COUNTERS, SIGNED = 256, 3


@F.arrow_udf(BinaryType())
def _signature(c: pa.Array) -> pa.Array:
    """How many runs of a text fall to each counter, 255 at most: a byte each."""
    counts = (np.bincount((run_hashes(code_points(x), SIGNED) >> np.uint64(56)).astype(np.int64), minlength=COUNTERS) for x in c.to_pylist())
    return pa.array([np.minimum(x, 255).astype(np.uint8).tobytes() for x in counts], pa.binary())


def _alike(least: float) -> Callable[..., Column]:
    @F.arrow_udf(BooleanType())
    def run(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        """False only where one text lacks more runs of the other than the ratio allows; counters can but hide lacking ones."""
        if not len(x):
            return pa.array([], pa.bool_())
        a, b = (np.frombuffer(b"".join(z.to_pylist()), np.uint8).reshape(-1, COUNTERS).astype(np.int16) for z in (x, y))
        lacks = np.maximum(a - b, 0).sum(1), np.maximum(b - a, 0).sum(1)
        return pa.array([p <= spoiled_runs(i, j, least, SIGNED) and q <= spoiled_runs(j, i, least, SIGNED) for p, q, i, j in zip(*lacks, n.to_pylist(), m.to_pylist())], pa.bool_())

    return run


def candidates(rows: DataFrame, keys: list[str], least: float = 0.985) -> DataFrame:
    """keys, head, class, c, n, band and class2, c2, n2, band2 with class < class2: every pair that may reach `least`.

    rows: keys, class (tells texts apart), c (the text). A pair shares keys and the first HEAD characters, lies in one length
    band or neighbouring ones, and differs in length by a fiftieth, or 3 characters, at most.
    """
    n = F.length("c").cast("long")
    rows = rows.select(*keys, "class", "c", n.alias("n"), F.substring("c", 1, HEAD).alias("head"), F.expr(f"length(c) div {BAND}").alias("band"), _signature("c").alias("sig"))
    with scratch(rows.sparkSession):
        rows = stored(rows, "texts", keep=True)  # read several times below
        sizes = stored(rows.groupBy(*keys, "head").agg(F.count("*").alias("texts")).filter("texts > 1"), "heads", keep=True)
    few, many = (rows.join(sizes.filter(f"texts {sign} {DIRECT}").drop("texts"), [*keys, "head"], "left_semi") for sign in ("<=", ">"))
    second = lambda df: df.withColumnsRenamed({c: f"{c}2" for c in ("class", "c", "n", "band", "sig")})
    named = [*keys, "head", "class", "class2"]
    near = second(few.drop("c")).withColumn("band", F.explode(F.array(F.col("band2") - 1, F.col("band2"), F.col("band2") + 1)))
    fits = (F.col("class") < F.col("class2")) & (F.abs(F.col("n") - F.col("n2")) <= most_gap(F.col("n"), F.col("n2")))
    alike = _alike(least)("sig", "sig2", "n", "n2")
    out = few.drop("c").join(near, [*keys, "head", "band"]).filter(fits).filter(alike).select(named)
    if not sizes.filter(f"texts > {DIRECT}").isEmpty():
        runs = _rare_runs(many, keys, least)
        other = runs.withColumnRenamed("class", "class2")
        met = runs.join(other, [*keys, "head", "run"]).filter("class < class2").select(named).distinct()
        pairs = met.join(many.drop("c"), [*keys, "head", "class"]).join(second(many.drop("c")), [*keys, "head", "class2"])
        out = out.unionByName(pairs.filter(fits & (F.abs(F.col("band") - F.col("band2")) <= 1)).filter(alike).select(named))
    # Texts go only to the pairs that are left, which are by far the fewest.
    texts = rows.drop("sig")
    out = stored(out, "pairs").join(texts, [*keys, "head", "class"]).join(second(texts), [*keys, "head", "class2"])
    out = out.select(*keys, "head", "band", "class", "c", "n", "class2", "c2", "n2", "band2")
    # To compare a pair takes far longer than to send it, so pairs are dealt evenly, and not put together by their bytes.
    spark = rows.sparkSession
    return out.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "class", "class2")
