"""The statistics that judge results: ranks, quantiles, resampling, divergences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.text import hash_number
from chronolith.operators.prefix import average_rank, running_before
from chronolith.operators.quantiles import quantiles
from chronolith.shared import small, stored


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman's rank correlation, ties at their average rank."""
    ranked = average_rank(average_rank(df.select(a, b), a, "ra"), b, "rb")
    return ranked.agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def top_share_mean(df: DataFrame, by: str, value: str, share: float = 0.1) -> DataFrame:
    """Mean of value above the quantile of `by` and over all rows; the quantile is found by counting."""
    cut = F.lit(quantiles(df, by, [1 - share])[0]).cast("double")
    return df.agg(cut.alias("cut"), F.avg(F.when(F.col(by) >= cut, F.col(value))).alias("top_mean"), F.avg(value).alias("mean"))


def block_bootstrap(df: DataFrame, block: str, value: str, draws: int, salt: str = "boot") -> DataFrame:
    """One row: mean of value and its 2.5% and 97.5% bounds over resampled blocks.

    Only the blocks' sums are resampled, by a hash of draw and place; blocks are numbered by ranges and sent to every task
    only if they are few.
    """
    sums = df.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    sums = stored(running_before(sums.withColumn("one", F.lit(1)), [block], "one", "no").select(F.col("no").cast("long").alias("no"), "s", "n"), "blocks")
    k = sums.count()
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(k - 1, 0)))).alias("place"))
    picks = picks.withColumn("no", F.pmod(hash_number(F.concat(F.lit(f"{salt}:"), F.col("draw").cast("string"), F.lit(":"), F.col("place").cast("string"))), F.lit(max(k, 1))))
    means = stored(picks.join(small(sums, k), "no").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m")), "means", draws)
    low, high = (F.lit(x).cast("double") for x in quantiles(means, "m", [0.025, 0.975]))
    return df.agg(low.alias("low"), high.alias("high"), F.avg(value).alias("mean"))


#: Rounds of a shuffle; each asks for every pair of places that the round's key couples whether they change.
ROUNDS = 24
#: Fixed value: the prime below which places are mixed.
PRIME = 2147483647


def shuffle_keys(draw: Column, n: int, salt: str = "perm", rounds: int = ROUNDS) -> Column:
    """The keys of a draw's rounds: what couples two places, and the factor and summand of the mixing."""
    digest = lambda r: F.md5(F.concat_ws(":", F.lit(salt), draw.cast("string"), r.cast("string")).cast("binary"))
    number = lambda h, part: F.conv(F.substring(h, 1 + 8 * part, 8), 16, 10).cast("long")
    digests = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), digest)
    return F.transform(digests, lambda h: F.struct((number(h, 0) % n).alias("couple"), (number(h, 1) % (PRIME - 1) + 1).alias("a"), (number(h, 2) % PRIME).alias("b")))


def shuffled_place(place: Column, keys: Column, n: int) -> Column:
    """Where a keyed shuffle of 0 .. n - 1 takes a place: a permutation for every draw, found for each place by itself.

    A round couples place x with (key - x) mod n; a bit of the larger one's hash says if the two change. That is its own
    inverse whatever the bit is, so rounds make a permutation of any n, without walking and without ordering the places.
    n is below PRIME.
    """

    def change(x: Column, k: Column) -> Column:
        other = F.pmod(k["couple"] - x, F.lit(n))
        mixed = (F.greatest(x, other) * k["a"] + k["b"]) % PRIME
        return F.when(F.shiftright(mixed, 16) % 2 == 1, other).otherwise(x)

    return F.aggregate(keys, place.cast("long"), change)


def shuffled_places(place: np.ndarray, keys: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """shuffled_place() of many places under one draw's keys."""
    for couple, a, b in keys:
        other = (couple - place) % n
        mixed = (np.maximum(place, other) * a + b) % PRIME
        place = np.where((mixed >> 16) % 2 == 1, other, place)
    return place


#: Links of a task at most, and families; shares of the links at least.
MOST_LINKS, MOST_FAMILIES, SHARES = 500_000, 4_000_000, 8


def permutation_null(edges: DataFrame, nodes: DataFrame, draws: int, salt: str = "perm") -> DataFrame:
    """One row: observed share of links within a family, and mean and deviation of it under shuffled families.

    A draw gives node number x the family of the node at shuffled_place(x), so a link's two families are look-ups. A task has a
    share of the links and the families of one or two stretches of numbers, and counts by draw the links whose two places lie
    in them: links are never multiplied by the draws, and no draw orders the nodes. edges: child, parent; nodes: id, family.
    """
    numbered = running_before(nodes.select("id", "family").withColumn("one", F.lit(1)), ["id"], "one", "no")
    fixed = stored(numbered.select("id", "family", F.col("no").cast("long").alias("no")), "nodes")
    n, most = fixed.count(), MOST_FAMILIES
    end = lambda side: fixed.select(F.col("id").alias(side), F.col("no").alias(f"no_{side}"), F.col("family").alias(f"family_{side}"))
    both = edges.select("child", "parent").join(end("child"), "child").join(end("parent"), "parent")
    links = stored(both.select("no_child", "no_parent", (F.col("family_child") == F.col("family_parent")).alias("same")), "links")
    shares, stretches = max(SHARES, -(-links.count() // MOST_LINKS)), range(-(-n // most))
    keys = [[(k["couple"], k["a"], k["b"]) for k in r["keys"]] for r in fixed.sparkSession.range(draws).select("id", shuffle_keys(F.col("id"), max(n, 1), salt).alias("keys")).orderBy("id").collect()]  # a row a draw

    def counted(key: tuple[pa.Scalar, ...], links: pa.Table, nodes: pa.Table) -> pa.Table:
        """draw, same, known: links of equal families, and of known ones, by draw; draw -1 has them as they are."""
        _, first, second = (k.as_py() for k in key)
        codes = np.asarray(nodes.column("family").combine_chunks().dictionary_encode().indices.fill_null(-1))
        no, rows = np.asarray(nodes.column("no")), [(-1, 0, 0)]
        if first == second == 0:  # every link is in every pair of stretches
            same = links.column("same").drop_null()
            rows = [(-1, int(np.count_nonzero(same)), len(same))]
        child, parent = np.asarray(links.column("no_child")), np.asarray(links.column("no_parent"))
        families = []
        for part in (first, second):
            of = np.full(most if len(stretches) > 1 else n, -1, np.int32)
            here = no // most == part
            of[no[here] - part * most] = codes[here]
            families.append(of)
        for draw, key_ in enumerate(keys):
            a, b = shuffled_places(child, key_, n), shuffled_places(parent, key_, n)
            here = (a // most == first) & (b // most == second)
            a, b = families[0][a[here] - first * most], families[1][b[here] - second * most]
            known = (a >= 0) & (b >= 0)
            rows.append((draw, int(np.count_nonzero(known & (a == b))), int(np.count_nonzero(known))))
        return pa.table([pa.array(x, pa.int64()) for x in zip(*rows)], names=["draw", "same", "known"])

    every = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a in stretches for b in stretches] or [F.struct(F.lit(0).alias("first"), F.lit(0).alias("second"))])
    share = F.pmod(F.xxhash64("no_child", "no_parent"), F.lit(shares)).cast("int")
    dealt = links.select("no_child", "no_parent", "same", share.alias("share"), F.inline(every))
    own = F.floor(F.col("no") / most)
    sent = fixed.select("no", "family", F.explode(F.filter(every, lambda x: (x["first"] == own) | (x["second"] == own))).alias("at"))
    sent = sent.select("no", "family", "at.first", "at.second", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    by = ("share", "first", "second")
    counts = dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(counted, "draw bigint, same bigint, known bigint")
    rates = counts.groupBy("draw").agg(F.try_divide(F.sum("same"), F.sum("known")).alias("r"))
    drawn = F.when(F.col("draw") >= 0, F.col("r"))
    return rates.agg(F.avg(drawn).alias("null_mean"), F.stddev_pop(drawn).alias("null_sd"), F.max(F.when(F.col("draw") < 0, F.col("r"))).alias("observed"))


def paired_gain(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Mean losses, gain and perplexities by keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(a).alias("a"), F.avg(b).alias("b"), F.avg(F.col(b) - F.col(a)).alias("gain"), F.exp(F.avg(a)).alias("perplexity"))


def smoothed_rate(hits: Column, documents: Column) -> Column:
    """Hits per million documents, half a hit added."""
    return (hits + 0.5) / documents * 1e6
