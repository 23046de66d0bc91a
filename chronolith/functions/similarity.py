"""Ratcliff-Obershelp similarity of near copies: bounds that reject a pair without comparing it, and the ratio itself.

A pair of n and m characters at a ratio of `least` has at most (1 - least) * (n + m) unmatched ones. Each unmatched character
takes one character from the other's counts and spoils at most GRAM runs of GRAM characters, so pairs that share too few
characters, or too few runs, are below `least` for certain.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters of a run; texts up to SHORT characters are compared by difflib.
GRAM, SHORT = 8, 200
#: Lengths of the runs that a pair is tested by: short ones bear more unmatched characters, long ones are seldom shared by chance.
TESTED = (3, 5, GRAM)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def most_unmatched(n: int, m: int, least: float) -> int:
    """Characters of both texts that may be unmatched at a ratio of `least`."""
    return int((1.0 - least) * (n + m) + 1e-6)


def spoiled_runs(n: int, m: int, least: float, size: int = GRAM) -> int:
    """Runs of `size` characters of the text of n that its partner of m may lack at that ratio."""
    d = most_unmatched(n, m, least)
    return (size - 1) * d + max(0, min(n, (d + n - m) // 2))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE))])


def run_hashes(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A number for each run of `size` neighbouring code points; equal runs have equal numbers."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + codes[k : k + n].astype(np.uint64) + np.uint64(1)
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two multisets."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum())


def may_reach(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """False only where the ratio of the two texts is below `least`."""
    n, m = len(x), len(y)
    d = most_unmatched(n, m, least)
    if n + m - 2 * min(n, m) > d or n + m - 2 * _shared(x, y) > d:
        return False
    for size in TESTED:
        wanted = max(n - size + 1 - spoiled_runs(n, m, least, size), m - size + 1 - spoiled_runs(m, n, least, size))
        if wanted > 0 and _shared(run_hashes(x, size), run_hashes(y, size)) < wanted:
            return False
    return True


class _Sums:
    """Prefix sums from which the hash of any stretch follows."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.powers = codes, _powers(len(codes))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[:-1])])

    def windows(self, lo: int, hi: int, size: int, scale: np.ndarray) -> np.ndarray:
        """Hashes of the stretches of `size` inside [lo, hi), all brought to the same power."""
        with np.errstate(over="ignore"):
            return (self.sums[lo + size : hi + 1] - self.sums[lo : hi + 1 - size]) * scale[len(scale) - 1 - np.arange(lo, hi + 1 - size)]


def matched(x: np.ndarray, y: np.ndarray, least_matched: int) -> int | None:
    """Characters in matching blocks: the longest common stretch, the earliest in x and then in y, and so on to its left and right.

    None where fewer than least_matched come together. The longest stretch is found by bisection over its length, with hashes
    of all stretches of a length.
    """
    a, b = _Sums(x), _Sums(y)
    scale = _powers(max(len(x), len(y)))
    total, open_ = 0, [(0, len(x), 0, len(y))]
    room = min(len(x), len(y))
    while open_:
        open_.sort(key=lambda x: min(x[1] - x[0], x[3] - x[2]))  # the largest parts show first that too little matches
        alo, ahi, blo, bhi = open_.pop()
        most = min(ahi - alo, bhi - blo)
        if most == 0:
            continue
        lo, hi, best = 0, most, None  # a common stretch of lo exists, none of hi + 1
        while lo < hi:
            size = (lo + hi + 1) // 2
            ha, hb = a.windows(alo, ahi, size, scale), b.windows(blo, bhi, size, scale)
            common = np.isin(ha, hb)
            if common.any():
                i = int(common.argmax())
                lo, best = size, (alo + i, blo + int((hb == ha[i]).argmax()))
            else:
                hi = size - 1
        if best is None:
            room -= most
        else:
            i, j = best
            if not np.array_equal(x[i : i + lo], y[j : j + lo]):
                raise ArithmeticError("two stretches have one hash")
            total += lo
            left, right = (alo, i, blo, j), (i + lo, ahi, j + lo, bhi)
            room += min(i - alo, j - blo) + min(ahi - i - lo, bhi - j - lo) + lo - most
            open_ += [left, right]
        if room < least_matched:
            return None
    return total


def ratio(a: str, b: str, least: float) -> float | None:
    """difflib's ratio of two texts (no junk), or None where it is below `least`."""
    x, y = code_points(a), code_points(b)
    n, m = len(x), len(y)
    if n + m == 0:
        return 1.0
    if not may_reach(x, y, least):
        return None
    if min(n, m) > SHORT:
        try:
            same = matched(x, y, -((most_unmatched(n, m, least) - n - m) // 2))
            found = 0.0 if same is None else 2.0 * same / (n + m)
            return found if found >= least else None
        except ArithmeticError:
            pass  # once in 2**64, or made to happen; the plain way cannot be deceived
    found = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    return found if found >= least else None


def ratio_at_least(a: Column | str, b: Column | str, least: float) -> Column:
    """Ratcliff-Obershelp ratio of two texts, null where it is below `least`. Its value depends on which text is the first."""

    @F.arrow_udf(DoubleType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([ratio(s or "", t or "", least) for s, t in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(a, b)
