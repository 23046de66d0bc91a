"""Elias-Fano sequences over flat arrays, with whole vectors of queries at a time.

A monotone sequence is kept as packed low bits and a bit vector of unary high parts; `ahead` and `gaps` count the ones and
zeros before each 64-bit word, which makes select a binary search and a look at one word. All of it may stay in a mapped
file; a query touches the pages it needs and nothing is built in memory.
"""

from __future__ import annotations

import numpy as np

_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(k for k in range(8) if _b >> k & 1):
        _SELECT[_b, _r] = _p


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values of `width` bits each, side by side in 64-bit words."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, np.uint64)
    if width and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.add.at(out, word, values << shift)  # bits never overlap, so adding sets them
        over = shift + np.uint64(width) > np.uint64(64)
        np.add.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


_ONES, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_FIVES, _THREES, _FIFTEENS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th one (or zero, if flip) of a bit vector; before: ones (zeros) ahead of each word."""
    w = np.searchsorted(before, k.astype(before.dtype), "right") - 1
    rest = (k - before[w]).astype(np.uint64)
    word = ~words[w] if flip else words[w]
    with np.errstate(over="ignore"):
        # Ones of every byte, then of all bytes up to it, eight sums in one number.
        upto = word - ((word >> np.uint64(1)) & _FIVES)
        upto = (upto & _THREES) + ((upto >> np.uint64(2)) & _THREES)
        upto = ((upto + (upto >> np.uint64(4))) & _FIFTEENS) * _ONES
        # The high bit of a byte stays where the sum up to it is at most `rest`: as many bytes lie before the bit sought.
        shift = ((((rest * _ONES) | _HIGH) - upto) & _HIGH) >> np.uint64(7)
        shift = ((shift * _ONES) >> np.uint64(56)) << np.uint64(3)
        inner = rest - ((upto << np.uint64(8)) >> shift & np.uint64(0xFF))
    octet = (word >> shift & np.uint64(0xFF)).astype(np.int64)
    return w * 64 + shift.astype(np.int64) + _SELECT[octet, inner.astype(np.int64)]


class EliasFano:
    """Up to 2**31 non-decreasing values below 2**62; arrays may be memory maps."""

    NAMES = ("head", "low", "high", "ahead", "gaps")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ahead: np.ndarray, gaps: np.ndarray):
        self.n, self.width, self.top = (int(x) for x in head)
        self.head, self.low, self.high, self.ahead, self.gaps = head, low, high, ahead, gaps

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        width = max(0, (last // max(n, 1)).bit_length() - 1)
        high = values >> np.uint64(width)
        top = last >> width
        bits = np.zeros((n + top + 1 + 63) // 64 * 64, np.uint8)
        bits[high.astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = _POPCOUNT[words.view(np.uint8).reshape(-1, 8)].sum(1, dtype=np.int64)
        ahead = np.cumsum(ones) - ones
        gaps = np.arange(len(words)) * 64 - ahead
        return cls(np.array([n, width, top], np.int64), _pack(values & np.uint64((1 << width) - 1), width), words, ahead.astype(np.uint32), gaps.astype(np.uint32))

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        if not len(i):
            return np.zeros(0, np.int64)
        high = _select(self.high, self.ahead, i, False) - i
        return (high << self.width) | _unpack(self.low, self.width, i).astype(np.int64)

    def _ones_until_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most k."""
        return _select(self.high, self.gaps, k, True) - k

    def find(self, y: np.ndarray) -> np.ndarray:
        """Place of each y among distinct values, or -1."""
        out = np.full(len(y), -1, np.int64)
        if not self.n:
            return out
        h = y >> self.width
        at = np.flatnonzero((y >= 0) & (h <= self.top))
        h, want = h[at], (y[at] & ((1 << self.width) - 1)).astype(np.uint64)
        hi = self._ones_until_zero(h)
        lo = np.where(h > 0, self._ones_until_zero(np.maximum(h - 1, 0)), 0)
        live = np.flatnonzero(lo < hi)
        while len(live):  # successor search on the low bits inside one high part
            mid = (lo[live] + hi[live]) // 2
            got = _unpack(self.low, self.width, mid)
            same, less = got == want[live], got < want[live]
            out[at[live[same]]] = mid[same]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[~same & (lo[live] < hi[live])]
        return out
