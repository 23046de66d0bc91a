"""What the operators share: tables and words of Arrow buffers.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D, after A-Z became a-z. That is decided on single
UTF-8 bytes, so whole batches are cut by numpy; only distinct words of a slice become Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java and RE2 form of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, m: int) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(m))


# ---------------------------------------------------------------- words of Arrow strings

#: Text bytes worked on at once; the arrays of a slice take about 60 times as much at their peak.
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    return binary_buffers(col.cast(pa.large_string()).fill_null(""))


def binary_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a large string or binary column without nulls."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def distinct_segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct raw[start:end] as a binary column, told apart byte by byte, and for each segment its place among them.

    Segments rise and do not overlap.
    """
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    side_by_side = bool((starts[1:] == ends[:-1]).all())
    if side_by_side:
        bounds = np.append(starts, ends[-1]).astype(np.int64)
    else:  # segments and what lies between them, as one column over the same bytes
        bounds = np.empty(2 * len(starts), np.int64)
        bounds[::2], bounds[1::2] = starts, ends
    found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    codes = np.asarray(found.indices)
    if side_by_side:
        return found.dictionary, codes
    used = np.zeros(len(found.dictionary), bool)
    used[codes[::2]] = True
    return found.dictionary.filter(pa.array(used)), (np.cumsum(used) - 1)[codes[::2]]


def hashes(values: list[bytes]) -> np.ndarray:
    """uint64[n, 2]: 128 bits of XXH3 of each value; equal bytes give equal hashes in every process."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, values)), "<u8").reshape(-1, 2)


def segment_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64[n, 2]: 128 bits for each raw[start:end], equal for equal bytes in every process; segments as above.

    Up to 16 bytes a segment is read as two numbers, which with its length tell it apart from all others of that kind, and
    these are mixed; longer ones are hashed once for each distinct one.
    """
    out = np.empty((len(starts), 2), np.uint64)
    size = ends - starts
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    every = np.uint64(2**64 - 1)
    with np.errstate(over="ignore"):
        bits = np.minimum(size, 8).astype(np.uint64) << np.uint64(3)
        a = eight[starts] & np.where(bits > 0, every >> (np.uint64(64) - np.maximum(bits, np.uint64(8))), np.uint64(0))
        a = mix(a + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.full(len(starts), mix(np.zeros(1, np.uint64) + np.uint64(1))[0])
        wide = np.flatnonzero(size > 8)
        bits = np.minimum(size[wide] - 8, 8).astype(np.uint64) << np.uint64(3)
        b[wide] = mix((eight[starts[wide] + 8] & (every >> (np.uint64(64) - bits))) ^ np.uint64(0xD6E8FEB86659FD93))
        out[:, 0] = mix(a ^ (b * np.uint64(0xFF51AFD7ED558CCD)))
        out[:, 1] = mix(b + a * np.uint64(0xC4CEB9FE1A85EC53))
    long_ = np.flatnonzero(size > 16)
    if len(long_):
        values, place = distinct_segments(raw, starts[long_], ends[long_])
        out[long_] = hashes(values.to_pylist())[place]
    return out


def words(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (uint64[n, 2]) of all words of a string column in order, and the n+1 offsets of its rows into them."""
    raw, offsets = string_buffers(col)
    if lower:
        raw = _TO_LOWER[raw]
    inside = ~_IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(raw)]
    first[edges] = inside[edges]  # a row starts a word even where the row before it ends in one
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return segment_hashes(raw, starts, ends), np.searchsorted(starts, offsets)
