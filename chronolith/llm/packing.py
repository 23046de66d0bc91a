"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Tokenising: a text is cut at single blanks between two visible characters, where the tokenizer's own pre-splitter always
cuts too; each distinct chunk is encoded once per task, found again by hash and confirmed by its bytes, and its ids are gathered by
position. That equals encoding the
whole text (tests/llm compares them), at several times the speed.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import binary_buffers, distinct_segments, segment_hashes, slices, string_buffers

CAPACITY = 2048
#: Pieces that one task packs together; groups are dealt by hash, so each is a fair sample.
GROUP_PIECES = 16384
SLICE_BYTES = 3 << 20
#: Chunks remembered by a worker process, and the bytes that one of them may have.
CACHE, LONGEST = 400_000, 64

_MAYBE_SPACE_LEAD = np.zeros(256, bool)
_MAYBE_SPACE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, 9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F]] = True


class Ragged:
    """Pieces of different length in one flat array."""

    def __init__(self, flat: np.ndarray, start: np.ndarray | None = None, size: np.ndarray | None = None):
        self.flat, self.start, self.size = flat, np.zeros(0, np.int64) if start is None else start, np.zeros(0, np.int64) if size is None else size

    @classmethod
    def of(cls, pieces: list[np.ndarray], kind: type) -> "Ragged":
        size = np.array([len(x) for x in pieces], np.int64)
        return cls(np.concatenate(pieces).astype(kind) if pieces else np.zeros(0, kind), np.cumsum(size) - size, size)

    def pick(self, which: np.ndarray) -> "Ragged":
        return Ragged(self.flat, self.start[which], self.size[which])

    def values(self) -> np.ndarray:
        """All pieces, one behind the other."""
        before = np.cumsum(self.size) - self.size
        return self.flat[np.arange(self.size.sum()) + np.repeat(self.start - before, self.size)]

    def packed(self) -> "Ragged":
        return Ragged(self.values(), np.cumsum(self.size) - self.size, self.size)

    def same(self, other: "Ragged") -> np.ndarray:
        """Which pieces equal those of other, place by place."""
        out = self.size == other.size
        x, y = self.pick(out), other.pick(out)
        differ = np.concatenate([[0], np.cumsum(x.values() != y.values())])
        ends = np.cumsum(x.size)
        out[out] = differ[ends] == differ[ends - x.size]
        return out

    def insert(self, place: np.ndarray, new: "Ragged") -> "Ragged":
        more = new.packed()
        return Ragged(np.concatenate([self.flat, more.flat]), np.insert(self.start, place, more.start + len(self.flat)), np.insert(self.size, place, more.size))


class Encoder:
    """Token ids of whole batches; chunks seen before are looked up."""

    def __init__(self, json_path: str, rank_path: str, pattern: str, special: bytes = b"<|endoftext|>"):
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.special = special
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.width[k] = len(token)
        # What is remembered, by rising hash: ids and bytes of a chunk, as places in two flat arrays, and uses.
        self.keys, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.text = Ragged(np.zeros(0, np.int32)), Ragged(np.zeros(0, np.uint8))

    def _encode(self, chunks: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(chunks)
        plain = []
        for k, c in enumerate(chunks):
            if self.special in c:
                out[k] = np.array(self.whole.encode(c.decode("utf-8"), add_special_tokens=False).ids, np.int32)
            elif len(c) > 1 and c[0] == 0x20 and not _ASCII_SPACE[c[1]] and not _MAYBE_SPACE_LEAD[c[1]] and not _ASCII_SPACE[c[-1]] and not (c[-1] >= 0x80):
                plain.append(k)
            else:
                out[k] = np.array(self.fast.encode_ordinary(c.decode("utf-8")), np.int32)
        if plain:
            ids = np.array(self.fast.encode_ordinary(b"".join(chunks[k] for k in plain).decode("utf-8")), np.int32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(chunks[k]) for k in plain])) + 1
            for k, part in zip(plain, np.split(ids, ends[:-1]), strict=True):
                out[k] = part
        return out

    def rows(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and the n+1 offsets of rows into them."""
        raw, offsets = string_buffers(col)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space = _ASCII_SPACE[raw]
        cut = np.zeros(n, bool)
        if n > 2:
            lead = _MAYBE_SPACE_LEAD[raw]
            before = np.zeros(n, bool)  # the character before may be white space beyond ASCII
            before[2:] |= lead[:-2]
            before[3:] |= lead[:-3] & (raw[:-3] >= 0xE1)
            before &= np.concatenate([[False], raw[:-1] >= 0x80])
            cut[1:-1] = (raw[1:-1] == 0x20) & ~space[:-2] & ~space[2:] & ~lead[2:] & ~before[1:-1]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        chunks, place = distinct_segments(raw, starts, ends)
        text, bounds = binary_buffers(chunks)
        own = Ragged(text, bounds[:-1], np.diff(bounds))
        h = segment_hashes(text, bounds[:-1], bounds[1:])[:, 0]
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        known = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        known[known] = own.pick(known).same(self.text.pick(at[known]))
        new = np.flatnonzero(~known)
        made = Ragged.of(self._encode(chunks.take(pa.array(new)).to_pylist()), np.int32)
        self.hits[at[known]] += 1
        size = np.empty(len(h), np.int64)
        begin = np.empty(len(h), np.int64)
        size[known], begin[known] = self.ids.size[at[known]], self.ids.start[at[known]]
        size[new], begin[new] = made.size, made.start + len(self.ids.flat)
        flat = np.concatenate([self.ids.flat, made.flat])
        size, begin = size[place], begin[place]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        self._remember(h[new], made, own.pick(new))
        return ids, total[np.searchsorted(starts, offsets)]

    def _remember(self, keys: np.ndarray, ids: "Ragged", text: "Ragged") -> None:
        """One chunk for each hash; what has not come again goes first, and long ones are not worth their place."""
        good = np.flatnonzero((text.size <= LONGEST) & ~np.isin(keys, self.keys))
        good = good[np.unique(keys[good], return_index=True)[1]]
        keys, ids, text = keys[good], ids.pick(good), text.pick(good)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.hits = np.insert(self.keys, place, keys), np.insert(self.hits, place, 0)
        self.ids, self.text = self.ids.insert(place, ids), self.text.insert(place, text)
        if len(self.keys) > CACHE:
            keep = np.flatnonzero(self.hits > 0)
            if len(keep) > CACHE // 2:
                keep = np.sort(keep[np.argsort(-self.hits[keep], kind="stable")[: CACHE // 2]])
            self.keys, self.hits = self.keys[keep], np.zeros(len(keep), np.int32)
            self.ids, self.text = self.ids.pick(keep).packed(), self.text.pick(keep).packed()


_encoders: dict[tuple, Encoder] = {}


def encoder(json_path: str, rank_path: str, pattern: str) -> Encoder:
    """One per worker process."""
    key = (json_path, rank_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: each row's ids and end_id, cut only where longer than capacity.

    Pieces of a long row have `capacity` ids, but for the first, which takes what is left over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*tokenizer)
        for part in slices(batches, "text", SLICE_BYTES):
            ids, at = enc.rows(part.column("text"))
            out: list[list] = [[], [], [], [], []]
            for k, doc in enumerate(part.column("id").to_pylist()):
                own = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4")
                cuts = [0, *range(len(own) % capacity or capacity, len(own), capacity), len(own)]
                for no, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for col, v in zip(out, (doc, no, a, b - a, zlib.crc32(own[a:b].tobytes())), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given.

    An item goes into the open bin that makes sum(N[g]**2) over the gaps g of open bins smallest: a bin of gap g >= size
    becomes one of gap g - size, and a full bin leaves the count, which changes the sum by 2 * (N[g - size] - N[g]) + 2,
    or by 1 - 2 * N[g] where it is filled. A new bin is opened only where no open one has room. Ties go to the smallest
    gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    far = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        gaps = count[s:]
        cost = np.where(gaps > 0, 2 * (count[: capacity + 1 - s] - gaps) + 2, far)
        if gaps[0] > 0:
            cost[0] = 1 - 2 * gaps[0]
        g = int(cost.argmin())
        if cost[g] != far:
            gap = g + s
            b = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            open_[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece, sequences filled gaplessly from 0.

    Null and empty texts are the end id alone. Repeated rows are packed each. Ids are cast to bigint. Groups of at most
    about GROUP_PIECES pieces, by a bound from bytes, are packed by one task each, longest first; what a group leaves open
    is a few sequences. Reruns agree. An empty table gives an empty result; further columns are not read.
    """
    # No text has more tokens than bytes, and its end: this bounds the pieces without encoding anything twice.
    seen = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("bytes")).first()
    n = seen["n"] + seen["bytes"] // capacity
    made = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    groups = max(1, -(-n // GROUP_PIECES))
    dealt = made.withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(np.asarray(group.column("length")), capacity)
        no = group.column("group")[0].as_py()
        return pa.table([*(group.column(x) for x in names), pa.array(bins + (no << 32)), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    out = dealt.groupBy("group").applyInArrow(run, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
