"""Alignment of two tokenizers over a corpus: which ids overlap, how often, and how each document's links score.

Both tokenizers cut at single blanks between two visible characters, so a text is cut there and each distinct chunk of a slice is
encoded and aligned once: tokens overlap, and boundaries meet, only inside chunks. What a slice of texts has of an id pair is
summed before it is shuffled. Pairs are partitioned by stripes of the second tokenizer's ids; a stripe is a dense block of counts
filled by np.add.at, its row maxima are the best counts of those ids, and the slices' pairs, which lie in the same partition,
are scored against it. Each slice's scores then meet its documents again.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import binary_buffers, distinct_segments, slices, string_buffers
from chronolith.llm.packing import _ASCII_SPACE, _MAYBE_SPACE_LEAD, Ragged
from chronolith.shared import stored

#: Text bytes of a slice; its distinct pairs are one row for each stripe.
SLICE_BYTES = 2 << 20
#: Chunks that are encoded as one text, where both tokenizers cut between them; digits of the largest id.
BLOCK, DIGITS = 4096, 5
#: Stripes: at least so many, one for this many bytes of text, and at most about one for each id of the second tokenizer.
LEAST_STRIPES, STRIPE_BYTES, MOST_STRIPES = 256, 256 << 20, 32_000


class PairEncoder:
    """Both tokenizers' ids of chunks that begin with the blank which the second one puts before a text."""

    def __init__(self, rank_path: str, pattern: str, piece_path: str):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width_a = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width_a[list(ranks.values())] = [len(x) for x in ranks]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece goes on after a blank: chunks of this vocabulary cannot be encoded by themselves")
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.width_b = np.array([len(x) for x in self.bytes_b], np.int64)
        most = max(len(self.width_a), len(self.width_b))
        self.digits = np.array([f"{i:<{DIGITS}d}" for i in range(most)], f"S{DIGITS}").view(np.uint8).reshape(most, DIGITS)
        self.n_digits = np.array([len(str(i)) for i in range(most)])

    def chunks(self, col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks, the place of every chunk among them, and the n+1 offsets of rows; empty and null rows have none."""
        raw, offsets = string_buffers(col)
        sizes = np.diff(offsets)
        begins = np.concatenate([[0], np.cumsum(np.where(sizes > 0, sizes + 1, 0))])
        raw = np.insert(raw, offsets[:-1][sizes > 0], 0x20)
        cut = np.zeros(len(raw), bool)
        if len(raw) > 2:
            space, lead = _ASCII_SPACE[raw], _MAYBE_SPACE_LEAD[raw]
            before = np.zeros(len(raw), bool)  # the character before may be white space beyond ASCII
            before[2:] |= lead[:-2]
            before[3:] |= lead[:-3] & (raw[:-3] >= 0xE1)
            before &= np.concatenate([[False], raw[:-1] >= 0x80])
            cut[1:-1] = (raw[1:-1] == 0x20) & ~space[:-2] & ~space[2:] & ~lead[2:] & ~before[1:-1]
        cut[begins[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        values, place = distinct_segments(raw, starts, np.append(starts[1:], len(raw)))
        return values, place, np.searchsorted(starts, begins)

    def _encode(self, chunks: list[bytes], together: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both tokenizers for all chunks in a row; together: in blocks, which is the same where both cut between them."""
        texts = ["".join(chunks[k : k + BLOCK]) for k in range(0, len(chunks), BLOCK)] if together else chunks
        a = [self.ranks.encode_to_numpy(x, disallowed_special=()) for x in texts]
        b = self.pieces.encode([x[1:] for x in texts], num_threads=1)
        return np.concatenate(a).astype(np.int64), np.array(list(itertools.chain.from_iterable(b)), np.int64)

    def align(self, values: pa.Array) -> Chunks:
        """Tokens, groups, pairs and group texts of distinct chunks."""
        raw, offsets = binary_buffers(values)
        n = len(values)
        texts = values.cast(pa.large_string()).to_pylist()
        first, last, size = raw[offsets[:-1] + 1], raw[offsets[1:] - 1], np.diff(offsets)
        back = lambda k: np.where(size >= k, raw[np.maximum(offsets[1:] - k, 0)], 0)
        odd = _ASCII_SPACE[first] | _MAYBE_SPACE_LEAD[first] | _ASCII_SPACE[last] | ((last >= 0x80) & (_MAYBE_SPACE_LEAD[back(2)] | _MAYBE_SPACE_LEAD[back(3)]))
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        even = n - int(odd.sum())
        own = [texts[k] for k in order.tolist()]
        parts = [self._encode(x, together) for x, together in ((own[:even], True), (own[even:], False)) if x]
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        good = np.ones(n, bool)
        if b"".join([self.bytes_b[i] for i in b.tolist()]) != "".join(own).encode():  # some chunks are not given back
            each = self.pieces.encode([x[1:] for x in own], num_threads=1)
            good = np.array([b"".join([self.bytes_b[i] for i in y]) == x.encode() for x, y in zip(own, each, strict=True)])
            own = [x for x, ok in zip(own, good.tolist(), strict=True) if ok]
            a, b = self._encode(own, False) if own else (a[:0], b[:0])
        bounds = np.cumsum(size[order][good])  # of the good chunks, in bytes
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        stops = np.zeros((ends_a[-1] if len(ends_a) else 0) + 1, np.uint8)  # by byte: 1 where a token of A ends, 2 where one of B does
        stops[ends_a] = 1
        stops[ends_b] |= 2
        ends, both = np.flatnonzero(stops), np.flatnonzero(stops == 3)
        in_a, in_b = stops[ends] & 1, stops[ends] >> 1
        pairs = a[np.cumsum(in_a, dtype=np.int64) - in_a] << 32 | b[np.cumsum(in_b, dtype=np.int64) - in_b]
        text, text_ends = self._group_text(a, b, ends_a, ends_b, both)
        upto = [np.searchsorted(x, bounds) + 1 for x in (ends_a, ends_b, both, ends)]
        made = Chunks(n)
        for column, to in zip(made.counts.T, upto, strict=True):
            column[order[good]] = np.diff(to, prepend=0)
        made.good[order] = good
        to = text_ends[upto[2] - 1].tolist()
        blob = text.tobytes()
        for k, s, e in zip(order[good].tolist(), [0, *to[:-1]], to, strict=True):
            made.texts[k] = blob[s:e]
        made.pairs = Ragged(pairs, np.zeros(n, np.int64), np.zeros(n, np.int64))
        made.pairs.start[order[good]], made.pairs.size[order[good]] = upto[3] - made.counts[order[good], 3], made.counts[order[good], 3]
        return made

    def _group_text(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text "a1,a2|b1;..." of all groups, each with ';' at its end, and the places of these ends."""
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        to_a, to_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1  # tokens up to a group's end
        at_a = np.arange(len(a)) + np.concatenate([[0], to_b])[group_a]
        at_b = np.arange(len(b)) + to_a[group_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), 0x2C, np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[to_a - 1]], mark[at_b[to_b - 1]] = 0x7C, 0x3B
        many = self.n_digits[ids]
        stop = np.cumsum(many + 1)
        out = np.empty(stop[-1] if len(stop) else 0, np.uint8)
        out[stop - 1] = mark
        for k in range(DIGITS):
            wide = many > k
            out[(stop - 1 - many)[wide] + k] = self.digits[ids[wide], k]
        return out, stop[at_b[to_b - 1]]


class Chunks:
    """counts: tokens of A and B, groups, links; texts of the groups; pairs of ids, a * 2**32 + b; good: B gives the bytes back."""

    def __init__(self, n: int):
        self.counts, self.good, self.texts = np.zeros((n, 4), np.int64), np.zeros(n, bool), [b""] * n
        self.pairs = Ragged(np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))


_encoders: dict[tuple, PairEncoder] = {}


def encoder(*paths: str) -> PairEncoder:
    """One per worker process."""
    if paths not in _encoders:
        _encoders[paths] = PairEncoder(*paths)
    return _encoders[paths]


SLICE_COLUMNS = "slice string, stripe int, a array<int>, b array<int>, links array<bigint>, place array<int>"
DOC_COLUMNS = "id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, doc_chunks binary, doc_sizes binary, chunk_pairs binary, chunk_sizes binary"


def _packed(values: np.ndarray) -> bytes:
    """Numbers that are not negative, in as few bytes each as the largest needs; the first byte says how many."""
    size = next(k for k in (1, 2, 4, 8) if k == 8 or not len(values) or int(values.max()) < 1 << 8 * k)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _sliced(paths: tuple[str, ...], stripes: int):
    """Per slice one row with its documents and chunks, and one for each stripe with the pairs that occur in it."""
    kinds = [pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int32())]
    doc_kinds = [pa.list_(t) for t in (*[pa.int64()] * 5, pa.string())] + [pa.binary()] * 4
    names = [x.split()[0] for x in f"{SLICE_COLUMNS}, {DOC_COLUMNS}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", SLICE_BYTES):
            enc = encoder(*paths)
            values, place, rows = enc.chunks(piece.column("text"))
            found = enc.align(values) if len(values) else Chunks(0)
            n = piece.num_rows
            sums, sha, doc_chunks = np.zeros((n, 4), np.int64), [""] * n, [place[:0]] * n
            for k in range(n):
                own = place[rows[k] : rows[k + 1]]
                if len(own) and found.good[own].all():
                    doc_chunks[k], sums[k] = own, found.counts[own].sum(axis=0)
                    sha[k] = hashlib.sha256(b"".join([found.texts[c] for c in own.tolist()])[:-1]).hexdigest()
            times = np.bincount(np.concatenate(doc_chunks), minlength=len(values))
            coded = pa.array(found.pairs.values()).dictionary_encode()
            pairs, local = np.asarray(coded.dictionary), np.asarray(coded.indices)
            links = np.zeros(len(pairs), np.int64)
            np.add.at(links, local, np.repeat(times, found.pairs.size))
            key = uuid.uuid4().hex
            docs = [piece.column("id").to_pylist(), *sums.T, sha, *map(_packed, (np.concatenate(doc_chunks), np.array([len(x) for x in doc_chunks]), local, found.pairs.size))]
            docs = [pa.array([x], t) for x, t in zip(docs, doc_kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([-1], pa.int32()), *(pa.nulls(1, t) for t in kinds), *docs], names=names)
            a, b = pairs >> 32, pairs & 0xFFFFFFFF
            used = np.flatnonzero(links)
            order = used[np.argsort(b[used] % stripes, kind="stable")]
            stripe = b[order] % stripes
            cuts = np.flatnonzero(np.diff(stripe, prepend=-1))
            ends = np.append(cuts, len(order))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[order], t.value_type)) for x, t in zip((a, b, links, np.arange(len(pairs))), kinds, strict=True)]
            m = len(cuts)
            yield pa.RecordBatch.from_arrays([pa.array([key] * m, pa.string()), pa.array(stripe[cuts], pa.int32()), *lists, *(pa.nulls(m, t) for t in doc_kinds)], names=names)

    return run


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return np.asarray(pa.concat_arrays([x.flatten() for x in rows.column(name).chunks]) if rows.num_rows else pa.array([], pa.int64()))


def _count_stripe(rows: pa.Table) -> pa.Table:
    """Scores of the slices' pairs in one stripe: each pair's count over all slices, and whether it is its b's highest."""
    a, b, links, place = (_flat(rows, c) for c in ("a", "b", "links", "place"))
    ids_a, col = np.unique(a, return_inverse=True)
    ids_b, row = np.unique(b, return_inverse=True)
    block = np.zeros((len(ids_b), len(ids_a)), np.int64)
    np.add.at(block, (row, col), links)
    best, count = block.max(axis=1), block[row, col]
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(rows.column("a"))))]), pa.int32())
    made = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place, count, count == best[row])]
    return pa.table([rows.column("slice").combine_chunks(), *made], names=["slice", "place", "count", "best"])


def _score_docs(rows: pa.Table) -> pa.Table:
    """Documents of one slice with their links' scores: sums over chunks of sums over pairs."""
    own, said = rows.filter(pc.is_valid(rows.column("id"))), rows.filter(pc.is_valid(rows.column("place")))
    pair_of, chunk_sizes, doc_chunks, doc_sizes = (_unpacked(own.column(c)[0].as_py()) for c in ("chunk_pairs", "chunk_sizes", "doc_chunks", "doc_sizes"))
    score = np.zeros((int(pair_of.max()) + 1 if len(pair_of) else 0, 2), np.int64)
    if said.num_rows:
        place = _flat(said, "place")
        score[place, 0], score[place, 1] = np.asarray(pa.concat_arrays([x.flatten() for x in said.column("best").chunks]).cast(pa.int8())), _flat(said, "count")

    def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values, axis=0)])
        return np.diff(total[np.concatenate([[0], np.cumsum(sizes)])], axis=0)

    by_doc = sums(sums(score[pair_of], chunk_sizes)[doc_chunks], doc_sizes)
    columns = [pa.concat_arrays([x.flatten() for x in own.column(c).chunks]) for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    return pa.table([*columns, pa.array(by_doc[:, 0]), pa.array(by_doc[:, 1])], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])


def align(docs: DataFrame, paths: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    paths: the first tokenizer's ranks and pre-splitting pattern, and the second one's piece model. Tokenizer A reads a
    blank and the text, B the text, before which it puts a blank itself; strings of special tokens are plain text. Offsets at
    which tokens of both end cut them into groups; a link is a pair of an A and a B token whose bytes overlap; a pair of ids
    counts as often as it is linked in all of docs. n_best: links whose count is the highest of their B id, ties included.
    groups_sha256 is of "a1,a2|b1;a3|b2,b3". Null and empty texts, and texts of which one tokenizer does not give back the bytes
    (it holds U+2581, say), have no tokens: zeros, and an empty string in place of the digest. Repeated rows count each. Ids are
    cast to bigint. An empty table gives an empty result; further columns, whatever their names, are not read.

    A group of rows is one slice, or one stripe of ids with a row for each slice; stripes grow with the bytes of text.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    stripes = min(MOST_STRIPES, max(LEAST_STRIPES, seen // STRIPE_BYTES))
    made = stored(rows.mapInArrow(_sliced(paths, stripes), f"{SLICE_COLUMNS}, {DOC_COLUMNS}"), "slices")
    pairs = made.filter("stripe >= 0").select(*[x.split()[0] for x in SLICE_COLUMNS.split(", ")])
    scored = pairs.groupBy("stripe").applyInArrow(_count_stripe, "slice string, place array<int>, count array<bigint>, best array<boolean>")
    whole = made.filter("stripe < 0").select("slice", *[x.split()[0] for x in DOC_COLUMNS.split(", ")])
    both = whole.unionByName(scored, allowMissingColumns=True)
    out = both.groupBy("slice").applyInArrow(_score_docs, "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return out.withColumnRenamed("id", id_col)
