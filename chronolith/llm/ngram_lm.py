"""An n-gram model in an Elias-Fano trie, built and asked in shards.

Level 1 holds the words (62 bits of a 128-bit hash, sorted). A node of level k is a word after a context that is a node of
level k - 1; the nodes stand in the order of their parents, and monotone pointers give each parent its range. Within a
range the symbols rise; with the last value of the range before added they rise over the whole shard, so one successor
search finds a child. Symbols of level 3 are context-relative: not the word, but its place among the successors of the
middle word. Probabilities are interpolated absolute discounting (Ney), quantised to a byte.

What level 1's discount takes from the known words belongs to words that were not seen, of which there are held to be one
more than of known ones: each has the same share, so known and unknown words sum to 1.

Shards are cut by tokens: the cumulative counts of level k - 1 place every n-gram on the line of all training tokens, and a
parent's own stretch of it is divided by symbol. So a word or pair that a third of all tokens follow spans as many shards
as it needs. Counts cover every training row. The driver gathers a few totals; indexes and levels are files in the shared
folder, memory-mapped by the workers, of which a worker keeps OPEN_FILES open.
"""

from __future__ import annotations

import collections
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import slices, words
from chronolith.llm.elias_fano import EliasFano
from chronolith.shared import fresh_path, stored

END = 0x1D8E4E27C47D124C  # in place of the end token's hash
SLICE_BYTES = 4 << 20
#: Keys a task holds before it sends them on, sorted and counted.
HELD_KEYS = 2_000_000
#: Tokens of training text for each shard of a level.
SHARD_TOKENS = 2_000_000
#: Level files that a worker keeps open.
OPEN_FILES = 512


# ---------------------------------------------------------------- files of the shared folder


class Files:
    """Named files below a folder of the shared store; mounted paths are mapped in place, others are read into memory."""

    def __init__(self, uri: str):
        self.uri = uri
        self.local = uri.removeprefix("file://") if uri.startswith("file:///") else uri.removeprefix("file:") if uri.startswith("file:/") else uri if "://" not in uri else None

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        head, at = {}, 0
        for k, a in arrays.items():
            head[k] = (a.dtype.str, at, len(a))
            at += (a.nbytes + 7) // 8 * 8
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        body = b"".join([len(text).to_bytes(8, "little"), text, *(x for a in arrays.values() for x in (np.ascontiguousarray(a).tobytes(), b"\0" * (-a.nbytes % 8)))])
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            tmp = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                f.write(body)
            os.replace(tmp, f"{self.local}/{name}")  # a task that runs twice writes the same bytes
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.uri)
            store.create_dir(path)
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(body)

    def get(self, name: str) -> dict[str, np.ndarray]:
        if self.local is not None:
            raw = np.asarray(np.memmap(f"{self.local}/{name}", np.uint8, "r"))
        else:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(self.uri)
            with store.open_input_stream(f"{base}/{name}") as f:
                raw = np.frombuffer(f.read(), np.uint8)
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())
        return {k: raw[8 + n + at : 8 + n + at + size * np.dtype(t).itemsize].view(t) for k, (t, at, size) in head.items()}


def _named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}_{k}": v for k, v in arrays.items()}


def _ef(prefix: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano(*(arrays[f"{prefix}_{k}"] for k in EliasFano.NAMES))


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


def _pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of numbers from -1 on, and where in that order a pair differs from the one before."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    bits = int(second.max() + 1).bit_length()
    if int(first.max() + 1).bit_length() + bits <= 63:
        key = ((first + 1) << bits) | (second + 1)
        order = np.argsort(key)
        key = key[order]
        return order, np.concatenate([[True], key[1:] != key[:-1]])
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """Totals and the place of the files. discount: of levels 1, 2 and 3. nodes: of the levels."""

    uri: str
    word_bits: int = 0
    vocabulary: int = 0
    tokens: int = 0
    discount: dict[int, float] = field(default_factory=dict)
    nodes: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self._open: collections.OrderedDict[str, tuple] = collections.OrderedDict()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open = collections.OrderedDict()

    def _file(self, name: str, parts: tuple[str, ...] = ()) -> dict:
        """Arrays of a file; the sequences named are opened."""
        if name in self._open:
            self._open.move_to_end(name)
        else:
            arrays = Files(self.uri).get(name)
            self._open[name] = arrays | {p: _ef(p, arrays) for p in parts}
            if len(self._open) > OPEN_FILES:
                self._open.popitem(last=False)
        return self._open[name]

    def index(self, level: int) -> dict[str, np.ndarray]:
        return self._file(f"level{level}-index")

    @property
    def step(self) -> float:
        """Of log10, between two quantised values: no seen n-gram is rarer than a hundredth of a token."""
        return (np.log10(max(self.tokens, 1)) + 2) / 254

    def quantise(self, log10: np.ndarray) -> np.ndarray:
        return (1 + np.clip(np.rint(-log10 / self.step), 0, 254)).astype(np.uint8)

    def value(self, q: np.ndarray) -> np.ndarray:
        """log10 of a quantised number; 0 stands for none and has weight 1."""
        return np.where(q > 0, (q.astype(np.float64) - 1) * -self.step, 0.0)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each word hash; id -1 and count 0 for unknown words. h: sorted."""
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        if not self.vocabulary:
            return out, count
        ix = self.index(1)
        edge = np.searchsorted(h, ix["shard"].astype(np.uint64) << np.uint64(64 - self.word_bits)) if self.word_bits else np.array([0])
        stop = np.searchsorted(h, ((ix["shard"].astype(np.uint64) + np.uint64(1)) << np.uint64(64 - self.word_bits)) - np.uint64(1), "right") if self.word_bits else np.array([len(h)])
        for k in np.flatnonzero(stop > edge):
            a = self._file(f"level1-{ix['shard'][k]}", ("key", "cum"))
            part = slice(edge[k], stop[k])
            at = a["key"].find(_inner(h[part], self.word_bits))
            good = np.flatnonzero(at >= 0)
            out[edge[k] + good] = at[good] + ix["first"][k]
            count[edge[k] + good] = a["cum"].access(at[good] + 1) - a["cum"].access(at[good])
        return out, count

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """log10 probability of words that occur `count` times."""
        if not self.tokens:
            return np.zeros(len(count))
        unknown = self.discount[1] * self.vocabulary / self.tokens / (self.vocabulary + 1)
        return np.log10(np.where(count > 0, (count - self.discount[1]) / self.tokens, unknown))

    def mass(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all nodes of the level before each of these, and its own. node: sorted."""
        ix = self.index(level)
        before, own = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        edge = np.searchsorted(node, ix["first"])
        for k in np.flatnonzero(np.diff(edge)):
            cum = self._file(f"level{level}-{ix['shard'][k]}", ("key", "cum") if level == 1 else ("ptr", "sym", "cum"))["cum"]
            part = slice(edge[k], edge[k + 1])
            at = node[part] - ix["first"][k]
            before[part] = cum.access(at)
            own[part] = cum.access(at + 1) - before[part]
            before[part] += ix["cum"][k]
        return before, own

    def children(self, level: int, parent: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """Node (-1: none), its place in its range, its log10 probability, the parent's log10 back-off weight and children.

        Pairs are sorted; no parent is below 0, and a symbol of -1 is no child's.
        """
        n = len(parent)
        node, rank, prob, back, kinds = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        if not n or not self.nodes.get(level):
            return node, rank, prob, back, kinds
        ix = self.index(level)
        place = np.searchsorted(ix["parent"], parent, "right") - 1
        late = np.flatnonzero((place >= 0) & (ix["parent"][np.maximum(place, 0)] == parent) & (ix["symbol"][np.maximum(place, 0)] > symbol))
        if len(late):  # a parent of several shards: bisect on the symbol
            lo, hi = np.searchsorted(ix["parent"], parent[late]), place[late]
            lo = np.maximum(lo - (ix["symbol"][lo] > symbol[late]), 0)
            while (lo < hi).any():
                mid = (lo + hi + 1) // 2
                fits = ix["symbol"][mid] <= symbol[late]
                lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
            place[late] = lo
        edge = np.searchsorted(place, np.arange(len(ix["shard"]) + 1))
        for k in np.flatnonzero(np.diff(edge)):
            a = self._file(f"level{level}-{ix['shard'][k]}", ("ptr", "sym", "cum") if level == 2 else ("ptr", "sym"))
            part = np.arange(edge[k], edge[k + 1])
            p = parent[part] - ix["parent"][k]
            here = p < len(a["back"])
            part, p = part[here], p[here]
            if not len(p):
                continue
            fresh = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            one, of = p[fresh], np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(p))))
            start, stop = a["ptr"].access(one), a["ptr"].access(one + 1)
            base = np.where(start > 0, a["sym"].access(np.maximum(start - 1, 0)) + 1, 0)
            many = stop - start
            many[one == 0] = ix["kinds_first"][k]
            many[one == len(a["back"]) - 1] = ix["kinds_last"][k]
            start, stop, base = start[of], stop[of], base[of]
            at = a["sym"].find(base + symbol[part])
            good = (at >= start) & (at < stop) & (symbol[part] >= 0)
            node[part] = np.where(good, at + ix["first"][k], -1)
            rank[part] = np.where(good, at - start + np.where(p == 0, ix["lead"][k], 0), 0)
            prob[part] = np.where(good, self.value(a["prob"][np.maximum(at, 0)]), 0)
            back[part], kinds[part] = self.value(a["back"][p]), many[of]
        return node, rank, prob, back, kinds


def _inner(h: np.ndarray, bits: int) -> np.ndarray:
    """A word hash inside its shard, below 2**62."""
    inside = h << np.uint64(bits) >> np.uint64(bits) if bits else h
    return (inside >> np.uint64(2)).astype(np.int64)


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct tokens, the place among them of every token of every row, and offsets of the rows.

    A row's last token is the end. Two low bits of a hash are dropped, so that a shard's values fit its sequence.
    """
    every, at = words(col)
    found = pa.array(every[:, 0] >> np.uint64(2) << np.uint64(2)).dictionary_encode()
    codes = np.asarray(found.indices)
    uniq, place = np.unique(np.append(np.asarray(found.dictionary), np.uint64(END)), return_inverse=True)
    rows = len(at) - 1
    ends = at[1:] + np.arange(1, rows + 1) - 1
    out = np.empty(len(codes) + rows, np.int64)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask], out[ends] = place[codes], place[-1]
    return uniq, out, np.concatenate([[0], ends + 1])


@dataclass
class Looked:
    """A slice of rows after look-up: per token, and per pair of a token and the one before."""

    at: np.ndarray
    row: np.ndarray
    word: np.ndarray
    count: np.ndarray
    node2: np.ndarray | None = None
    rank2: np.ndarray | None = None
    prob2: np.ndarray | None = None
    back2: np.ndarray | None = None
    kinds2: np.ndarray | None = None


def _by_distinct(level: int, model: Model, parent: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
    """model.children for any order of parents, asked once per distinct pair; parents below 0 have no children."""
    good = np.flatnonzero(parent >= 0)
    order, fresh = _pairs(parent[good], symbol[good])
    one = good[order[fresh]]
    place = np.empty(len(good), np.int64)
    place[order] = np.cumsum(fresh) - 1
    out = []
    for x, none in zip(model.children(level, parent[one], symbol[one]), (-1, 0, 0.0, 0.0, 0), strict=True):
        full = np.full(len(parent), none, x.dtype)
        full[good] = x[place]
        out.append(full)
    return tuple(out)


def _look(model: Model, col: pa.Array, level: int) -> Looked:
    uniq, place, at = _tokens(col)
    word, count = model.ids(uniq)
    got = Looked(at, np.repeat(np.arange(len(at) - 1), np.diff(at)), word[place], count[place])
    if level >= 3:
        got.node2, got.rank2, got.prob2, got.back2, got.kinds2 = _by_distinct(2, model, _before(got.word, got), got.word)
    return got


def _before(values: np.ndarray, got: Looked) -> np.ndarray:
    """The value one token earlier in the same row, or -1."""
    out = np.concatenate([[-1], values[:-1]])
    out[got.at[:-1]] = -1
    return out


# ---------------------------------------------------------------- building


def _planes(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed byte planes."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    wide = 4 if width <= 4 else 8
    raw = np.ascontiguousarray(a.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T[:width])
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _unplanes(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(-1, n)
    full = np.zeros((8, n), np.uint8)
    full[: len(raw)] = raw
    return np.ascontiguousarray(full.T).view("<u8").reshape(-1).astype(np.int64)


def _written(model: Model, level: int, rows: DataFrame, build) -> dict[str, int]:
    """Writes the index of a level; its totals. rows: one per shard, `shard` and some numbers; build: the index's arrays."""
    uri, names = model.uri, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = {c: np.zeros(0, np.int64) for c in names}
        for batch in batches:
            cols = {c: np.append(cols[c], np.asarray(batch.column(c))) for c in names}
        Files(uri).put(f"level{level}-index", build(cols))
        yield pa.RecordBatch.from_arrays([pa.array([int(cols[c].sum())]) for c in ("nodes", "total", "ones", "twos")], names=["nodes", "total", "ones", "twos"])

    # A few numbers for each shard of SHARD_TOKENS tokens or 4,096 rows: one task can hold them.
    done = rows.repartition(1).sortWithinPartitions("shard").mapInArrow(run, "nodes bigint, total bigint, ones bigint, twos bigint").first()
    return done.asDict() if done else {"nodes": 0, "total": 0, "ones": 0, "twos": 0}  # no row, no task


def _vocabulary(rows: DataFrame, model: Model) -> None:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            uniq, inverse = np.unique(key, return_inverse=True)
            held.clear()
            total = np.bincount(inverse, weights=n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((uniq >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(uniq), np.int64)), pa.array(uniq.view(np.int64)), pa.array(total)], names=["shard", "h", "n"])

        for part in slices(batches, "text", SLICE_BYTES):
            uniq, place, _ = _tokens(part.column("text"))
            held.append((uniq, np.bincount(place, minlength=len(uniq))))
            if sum(len(x[0]) for x in held) > HELD_KEYS:
                yield flush()
        if held:
            yield flush()

    uri, bits = model.uri, model.word_bits

    def build(group: pa.Table) -> pa.Table:
        h, inverse = np.unique(np.asarray(group.column("h")).view(np.uint64), return_inverse=True)
        n = np.bincount(inverse, weights=np.asarray(group.column("n"))).astype(np.int64)
        no = group.column("shard")[0].as_py()
        Files(uri).put(f"level1-{no}", _named("key", EliasFano.build(_inner(h, bits)).arrays()) | _named("cum", EliasFano.build(np.concatenate([[0], np.cumsum(n)])).arrays()))
        return pa.table({"shard": [no], "nodes": [len(h)], "total": [int(n.sum())], "ones": [int((n == 1).sum())], "twos": [int((n == 2).sum())]})

    def index(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"shard": cols["shard"], "first": np.concatenate([[0], np.cumsum(cols["nodes"])]), "cum": np.concatenate([[0], np.cumsum(cols["total"])])}

    made = rows.mapInArrow(count, "shard bigint, h bigint, n bigint").groupBy("shard").applyInArrow(build, "shard bigint, nodes bigint, total bigint, ones bigint, twos bigint")
    done = _written(model, 1, stored(made, "words"), index)
    model.vocabulary = model.nodes[1] = done["nodes"]
    model.tokens = done["total"]
    model.discount[1] = _discount(done["ones"], done["twos"])


def _sent(model: Model, level: int, held: list[tuple[np.ndarray, ...]], per_shard: int) -> pa.RecordBatch:
    """Distinct keys (parent, symbol, low, span) of a task with their counts, by shard."""
    parent, symbol, low, span = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order, fresh = _pairs(parent, symbol)
    first = np.flatnonzero(fresh)
    n, one = np.diff(np.append(first, len(order))), order[first]
    parent, symbol, low, span = parent[one], symbol[one], low[one], span[one]
    starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(parent))))
    before, own = model.mass(level - 1, parent[starts])
    # The place on the line of all tokens never falls from one key to the next, and neither does the shard.
    shard = np.floor((before[of] + own[of] * (symbol / span)) / per_shard).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    nos, blobs = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        nos.append(int(shard[a]))
        blobs.append([_planes(np.diff(parent[a:b], prepend=0)), _planes(symbol[a:b]), _planes(n[a:b]), zstandard.ZstdCompressor(level=1).compress(low[a:b].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(nos, pa.int64()), *[pa.array([b[k] for b in blobs], pa.binary()) for k in range(4)]], names=["shard", "p", "s", "n", "low"])


def _level(rows: DataFrame, model: Model, level: int) -> None:
    """Counts of all n-grams of `level`, sorted and compressed by the tasks that meet them, merged by shard, then weighed."""
    per_shard = SHARD_TOKENS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in slices(batches, "text", SLICE_BYTES):
            got = _look(model, part.column("text"), level)
            if level == 2:
                parent, symbol, low, span = _before(got.word, got), got.word, model.quantise(model.unigram(got.count)), np.full(len(got.word), model.vocabulary)
            else:
                parent, symbol, low, span = _before(got.node2, got), got.rank2, model.quantise(got.prob2), got.kinds2
            good = parent >= 0
            held.append((parent[good], symbol[good], low[good], span[good]))
            if sum(len(x[0]) for x in held) > HELD_KEYS:
                yield _sent(model, level, held, per_shard)
                held = []
        if sum(len(x[0]) for x in held):
            yield _sent(model, level, held, per_shard)

    uri = model.uri

    def merge(group: pa.Table) -> pa.Table:
        """A shard's n-grams with their counts, written as they are; what its first and last parent have of it."""
        no = group.column("shard")[0].as_py()
        parent, symbol, n, low = [], [], [], []
        for p, s, c, x in zip(*(group.column(k).to_pylist() for k in ("p", "s", "n", "low")), strict=True):
            low.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8))
            many = len(low[-1])
            parent.append(np.cumsum(_unplanes(p, many)))
            symbol.append(_unplanes(s, many))
            n.append(_unplanes(c, many))
        parent, symbol, n, low = (np.concatenate(x) for x in (parent, symbol, n, low))
        order, fresh = _pairs(parent, symbol)
        first = np.flatnonzero(fresh)
        n, one = np.add.reduceat(n[order], first), order[first]
        parent, symbol, low = parent[one], symbol[one], low[one]
        blobs = {"parent": _planes(np.diff(parent, prepend=0)), "symbol": _planes(symbol), "n": _planes(n), "low": low.tobytes()}
        Files(uri).put(f"counts{level}-{no}", {k: np.frombuffer(v, np.uint8) for k, v in blobs.items()})
        ends = [parent == parent[0], parent == parent[-1]]
        numbers = {"shard": no, "nodes": len(n), "total": n.sum(), "ones": (n == 1).sum(), "twos": (n == 2).sum(), "p0": parent[0], "p1": parent[-1], "s0": symbol[0]}
        numbers |= {"k0": ends[0].sum(), "t0": n[ends[0]].sum(), "k1": ends[1].sum(), "t1": n[ends[1]].sum()}
        return pa.table({k: pa.array([int(v)], pa.int64()) for k, v in numbers.items()})

    def index(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Where shards begin, and what their first and last parents have in all shards together."""
        lone = cols["p0"] == cols["p1"]
        parent = np.stack([cols["p0"], cols["p1"]], 1).reshape(-1)
        kinds = np.stack([cols["k0"], np.where(lone, 0, cols["k1"])], 1).reshape(-1)
        total = np.stack([cols["t0"], np.where(lone, 0, cols["t1"])], 1).reshape(-1)
        _, first, of = np.unique(parent, return_index=True, return_inverse=True)
        so_far = np.cumsum(kinds) - kinds
        lead = (so_far - so_far[first][of])[::2]
        all_kinds, all_total = np.bincount(of, weights=kinds).astype(np.int64)[of], np.bincount(of, weights=total).astype(np.int64)[of]
        out = {"shard": cols["shard"], "parent": cols["p0"], "symbol": np.where(lead > 0, cols["s0"], -1), "lead": lead}
        out |= {"first": np.concatenate([[0], np.cumsum(cols["nodes"])]), "cum": np.concatenate([[0], np.cumsum(cols["total"])])}
        return out | {"kinds_first": all_kinds[::2], "total_first": all_total[::2], "kinds_last": all_kinds[1::2], "total_last": all_total[1::2]}

    made = rows.mapInArrow(count, "shard bigint, p binary, s binary, n binary, low binary")
    fields = ("shard", "nodes", "total", "ones", "twos", "p0", "p1", "s0", "k0", "t0", "k1", "t1")
    parts = stored(made.groupBy("shard").applyInArrow(merge, ", ".join(f"{x} bigint" for x in fields)), "shards")
    done = _written(model, level, parts, index)
    model.nodes[level], model.discount[level] = done["nodes"], _discount(done["ones"], done["twos"])
    d = model.discount[level]

    def weigh(no: int) -> int:
        ix = model.index(level)
        k = int(np.searchsorted(ix["shard"], no))
        a = Files(uri).get(f"counts{level}-{no}")
        low = a["low"]
        parent, symbol, n = (_unplanes(a[x].tobytes(), len(low)) for x in ("parent", "symbol", "n"))
        parent = np.cumsum(parent) - ix["parent"][k]
        ptr = np.searchsorted(parent, np.arange(int(parent[-1]) + 2))
        full = np.diff(ptr) > 0
        kinds, total = np.diff(ptr)[full], np.add.reduceat(n, ptr[:-1][full])
        kinds[0], total[0] = ix["kinds_first"][k], ix["total_first"][k]
        kinds[-1], total[-1] = ix["kinds_last"][k], ix["total_last"][k]
        share = d * kinds / total
        of = np.repeat(np.arange(len(kinds)), np.diff(ptr)[full])
        prob = (n - d) / total[of] + share[of] * 10 ** model.value(low)
        back = np.zeros(len(full), np.uint8)
        back[full] = model.quantise(np.log10(share))
        # Each range goes on where the one before it ended, so that the whole shard rises.
        last = symbol[ptr[1:][full] - 1] + 1
        rise = symbol + (np.cumsum(last) - last)[of]
        arrays = _named("ptr", EliasFano.build(ptr).arrays()) | _named("sym", EliasFano.build(rise).arrays()) | {"prob": model.quantise(np.log10(prob)), "back": back}
        if level == 2:
            arrays |= _named("cum", EliasFano.build(np.concatenate([[0], np.cumsum(n)])).arrays())
        Files(uri).put(f"level{level}-{no}", arrays)
        return len(n)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([weigh(no) for no in batch.column("shard").to_pylist()], pa.int64())], names=["nodes"])

    shards = max(1, -(-model.tokens // per_shard))
    weighed = parts.select("shard").repartition(min(shards, 10_000), "shard").mapInArrow(finish, "nodes bigint").agg(F.sum("nodes").alias("n")).first()["n"] or 0
    if weighed != model.nodes[level]:
        raise RuntimeError(f"level {level}: {weighed} of {model.nodes[level]} nodes were weighed")


def fit(training: DataFrame, text_col: str = "text") -> Model:
    """Trigram model of all words of all rows of training; null texts are empty."""
    rows = training.select(F.col(text_col).cast("string").alias("text"))
    n = rows.count()
    model = Model(fresh_path(training.sparkSession, "ngrams"), word_bits=max(0, (n // 4096)).bit_length())
    _vocabulary(rows, model)
    _level(rows, model, 2)
    _level(rows, model, 3)
    return model


# ---------------------------------------------------------------- asking


def token_scores(model: Model, col: pa.Array) -> tuple[Looked, np.ndarray]:
    """log10 probability of every token after the two before it."""
    got = _look(model, col, 3)
    known = got.word >= 0
    # Not seen after the word before: that word's back-off weight and the word's own probability.
    low = np.where(got.node2 >= 0, got.prob2, got.back2 + model.unigram(got.count))
    rank = np.where((got.node2 >= 0) & known, got.rank2, -1)
    node3, _, prob3, back3, _ = _by_distinct(3, model, _before(got.node2, got), rank)
    return got, np.where(node3 >= 0, prob3, back3 + low)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are the row's words (A-Z lower-cased, parted by ASCII white space) and an end. base_score: add-one unigrams.
    Null and empty texts are the end alone. A model of no rows gives every text log10 probability 0. Ids are cast to
    bigint; repeated rows are scored each; an empty table gives an empty result, and further columns are not read.
    """
    tokens, vocabulary = model.tokens, model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            got, lp = token_scores(model, part.column("text"))
            rows = part.num_rows
            base = np.log10((got.count + 1) / (tokens + vocabulary + 1))
            total = lambda x: np.bincount(got.row, weights=x, minlength=rows)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(got.at)), pa.array(total(got.count > 0).astype(np.int64)), pa.array(np.full(rows, tokens, np.int64)), pa.array(total(base)), pa.array(total(lp))],
                names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
