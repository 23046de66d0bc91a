"""Near duplicates by SetSketch registers, banded, estimated by likelihood, then verified on whole shingle sets.

A register holds floor(1 - log_b x) for the smallest point x that any shingle sends to it; the points of one shingle are
a Poisson process of rate m dealt over the m registers, so each register's x is exponential with the set's size as its
rate. Registers of a union are the larger ones of both (mergeable), and they agree more often the larger the Jaccard
similarity is (locality-sensitive). Points beyond a set's reach are never generated: a set of any size costs about
m * ln(m) points.

Rows of equal sets are one *node* from the start. Links are decided by sizes of true intersections of 128-bit shingles.
No pairs of a group are listed: in each band bucket every member meets one leader, the most central one, and components
form. What is left are buckets whose members are still in different components. Their members are dealt in blocks, and a
task compares the registers of two blocks; rows of the bucket's largest component meet only rows of other components.
Where few pairs of a block pair are likely, these are verified one by one; where many are, the two blocks are compared
as matrices and only links that join components come back. So a group of copies costs about one comparison per copy.

Two chances remain, both parameters: a pair just at the threshold shares no band with chance `miss`, and its estimate
lies more than `margin` deviations below the threshold. README holds the measured recall.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import mix, slices, words
from chronolith.llm.components import components
from chronolith.shared import arrow_batches, fresh_name, scratch, small, stored

REGISTERS = 192
#: Chance that a pair just at the threshold shares no band, at most.
MISS = 1e-6
BASE, TOP = 1.1, 255
#: The register of x = 1 (rate 1); up to sets of about 10**9 and down to x = e**3 fit one byte.
ZERO = 40
#: Rows that a task compares with as many others.
BLOCK_ROWS = 128
#: Likely pairs for each row of a block up to which they are verified one by one.
SPARSE = 4
#: Bytes of a batch of rows that carry whole sets.
BATCH_BYTES = 8 << 20
#: Standard deviations below the threshold at which an estimate still leads to a comparison.
MARGIN = 5.0

_LOG = float(np.log(BASE))


def shingle_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 128-bit shingle hashes (uint64[n, 2]) of every row, and offsets.

    Fewer words than width: all of them are one shingle.
    """
    h, at = words(col)
    n = np.diff(at)
    rows = len(n)
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    row = np.repeat(np.arange(rows), count)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    short = (n < width)[row]
    lanes = []
    for lane in range(2):
        with np.errstate(over="ignore"):
            acc = np.full(len(row), lane, np.uint64)
            for k in range(width):
                inside = begin + k < at[row + 1]
                acc = mix(acc + np.where(inside, h[np.minimum(begin + k, max(len(h) - 1, 0)), lane] if len(h) else 0, np.uint64(k + 1)))
            lanes.append(np.where(short, mix(acc ^ np.uint64(0xABCDEF)), acc))
    order = np.lexsort((lanes[0], row))
    a, b, row = lanes[0][order], lanes[1][order], row[order]
    tied = np.zeros(len(a), bool)
    tied[1:] = (a[1:] == a[:-1]) & (row[1:] == row[:-1])
    if (b[1:] != b[:-1])[tied[1:]].any():  # the second lane decides
        order = np.lexsort((b, a, row))
        a, b, row = a[order], b[order], row[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (row[1:] != row[:-1])
    row = row[fresh]
    return np.stack([a[fresh], b[fresh]], axis=1), np.searchsorted(row, np.arange(rows + 1))


def shared_items(a: np.ndarray, b: np.ndarray) -> int:
    """How many 128-bit shingles two sorted sets have in common."""
    both = np.concatenate([a, b])
    order = np.argsort(both[:, 0], kind="stable")
    first, second = both[order, 0], both[order, 1]
    tied = first[1:] == first[:-1]
    same = tied & (second[1:] == second[:-1])
    if (tied & ~same).any():
        order = np.lexsort((both[:, 1], both[:, 0]))
        first, second = both[order, 0], both[order, 1]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    return int(same.sum())


def registers(items: np.ndarray, at: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """uint8[rows, m]; a row without items has zeros."""
    n = np.diff(at)
    rows = len(n)
    low = np.full(rows * m, np.inf)
    todo = n > 0
    reach = np.where(todo, (np.log(m) + 3.0) / np.maximum(n, 1), 0.0)
    while todo.any():
        row = np.repeat(np.arange(rows), np.where(todo, n, 0))
        item = items[np.repeat(todo, n)]
        x, state, step = np.zeros(len(item)), mix(item ^ np.uint64(0x51AB)), 0
        while len(item):
            step += 1
            with np.errstate(over="ignore"):
                state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            u = ((state >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0**-44
            x = x - np.log(u) / m
            live = x <= reach[row]
            item, row, state, x = item[live], row[live], state[live], x[live]
            np.minimum.at(low, row * m + (state & np.uint64(0xFFFFF)).astype(np.int64) % m, x)
        # A row some register of which nothing has reached is looked at again, further.
        todo &= ~np.isfinite(low.reshape(rows, m)).all(axis=1)
        low.reshape(rows, m)[todo] = np.inf
        reach = np.where(todo, reach * 2.0, 0.0)
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(low.reshape(rows, m)) / _LOG) + ZERO
    return np.clip(np.nan_to_num(k, nan=0.0, neginf=0.0), 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1.0) / BASE) / _LOG


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair that makes the observed register order likeliest, for known set sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    lo, hi = np.zeros(len(na)), np.minimum(u / v, v / u)

    def value(j: np.ndarray) -> np.ndarray:
        p, q = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-12)
        return up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = value(c) >= value(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def per_band(share: float, m: int = REGISTERS, miss: float = MISS) -> int:
    """The most registers a band may have for pairs of similarity `share` to be missed with chance `miss` at most."""
    fits = [r for r in range(1, m) if (1 - share**r) ** (m // r) <= miss]
    return max(fits)


# ---------------------------------------------------------------- stages


def _band_keys(regs: np.ndarray, per_band: int) -> np.ndarray:
    rows, m = regs.shape
    key = np.zeros((rows, m // per_band), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(per_band):
            key = mix(key * np.uint64(31) + regs[:, k::per_band][:, : m // per_band].astype(np.uint64) + np.uint64(1))
        return mix(key + np.arange(m // per_band, dtype=np.uint64)[None, :])


def sketch(rows: DataFrame, width: int, m: int = REGISTERS) -> DataFrame:
    """id, mark, n, digest (of the set, 128 bits), regs of every row (id, mark, text)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            items, at = shingle_sets(part.column("text"), width)
            regs = registers(items[:, 0], at, m)
            digests = [hashlib.blake2b(items[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("mark"), pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["id", "mark", "n", "digest", "regs"],
            )

    return rows.mapInArrow(run, f"id {id_type}, mark binary, n bigint, digest binary, regs binary")


def _stack(col: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8) for x in col.to_pylist()])


def band_rows(nodes: DataFrame, width: int) -> DataFrame:
    """key, node, n: one row per band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _band_keys(_stack(batch.column("regs")), width)
            each = keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("node")), each)), pa.array(np.repeat(np.asarray(batch.column("n")), each))],
                names=["key", "node", "n"],
            )

    return nodes.select("node", "n", "regs").mapInArrow(run, "key bigint, node bigint, n bigint")


def _least(share: float, m: int, margin: float) -> float:
    """The smallest estimate that does not rule out `share`."""
    return share - margin * (share * (1 - share) / m) ** 0.5


def _likely(pairs: DataFrame, nodes: DataFrame, share: float, margin: float) -> DataFrame:
    """The pairs whose estimated similarity does not rule out `share`."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    joined = pairs.select("a", "b").join(a, "a").join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = _stack(batch.column("ra")), _stack(batch.column("rb"))
            est = estimate(ra, rb, np.asarray(batch.column("na"), float), np.asarray(batch.column("nb"), float))
            yield batch.select(["a", "b"]).filter(pa.array(est >= _least(share, ra.shape[1], margin)))

    return joined.mapInArrow(run, "a bigint, b bigint")


def node_sets(need: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """node, items of the nodes in need(node, mark), of which there are few or a stored table: the shingles of one text of
    each, 16 bytes apiece."""
    marked = texts.join(need, "mark").groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            items, at = shingle_sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([items[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "items"])

    return marked.mapInArrow(run, "node bigint, items binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs with 100 * |A and B| >= percent * |A or B|, by whole sets."""
    a, b = sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ia"), batch.column("ib"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8").reshape(-1, 2) for v in (x, y))
                both = shared_items(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a bigint, b bigint")


def _fits(n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs have sizes that allow the threshold."""
    return 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])


def _overlaps(items: np.ndarray, at: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """Sizes of all intersections of the rows' sets, by products of 0/1 matrices over a chunk of shingles at a time."""
    k = len(at) - 1
    row = np.repeat(np.arange(k), np.diff(at))
    order = np.lexsort((items[:, 1], items[:, 0]))
    a, b, row = items[order, 0], items[order, 1], row[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    col = np.cumsum(fresh) - 1
    many = np.bincount(col)
    own = many[col] > 1  # a shingle of one row is in no intersection
    row, col = row[own], (np.cumsum(many > 1) - 1)[col[own]]
    total = np.zeros((k, k), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, chunk):
        part = slice(*np.searchsorted(col, [lo, lo + chunk]))
        m = np.zeros((k, chunk), np.float32)
        m[row[part], col[part] - lo] = 1
        total += m @ m.T
    return total


def _dealt(met: DataFrame, label: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, lo, hi, own, node, comp, n, regs: members of buckets of several components, in pairs of blocks.

    The bucket's largest component is dealt into its own blocks, which meet the blocks of the others and not each other.
    """
    named = met.join(label, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    each = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = each.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("kinds")).filter("kinds > 1")
    blocks = stored(
        mixed.select("key", F.col("top.comp").alias("major"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK_ROWS).alias("minors"), F.ceil(F.col("top.c") / BLOCK_ROWS).alias("majors")), "mixed"
    )
    rows = named.join(blocks, "key").withColumn("is_major", F.col("comp") == F.col("major"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))) + F.when(F.col("is_major"), F.col("minors")).otherwise(F.lit(0))
    last = F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp")
    return rows.join(nodes.select("node", "n", "regs"), "node")


def _candidates(dealt: DataFrame, percent: int, band: int, margin: float, sparse: int) -> DataFrame:
    """a, b of likely pairs of different components; of block pairs with many of them, the members instead (key not null, b null)."""
    share = percent / 100

    def compare(key: int, lo: int, hi: int, group: pa.Table) -> list[tuple]:
        node, comp, own, n = (np.asarray(group.column(c)) for c in ("node", "comp", "own", "n"))
        maybe = (comp[:, None] != comp[None, :]) & _fits(n, percent)
        if lo != hi:
            maybe &= own[:, None] != own[None, :]
        maybe[np.tril_indices(len(node))] = False
        i, j = np.nonzero(maybe)
        if not len(i):
            return []
        regs = _stack(group.column("regs").combine_chunks())
        keys = _band_keys(regs, band)
        met = keys[i] == keys[j]
        first = keys[i, met.argmax(1)].view(np.int64) == key  # a pair counts in its first bucket only
        i, j = i[first], j[first]
        est = estimate(regs[i], regs[j], n[i].astype(float), n[j].astype(float)) if len(i) else np.zeros(0)
        good = est >= _least(share, regs.shape[1], margin)
        i, j = i[good], j[good]
        if len(i) <= sparse * len(node):
            return [(int(min(node[x], node[y])), int(max(node[x], node[y])), None, lo, hi, None) for x, y in zip(i, j, strict=True)]
        return [(int(node[x]), None, key, lo, hi, int(comp[x])) for x in np.union1d(i, j)]

    schema = "a bigint, b bigint, key bigint, lo bigint, hi bigint, comp bigint"
    return _grouped(dealt, ["key", "lo", "hi"], compare, schema)


def _grouped(rows: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """work(*key, rows of the key) for every key; keys are sorted inside a task, so small ones cost no call to Spark each."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = pa.schema([(name, pa.int64()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None

        def done() -> list[tuple]:
            return work(*key, pa.concat_tables(held))

        out: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in by])
            cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(int(x) for x in cols[:, a])
                if key is not None and here != key:
                    out += done()
                    held = []
                key = here
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=types)
                out = []
        if key is not None:
            out += done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=types)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _dense_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between members (node, comp) of one (key, lo, hi), enough of them to join what can be joined."""

    def compare(key: int, lo: int, hi: int, group: pa.Table) -> list[tuple]:
        node, comp = (np.asarray(group.column(c)) for c in ("node", "comp"))
        raw = group.column("items").to_pylist()
        at = np.concatenate([[0], np.cumsum([len(x) // 16 for x in raw])])
        n = np.diff(at)
        shared = _overlaps(np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2), at)
        linked = (comp[:, None] != comp[None, :]) & _fits(n, percent) & (100 * shared >= percent * (n[:, None] + n[None, :] - shared))
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            a, b = top(int(comp[i])), top(int(comp[j]))
            if a != b:  # one link joins two components
                up[max(a, b)] = min(a, b)
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return out

    return _grouped(members.join(sets, "node"), ["key", "lo", "hi"], compare, "a bigint, b bigint")


def _sets(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """node_sets of the ends of pairs (a, b), b being null at times."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).filter("node is not null").distinct()
    need = small(ids.join(nodes.select("node", "mark"), "node"), 2 * pairs.count())
    return stored(node_sets(need, texts, width), "items")


def classes(rows: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, margin: float = MARGIN, sparse: int = SPARSE) -> tuple[DataFrame, DataFrame]:
    """For rows (id, text): their id, n and digest, and for every digest the least id of its component."""
    with arrow_batches(rows.sparkSession, BATCH_BYTES), scratch(rows.sparkSession):
        return _classes(rows, width, percent, miss, margin, sparse)


def _classes(rows: DataFrame, width: int, percent: int, miss: float, margin: float, sparse: int) -> tuple[DataFrame, DataFrame]:
    texts = rows.select("id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("mark"), F.col("text").cast("string").alias("text"))
    all_ = stored(sketch(texts, width), "sketches", keep=True)
    sets = all_.filter("n > 0").groupBy("digest").agg(F.min("id").alias("low"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = stored(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    band = per_band(percent / 100, REGISTERS, miss)
    bands = band_rows(nodes, band)
    sizes = bands.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    met = stored(bands.join(sizes, "key"), "buckets", n)
    # Of a bucket's members the one that meets most rows in all of its buckets is nearest to what they have in common.
    central = met.groupBy("node").agg(F.sum("c").alias("meets"))
    lead = stored(met.join(central, "node").groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("meets", -F.col("node"))).alias("l")).select("key", F.col("l.node").alias("lead"), F.col("l.n").alias("ln")), "leads", n)
    fits = (100 * F.least("n", "ln") >= percent * F.greatest("n", "ln")) & (F.col("node") != F.col("lead"))
    pairs = met.join(lead, "key").filter(fits).select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    likely = stored(_likely(pairs, nodes, percent / 100, margin), "pairs", n)
    links = stored(verify(likely, _sets(likely, nodes, texts, width), percent), "links", n)
    label = stored(components(links).withColumnRenamed("id", "node"), "labels")
    found = stored(_candidates(_dealt(met, label, nodes), percent, band, margin, sparse), "candidates", n)
    if not found.isEmpty():
        items = _sets(found.select("a", "b"), nodes, texts, width)
        more = verify(found.filter("b is not null").select("a", "b").distinct(), items, percent)
        dense = found.filter("b is null")
        if not dense.isEmpty():
            more = more.unionByName(_dense_links(dense.select("key", "lo", "hi", F.col("a").alias("node"), "comp"), items, percent))
        more = stored(more, "links", n)
        if not more.isEmpty():
            label = stored(components(links.unionByName(more)).withColumnRenamed("id", "node"), "labels")
    of = nodes.select("digest", "node", "low").join(label, "node", "left").select("digest", "low", F.coalesce("comp", "node").alias("comp"))
    # Stored, as a component's or a set's rows can be split among tasks only where the other side is a plain table.
    least = stored(of.groupBy("comp").agg(F.min("low").alias("least")), "least", n)
    return all_.select("id", "n", "digest"), stored(of.join(least, "comp").select("digest", "least"), "named", n, keep=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, **how) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of docs.

    Words: A-Z lower-cased, parted by ASCII white space; the set of a row: its distinct `width`-word shingles, or all its
    words as one where they are fewer. Rows link where 100 * |A and B| >= percent * |A or B|; component_id is the
    smallest id reachable, and kept says that it is the row's own. Null and empty texts have empty sets, link with nothing
    and are kept. Every row counts by its own text, also where ids repeat: such rows may be in several components. Null ids
    never are a component's smallest; in a component without any id, component_id is null and all rows are kept. Ids may be
    of any ordered type. An empty table gives an empty result; further columns are not read. how: miss, margin, sparse.
    """
    rows, of = classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), width, percent, **how)
    out = rows.join(of, "digest", "left")
    comp = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, **how) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id, of rows that repeat it any one.

    Rows without an id come last; rows without words are in no group and stay. All columns are kept, whatever their names.
    """
    row = fresh_name("row", docs.columns)
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{row}`").alias("row"))
    with scratch(docs.sparkSession):
        rows, of = classes(keyed.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")), width, percent, **how)
        named = rows.filter("n > 0").join(of, "digest")
        gone = stored(named.filter(F.col("id") != F.col("least")).select(F.col("id.row").alias(row)), "gone", keep=True)
    return keyed.join(small(gone), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
