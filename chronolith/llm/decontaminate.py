"""Passages of benchmark items in documents, found by an Aho-Corasick automaton over the items' word windows.

Texts are normalised to their words with one blank around each, windows likewise; one scan of a normalised text finds all
windows that occur in it, and the places found are mapped back to words and code points of the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import _TO_LOWER, ascii_lower, slices, string_buffers
from chronolith.shared import scratch, stored

#: A word is a run of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows and bytes of windows that one automaton holds; a worker needs about 4 kB a window. More are scanned for in turn.
AUTOMATON_WINDOWS, AUTOMATON_BYTES = 50_000, 4 << 20
SLICE_BYTES = 1 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item, words), distinct: each run of `width` words of an item, joined by blanks; an item of fewer words is one window."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    firsts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return rows.select("item", F.explode(F.transform(firsts, lambda i: F.array_join(F.slice("w", i, width), " "))).alias("words")).distinct()


class Normalised:
    """The words of a string column, lower-cased, each with one blank before it; a row ends in a blank and a line end."""

    def __init__(self, col: pa.Array):
        raw, offsets = string_buffers(col)
        low = _TO_LOWER[raw]
        inside = _IS_WORD[low]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[1:-1][offsets[1:-1] < len(raw)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        row = np.repeat(np.arange(len(col)), np.diff(offsets))
        at = np.flatnonzero(inside)
        place = np.arange(len(at)) + np.cumsum(first)[at] + 2 * row[at]
        out = np.full(len(at) + int(first.sum()) + 2 * len(col), 0x20, np.uint8)
        out[place] = low[at]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)  # word numbers at which rows begin, and their end
        row_ends = np.cumsum(np.bincount(row[at], minlength=len(col)) + np.diff(self.rows) + 2) - 1
        out[row_ends] = 0x0A
        self.text = out.tobytes().decode("latin-1")  # one character per byte
        self.word_ends = place[np.flatnonzero(last[at])]  # place in .text of each word's last byte
        self.raw, self.offsets = raw, offsets

    def code_points(self, row: int, places: np.ndarray) -> np.ndarray:
        """Code points of the row's original text before the given bytes of the column."""
        begin, end = self.offsets[row], self.offsets[row + 1]
        before = np.concatenate([[0], np.cumsum((self.raw[begin:end] & 0xC0) != 0x80)])
        return before[places - begin]


_built: dict[str, tuple] = {}


def automaton(key: str, rows: list[tuple[str, list[str]]]) -> tuple:
    """The automaton of a part, built once per worker process; a value is the window's place in rows. Only the last is kept."""
    if key not in _built:
        import ahocorasick

        _built.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (words, _) in enumerate(rows):
            made.add_word(f" {words} ".encode().decode("latin-1"), k)
        if rows:
            made.make_automaton()
        _built[key] = made, np.array([words.count(" ") + 1 for words, _ in rows], np.int64)
    return _built[key]


SPANS = "array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>>"


def _scan(docs: DataFrame, part: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_sha, n_words, spans, items: what of one part's windows occurs in each row."""
    rows = [(r["words"], r["items"]) for r in part.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()]
    shared, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", SLICE_BYTES):
            known = shared.value
            found, size = automaton(key, known)
            text = Normalised(piece.column("text"))
            hits = np.array(list(found.iter(text.text)) if known else [], np.int64).reshape(-1, 2)
            last = np.searchsorted(text.word_ends, hits[:, 0] - 1)
            first = last - size[hits[:, 1]] + 1 if len(hits) else last
            cover = np.zeros(len(text.starts) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, last + 1, -1)
            hit = np.cumsum(cover)[:-1] > 0
            row_of = np.searchsorted(text.rows, first, "right") - 1
            begins = hit & ~np.concatenate([[False], hit[:-1]])
            begins[text.rows[:-1][text.rows[:-1] < len(hit)]] = hit[text.rows[:-1][text.rows[:-1] < len(hit)]]
            stops = hit & ~np.concatenate([hit[1:], [False]])
            stops[:-1] |= hit[:-1] & begins[1:]
            begin, stop = np.flatnonzero(begins), np.flatnonzero(stops)
            by_row: dict[int, set] = {}
            for r, w in np.unique(np.stack([row_of, hits[:, 1]]), axis=1).T.tolist():
                by_row.setdefault(r, set()).update(known[w][1])
            spans: list[list] = [[] for _ in range(piece.num_rows)]
            span_row = np.searchsorted(text.rows, begin, "right") - 1
            for r in np.unique(span_row).tolist():
                own = span_row == r
                a, b = begin[own], stop[own]
                starts, ends = text.code_points(r, text.starts[a]), text.code_points(r, text.ends[b])
                spans[r] = [dict(zip(("first_word", "last_word", "start", "end"), x, strict=True)) for x in zip(*((v - o).tolist() for v, o in ((a, text.rows[r]), (b, text.rows[r]), (starts, 0), (ends, 0))), strict=True)]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end")]))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("text_sha"), pa.array(np.diff(text.rows)), pa.array(spans, kind), pa.array([sorted(by_row.get(k, ())) for k in range(piece.num_rows)], pa.list_(pa.string()))],
                names=["id", "text_sha", "n_words", "spans", "items"],
            )

    text = F.col(text_col).cast("string")
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("text_sha"), text.alias("text")).mapInArrow(
        run, f"id {kind}, text_sha binary, n_words bigint, spans {SPANS}, items array<string>"
    )


def _joined(spans: Column) -> Column:
    """Spans of several scans, sorted, those that meet or touch as one."""

    def add(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        wider = F.struct(top["first_word"].alias("first_word"), F.greatest(top["last_word"], x["last_word"]).alias("last_word"), top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"))
        meets = (F.size(done) > 0) & (x["first_word"] <= F.try_element_at(done, F.lit(-1))["last_word"] + 1)
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, n_hit, spans, items.

    items: the ids, as strings in their order, of the items of which a window occurs. spans: what such windows cover, as numbers
    of the first and last word (from 0) and as code points [start, end) of the original text; neighbouring ones are one span.
    n_hit: words inside spans. Null and empty texts have no words. Items that share an id are one item, a null id counts as
    the empty string; without items, or with items without words, nothing is hit. Repeated rows are judged each. Further
    columns, whatever their names, are not read; an empty table gives an empty result.

    The items are cut by hash into parts that fit an automaton; every part costs a scan of the texts, and the common case is
    one part. Parts' findings meet by id and SHA-256 of the text.
    """
    with scratch(docs.sparkSession):
        pairs = stored(windows(items, item_col, "text", width), "windows", keep=True)
    seen = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-seen["n"] // AUTOMATON_WINDOWS), -(-seen["bytes"] // AUTOMATON_BYTES))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("words", "item"), F.lit(parts)))
    scans = [_scan(docs, dealt.filter(F.col("part") == k), id_col, text_col) for k in range(parts)]
    out = scans[0]
    if parts > 1:
        for more in scans[1:]:
            out = out.unionByName(more)
        spans, found = F.flatten(F.collect_list("spans")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
        out = out.groupBy("id", "text_sha").agg(F.first("n_words").alias("n_words"), _joined(spans).alias("spans"), found.alias("items"), (F.count("*") / parts).cast("int").alias("times"))
        out = out.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last_word"] - x["first_word"] + 1)
    return out.select(F.col("id").alias(id_col), "n_words", words.alias("n_hit"), "spans", "items")
