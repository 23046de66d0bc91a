"""Language of every word span: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters. Its score under a language is the summed log probability of its character 1- to 3-grams and
of the word itself, each hashed into a fixed table. Going from one language to another between two words costs
`penalty`. Languages that training never saw in a word's script are no candidates for it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import mix
from chronolith.shared import stored

GRAM_BUCKETS, WORD_BUCKETS = 1 << 16, 1 << 16
#: Labelled rows of each language that the scores are fitted on, at most (a hashed sample).
SAMPLE_PER_LANGUAGE = 3000
PENALTY = 8.0
SLICE_CHARS = 1 << 20
#: Fixed ranges of code points by script; a letter outside of them is of script 0.
SCRIPTS = (
    (1, 0x0041, 0x024F), (1, 0x1E00, 0x1EFF), (2, 0x0370, 0x03FF), (2, 0x1F00, 0x1FFF), (3, 0x0400, 0x052F), (4, 0x0530, 0x058F),
    (5, 0x0590, 0x05FF), (6, 0x0600, 0x077F), (7, 0x0900, 0x097F), (8, 0x0980, 0x09FF), (9, 0x0E00, 0x0E7F), (10, 0x1100, 0x11FF),
    (10, 0xAC00, 0xD7AF), (11, 0x3040, 0x30FF), (12, 0x3400, 0x9FFF), (13, 0x10A0, 0x10FF),
)
N_SCRIPTS = 14

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Per code point of the first plane and the two after it: 0 for no letter, else 1 + script."""
    if "letters" not in _tables:
        n = 0x32400
        t = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(n)), bool, n).astype(np.uint8)
        script = np.zeros(n, np.uint8)
        for s, a, b in SCRIPTS:
            script[a : b + 1] = s
        _tables["letters"] = np.where(t > 0, 1 + script, 0).astype(np.uint8)
    return _tables["letters"]


@dataclass
class Words:
    """Words of a slice of rows: code points around them, and where each begins, ends and belongs."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    script: np.ndarray
    gram: list[np.ndarray] = field(default_factory=list)
    whole: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def cut_words(texts: list[str]) -> Words:
    joined = "\n".join(texts).lower()
    # Lower-casing can change lengths, so rows are found again by their line of the joined text, texts first freed of line ends.
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    kind = table[np.minimum(code, len(table) - 1)]
    letter = kind > 0
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(np.flatnonzero(code == 10), start)
    masked = np.where(letter, code, 0).astype(np.uint64)
    made = Words(masked, start, end, row, kind[start] - 1 if len(start) else np.zeros(0, np.uint8))
    if len(start):
        with np.errstate(over="ignore"):
            left, right = np.concatenate([[np.uint64(0)], masked[:-1]]), np.concatenate([masked[1:], [np.uint64(0)]])
            for k, h in enumerate((masked, masked + (left << np.uint64(21)), masked + (left << np.uint64(21)) + (right << np.uint64(42)))):
                made.gram.append((mix(h + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) & (GRAM_BUCKETS - 1))
            weight = np.concatenate([[np.uint64(0)], np.cumsum(mix(masked * np.uint64(0x100000001B3) + _place(len(masked), start, letter)))])
            made.whole = (mix(weight[end] - weight[start]) >> np.uint64(48)).astype(np.int64) & (WORD_BUCKETS - 1)
    return made


def _place(n: int, start: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Distance of each letter from its word's start, so that a word's hash minds the order."""
    at = np.zeros(n, np.int64)
    at[start] = start
    np.maximum.accumulate(at, out=at)
    return ((np.arange(n) - at) * letter).astype(np.uint64) << np.uint64(32)


@dataclass
class Model:
    """Log probabilities by hash bucket (float32 [buckets, languages]) and the scripts each language was seen in."""

    langs: list[str]
    gram: np.ndarray
    word: np.ndarray
    prior: np.ndarray
    allowed: np.ndarray  # bool [scripts, languages]

    def scores(self, w: Words) -> np.ndarray:
        """float32 [words, languages]; a language that is no candidate for the word's script scores far below."""
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        edges = np.stack([w.start, w.end], 1).reshape(-1)
        total = self.word[w.whole].copy()
        for g in w.gram:
            per = self.gram[g]
            per[w.code == 0] = 0
            pad = np.concatenate([per, np.zeros((1, per.shape[1]), np.float32)])
            total += np.add.reduceat(pad, edges, axis=0)[::2]
        open_ = self.allowed[w.script]
        return np.where(open_ | ~open_.any(1, keepdims=True), total, np.float32(-1e6))


def viterbi(scores: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; rows are sequences, walked side by side, long and short ones in batches of their own."""
    n, k = scores.shape
    best = np.zeros(n, np.int16)
    if n == 0 or k <= 1:
        return best
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), 128):
        own = order[a : a + 128]
        at, size = first[own], length[own]
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # sequences that reach each step
        d = scores[at].astype(np.float64)
        back = np.zeros((steps, len(own), k), np.int8 if k < 127 else np.int16)
        stay = np.arange(k, dtype=back.dtype)
        for t in range(1, steps):
            m = live[t]
            prev = d[:m]
            top = prev.argmax(1)
            jump = prev[np.arange(m), top] - penalty
            switch = jump[:, None] > prev
            back[t, :m] = np.where(switch, top[:, None], stay)
            d[:m] = np.where(switch, jump[:, None], prev) + scores[at[:m] + t]
        state = d.argmax(1)
        for t in range(steps - 1, -1, -1):
            m = live[t]
            best[at[:m] + t] = state[:m]
            if t:
                state[:m] = back[t, np.arange(m), state[:m]]
    return best


def _batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    a, size = 0, 0
    for k, t in enumerate(texts):
        if k > a and size + len(t) > SLICE_CHARS:
            yield a, texts[a:k]
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield a, texts[a:]


def _clean(texts: list[str | None]) -> list[str]:
    return [(t or "").replace("\n", " ") for t in texts]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Scores from rows with a language, from at most about `sample` of each, picked by hash of id and text.

    The hashed tables have a fixed size, whatever the corpus.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((GRAM_BUCKETS, 0), np.float32), np.zeros((WORD_BUCKETS, 0), np.float32), np.zeros(0), np.zeros((N_SCRIPTS + 1, 0), bool))
    part = F.lit(0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1 << 20, int((1 << 20) * sample / n) + 1))).otherwise(part)
    picked = rows.filter(F.pmod(F.xxhash64("id", "text", F.lit(23)), F.lit(1 << 20)) < part)  # rows of one id, or of none, by themselves
    number = {lang: k for k, lang in enumerate(langs)}
    width = GRAM_BUCKETS + WORD_BUCKETS + N_SCRIPTS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(langs), width), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, texts in _batches(_clean(batch.column("text").to_pylist())):
                w = cut_words(texts)
                if not len(w.start):
                    continue
                of_word = lang[a + w.row]
                of_char = np.repeat(of_word, w.end - w.start)
                at = w.code > 0
                for g in w.gram:
                    held += np.bincount(of_char * width + g[at], minlength=held.size).reshape(held.shape)
                held += np.bincount(of_word * width + GRAM_BUCKETS + w.whole, minlength=held.size).reshape(held.shape)
                held += np.bincount(of_word * width + GRAM_BUCKETS + WORD_BUCKETS + w.script, minlength=held.size).reshape(held.shape)
        k, f = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(held[k, f])], names=["k", "f", "n"])

    table = stored(picked.mapInArrow(run, "k int, f int, n bigint").groupBy("k", "f").agg(F.sum("n").alias("n")), "langid").toArrow()
    total = np.zeros((len(langs), width))
    total[np.asarray(table["k"]), np.asarray(table["f"])] = np.asarray(table["n"])
    grams, whole, scripts = total[:, :GRAM_BUCKETS], total[:, GRAM_BUCKETS : GRAM_BUCKETS + WORD_BUCKETS], total[:, GRAM_BUCKETS + WORD_BUCKETS :]

    def logs(c: np.ndarray, add: float) -> np.ndarray:
        return np.ascontiguousarray(np.log((c + add) / (c.sum(1, keepdims=True) + add * c.shape[1])).T.astype(np.float32))

    prior = np.array([counts[x] for x in langs], float)
    allowed = (scripts > 0.001 * np.maximum(scripts.sum(1, keepdims=True), 1)).T
    return Model(langs, logs(grams, 0.5), logs(whole, 0.1), prior / prior.sum(), allowed)


def label_spans(model: Model, texts: list[str | None], penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[str, int]]]]:
    """(language, share of letters, [(language, letters) of each span]) of every text; "und" where it has no letter."""
    out: list[tuple[str, float, list[tuple[str, int]]]] = []
    for _, part in _batches(_clean(texts)):
        w = cut_words(part)
        best = viterbi(model.scores(w), w.row, penalty)
        size = w.end - w.start
        k = max(1, len(model.langs))
        share = np.bincount(w.row * k + best, weights=size, minlength=len(part) * k).reshape(len(part), k)
        new = np.flatnonzero(np.concatenate([[True], (w.row[1:] != w.row[:-1]) | (best[1:] != best[:-1])])) if len(size) else np.zeros(0, int)
        span = np.add.reduceat(size, new) if len(new) else np.zeros(0, int)
        at = np.searchsorted(w.row[new], np.arange(len(part) + 1)) if len(new) else np.zeros(len(part) + 1, int)
        for r in range(len(part)):
            total = share[r].sum()
            if not total or not model.langs:
                out.append(("und", 0.0, []))
                continue
            top = int(share[r].argmax())
            out.append((model.langs[top], float(share[r, top] / total), [(model.langs[best[new[j]]], int(span[j])) for j in range(at[r], at[r + 1])]))
    return out


def predict(text: Column, model: Model, penalty: float = PENALTY, spans: bool = False) -> Column:
    """Struct (lang, score[, spans]) of a text column."""
    kind = "struct<lang:string,score:double,spans:array<struct<lang:string,letters:bigint>>>" if spans else "struct<lang:string,score:double>"

    @F.arrow_udf(kind)
    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in col:
            found = label_spans(model, chunk.to_pylist(), penalty)
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            names = ["lang", "score"]
            if spans:
                cols.append(pa.array([[{"lang": a, "letters": b} for a, b in x[2]] for x in found], pa.list_(pa.struct([("lang", pa.string()), ("letters", pa.int64())]))))
                names.append("spans")
            yield pa.StructArray.from_arrays(cols, names=names)

    return run(text)


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """id, lang_pred, score (share of letters in spans of lang_pred) for every row of docs, and with `spans` the spans.

    "und" with score 0 where the text is null or has no letter, or where training has no labelled row. Rows are
    independent of each other: repeated rows and ids get equal answers, an empty table an empty result.
    """
    model = fit(training, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col), predict(F.col(text_col), model, penalty, spans).alias("p"))
    return out.select(id_col, F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), *([F.col("p.spans").alias("spans")] if spans else []))
