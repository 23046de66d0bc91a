"""Toxic text by a learned lexicon, misspellings included, weighed by its context.

Fitting: words and word beginnings of toxic training rows that occur there in more different contexts than chance allows
are lexicon terms; the shortest beginning that carries the evidence stands for its longer forms. Matching: a Levenshtein
automaton of the word (states: positions x edits) is walked down a trie of the lexicon, so a term is found in a word that
is one edit away, two for long terms, and in a word some letters of which are signs or digits. Scoring: a hit weighs the log ratio of its rates in toxic and clean training text, and in a
window that quotes or reports the share of it that such hits were worth in training; a logistic model of the summed weight and its density in the row makes the score.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.shared import arrow_batches, stored

WORD = re.compile(r"[^\W\d_]+")
#: Training rows of each class, at most (a hashed sample of the labelled rows).
SAMPLE_TOXIC, SAMPLE_CLEAN = 6000, 12000
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Terms shorter than this are matched as they are, or with two neighbours swapped; those of TWICE_FROM letters may be two edits
#: away. In a word with signs for letters, terms from MASKED_FROM letters on may be one edit away.
FUZZY_FROM, TWICE_FROM, MASKED_FROM, MASKED_MOST = 5, 8, 4, 24
WINDOW = 5
#: Texts whose words are matched together, and rows of a text whose candidates are counted together.
PART_CHARS, PART_ROWS = 1 << 19, 250
#: Bytes of a batch that fitting sends to Python.
FIT_BYTES = 4 << 20
#: Signs that stand for letters, and those of them that are no part of a word at its ends.
SIGNS, OUTER = "@$!*#|+%&€", "!*#|+%&€"
SIGN = re.compile(r"[@$!*#|+%&€\d]")
MASKED = re.compile(r"[@$!*#|+%&€\d][^\W\d_]")
#: Bytes of a batch that fitting sends to Python.
FIT_BYTES = 4 << 20
#: Signs that stand for letters, and those of them that are no part of a word at its ends.
SIGN, OUTER = re.compile(r"[@$!*#|+%&€\d]"), "!*#|+%&€"
#: A quoted or reported hit keeps this share of its weight, before training has shown what it is worth, and the hits of
#: training that outweigh this.
QUOTED, QUOTED_HITS = 0.3, 30
#: Signs that open or close a quotation, and words that report one.
QUOTES = "\"'«»“”„‟‘’‹›"
REPORTING = frozenset("said says wrote called quote quoted word term dit écrit mot sagte schrieb wort dijo escribió palabra".split())


# ---------------------------------------------------------------- automaton and trie


@dataclass
class Node:
    next: dict[str, "Node"] = field(default_factory=dict)
    term: str | None = None  # ends here
    stem: bool = False  # stands for every word that begins so


def build_trie(terms: dict[str, bool]) -> Node:
    """terms: term -> is it a beginning."""
    root = Node()
    for term, stem in terms.items():
        at = root
        for c in term:
            at = at.next.setdefault(c, Node())
        at.term, at.stem = term, stem
    return root


class Automaton:
    """Levenshtein automaton of one word, neighbours in swapped order counting as one edit.

    A state is the row of edit distances to the word's beginnings within `most` of the depth, capped at most + 1, with the row
    and the character before it, and the depth: a band of 2 * most + 1 numbers.
    """

    def __init__(self, word: str, most: int):
        self.word, self.most, self.cap = word, most, most + 1
        self.start = (tuple(k if 0 <= k <= len(word) else self.cap for k in range(-most, most + 1)), None, "", 0)

    def step(self, state: tuple, c: str) -> tuple:
        row, older, last, depth = state
        word, cap, width = self.word, self.cap, 2 * self.most
        out, left, j = [], cap, depth + 1 - self.most  # j: letters of the word
        for i in range(width + 1):
            v = cap
            if j == 0:
                v = min(depth + 1, cap)
            elif 0 < j <= len(word):
                w = word[j - 1]
                v = row[i] if w == c else row[i] + 1
                if left < v - 1:
                    v = left + 1
                if i < width and row[i + 1] < v - 1:
                    v = row[i + 1] + 1
                if older is not None and j > 1 and w == last and word[j - 2] == c and older[i] < v - 1:
                    v = older[i] + 1
                if v > cap:
                    v = cap
            out.append(v)
            left = v
            j += 1
        return tuple(out), row, c, depth + 1

    def edits(self, state: tuple, beginning: bool) -> int:
        """To the whole word, or to the nearest of its beginnings; more than most is most + 1."""
        row, _, _, depth = state
        if beginning:
            return min(row)
        at = len(self.word) - depth + self.most
        return row[at] if 0 <= at < len(row) else self.cap

    def alive(self, state: tuple) -> bool:
        return min(state[0]) <= self.most or (state[1] is not None and min(state[1]) < self.most)


def most_edits(letters: int, least: int = FUZZY_FROM) -> int:
    return 0 if letters < least else 1 if letters < TWICE_FROM else 2


def best_match(root: Node, word: str, most: int = 1, least: int = FUZZY_FROM) -> tuple[str, int] | None:
    """The lexicon term nearest to the word, and its edits: 0, or up to `most` and most_edits of the term's letters.

    A beginning matches a word that begins with it, or with a string so many edits away. Fewer edits win, then longer terms.
    """
    at, exact = root, None
    for k, c in enumerate(word):
        at = at.next.get(c)
        if at is None:
            break
        if at.term and (at.stem or k == len(word) - 1):
            exact = at.term
    if exact or len(word) < least - 1:
        return (exact, 0) if exact else None
    found: list[tuple[int, int, str]] = []
    auto = Automaton(word, most)
    stack = [(root, auto.start, 0)]
    while stack:
        node, state, depth = stack.pop()
        if node.term and (edits := auto.edits(state, node.stem)) <= min(most, most_edits(depth, least)):
            found.append((-edits, len(node.term), node.term))
        for c, below in node.next.items():
            after = auto.step(state, c)
            if auto.alive(after):
                stack.append((below, after, depth + 1))
    return (max(found)[2], -max(found)[0]) if found else None


class Matcher:
    """best_match behind a cheap test: a few edits leave a part of a term in place."""

    def __init__(self, terms: dict[str, bool], cache: int = 100_000):
        self.root, self.cache, self.limit = build_trie(terms), {}, cache
        self.long = {t: stem for t, stem in terms.items() if most_edits(len(t)) > 1}
        self.long_root, self.shortest = build_trie(self.long), min(map(len, self.long), default=0) - 2
        self.heads: dict[int, set[str]] = defaultdict(set)
        self.second: dict[int, set[str]] = defaultdict(set)
        self.inner: dict[tuple[int, int, int], set[str]] = defaultdict(set)  # by length, place, and how far off it may be
        self.swapped: dict[str, str] = {}
        for t in terms:
            cut = len(t) // 2 if len(t) >= FUZZY_FROM else len(t)
            self.heads[cut].add(t[:cut])
            if len(t) >= FUZZY_FROM:
                self.heads[cut].add(t[: cut - 1] + t[cut])  # the two halves' neighbours swapped
                self.second[len(t) - cut].add(t[cut:])
            else:
                self.swapped.update({v: t for k in range(len(t) - 1) if len(t) == 4 and (v := t[:k] + t[k + 1] + t[k] + t[k + 2 :]) not in terms})
            if len(t) >= TWICE_FROM:
                # Two edits leave one of three parts in place, but for swaps over their bounds: then a part whose last letter
                # is the next one's first.
                x, y = len(t) // 3, 2 * len(t) // 3
                for part, at, off in ((t[:x], 0, 0), (t[x:y], x, 2), (t[y:], y, 2), (t[: x - 1] + t[x], 0, 0), (t[x : y - 1] + t[y], x, 1)):
                    self.inner[len(part), at, off].add(part)
        # (length, first and last place, strings): a word has one of the strings there if it can match.
        self.near = [(k, 0, 1, xs) for k, xs in sorted(self.heads.items())]
        # The second half begins at k or k - 1 in its term, and here one place off at most.
        self.near += [(k, max(0, k - 2), k + 2, xs) for k, xs in sorted(self.second.items())]
        self.far = [(k, max(0, at - off), at + off + 1, xs) for (k, at, off), xs in sorted(self.inner.items())]
        # What begins these strings is looked for anywhere in a word first; two letters stand only at its beginning.
        strings = [x for _, _, _, xs in self.near + self.far for x in xs]
        self.pairs, self.threes = {x for x in strings if len(x) < 3}, {x[:3] for x in strings if len(x) > 2}
        self.letters = [(len(t), stem, Counter(t)) for t, stem in self.long.items()]
        self.stems = {t for t, stem in terms.items() if stem}

    @staticmethod
    def _holds(w: str, tests: list[tuple[int, int, int, set[str]]]) -> bool:
        for k, first, stop, strings in tests:
            for a in range(first, stop):
                if w[a : a + k] in strings:
                    return True
        return False

    def may(self, w: str) -> bool:
        return self._holds(w, self.near)

    def may_twice(self, w: str) -> bool:
        """Also, all but two letters of some term are among those of the word."""
        if len(w) < self.shortest or not self._holds(w, self.far):
            return False
        own = Counter(w)
        return any((stem or len(w) <= n + 2) and n - 2 <= len(w) and (letters - own).total() <= 2 for n, stem, letters in self.letters)

    def _found(self, w: str) -> tuple[str, int] | None:
        if SIGN.search(w):
            return best_match(self.root, w, 1, MASKED_FROM) or (best_match(self.long_root, w, 2) if self.long else None)
        some = w[:2] in self.pairs or not self.threes.isdisjoint([w[a : a + 3] for a in range(len(w) - 2)])
        got = best_match(self.root, w, 1) if some and self.may(w) else None
        if got is None and (term := self.swapped.get(w[:4])) and (len(w) == 4 or term in self.stems):
            return term, 1
        return got or (best_match(self.long_root, w, 2) if some and self.long and self.may_twice(w) else None)

    def __call__(self, w: str) -> tuple[str, int] | None:
        if w not in self.cache:
            if len(self.cache) >= self.limit:
                self.cache.clear()
            self.cache[w] = self._found(w)
        return self.cache[w]


def masked_words(low: str) -> list[tuple[int, int]]:
    """Places of words of a lower-cased text in which signs or digits stand before letters, among them or at the beginning."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in MASKED.finditer(low):
        if m.start() < end:
            continue
        a, b = m.span()
        while a > end and (low[a - 1].isalnum() or low[a - 1] in SIGNS):
            a -= 1
        while b < len(low) and (low[b].isalnum() or low[b] in SIGNS):
            b += 1
        end = b
        while low[a] in OUTER:
            a += 1
        while low[b - 1] in OUTER:
            b -= 1
        if MASKED_FROM <= b - a <= MASKED_MOST and SIGN.search(low, a, b):
            out.append((a, b))
    return out


# ---------------------------------------------------------------- scoring


def find_hits(text: str, match: Matcher) -> tuple[list[tuple[int, int, str, int, bool]], int]:
    """(start, end, term, edits, is it quoted or reported) of every hit, and the number of words.

    Quoted: a sign of quotation on either side within WINDOW words. Reported: one of REPORTING among them.
    """
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    words = [(a, b, k) for k, (a, b) in enumerate(spans)]
    masked = masked_words(low)
    if masked:
        starts = [a for a, _ in spans]
        words += [(a, b, bisect.bisect_right(starts, a) - 1 if a >= starts[0] else 0) for a, b in masked]
    out: list[tuple[int, int, str, int, bool]] = []
    for a, b, k in words:
        got = match(low[a:b])
        if got is None or (k < len(spans) and (a, b) != spans[k] and any(x < b and a < y for x, y, *_ in out)):
            continue  # of a word with signs in it, letters by themselves are a term
        around = spans[max(0, k - WINDOW) : k + WINDOW + 1]
        left, right = low[min(a, around[0][0]) : a], low[b : max(b, around[-1][1]) + 1]
        told = (any(q in left for q in QUOTES) and any(q in right for q in QUOTES)) or not REPORTING.isdisjoint(low[x:y] for x, y in around)
        out.append((a, b, *got, told))
    return sorted(out), len(spans)


@dataclass
class Model:
    terms: dict[str, bool]
    weight: dict[tuple[str, int], float]  # log ratio of the hit's rates in toxic and in clean text, from 0 to 6
    base: float  # share of toxic rows among those without a hit
    coef: tuple[float, ...] = (-4.0, 0.8, 0.0, 0.0)
    quoted: float = QUOTED  # share of its weight that a quoted or reported hit keeps

    def hits(self, text: str, match: Matcher) -> tuple[list[tuple[int, int, str, int, float]], int]:
        """(start, end, term, edits, weight after its window) of every hit, and the number of words."""
        found, n = find_hits(text, match)
        return [(a, b, t, e, self.weight.get((t, e), 0.0) * (self.quoted if told else 1.0)) for a, b, t, e, told in found], n

    def score(self, text: str | None, match: Matcher) -> float:
        found, n = self.hits(text, match) if text else ([], 0)
        total = sum(x[4] for x in found)
        if total <= 0:
            return self.base
        return max(self.base, float(1 / (1 + np.exp(-_features(np.array([total]), np.array([n])) @ np.array(self.coef))[0])))


def _features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), np.minimum(total, 25.0), np.log((total + 0.5) / (n + 20.0)) + 4, np.log1p(n) - 5], 1)


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton steps of a logistic regression held towards `prior`."""
    c = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * (c - prior))
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return c


def _candidates(text: str) -> Iterator[tuple[str, int]]:
    """(word or beginning + '*', context) pairs of a text; a context is the two neighbours' hash."""
    ws = WORD.findall(text.lower())
    for k, w in enumerate(ws):
        context = hash_of((ws[k - 1] if k else "") + " " + (ws[k + 1] if k + 1 < len(ws) else ""))
        if len(w) >= 3:
            yield w, context
        for n in STEM_LENGTHS:
            if len(w) >= n:
                yield w[:n] + "*", context


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _frequent(rows: DataFrame, least: int) -> frozenset[str]:
    """Candidates that occur in at least `least` rows; summed per batch, so little is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            n: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                n.update({x[0] for x in _candidates(text or "")})
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    sums = rows.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return frozenset(r["term"] for r in sums.filter(F.col("n") >= least).select("term").collect())


def _counted(rows: DataFrame, wanted: frozenset[str], docs: bool) -> dict[str, tuple[int, int]]:
    """Candidate -> in how many different contexts it occurs, and in how many rows (0 without `docs`).

    Candidates are shuffled as their numbers; ids only where rows are counted.
    """
    terms = sorted(wanted)
    place = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen = {(place[x[0]], x[1]) for x in _candidates(text or "") if x[0] in place}
                if seen:
                    numbers, contexts = zip(*seen, strict=True)
                    cols = [pa.array(numbers, pa.int32()), pa.array(contexts, pa.int64())]
                    if docs:
                        cols.append(pa.array([doc] * len(numbers), pa.int64()))
                    yield pa.RecordBatch.from_arrays(cols, names=["term", "context", "id"][: len(cols)])

    each = rows.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(run, "term int, context bigint" + (", id bigint" if docs else ""))
    if docs:
        out = each.groupBy("term", "context").agg(F.min("id").alias("id")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))
    else:
        out = each.distinct().groupBy("term").agg(F.count("*").alias("n"), F.lit(0).alias("docs"))
    return {terms[r["term"]]: (r["n"], r["docs"]) for r in out.collect()}


def _choose(pos: dict[str, int], neg: dict[str, int], share: float) -> dict[str, bool]:
    """Lexicon from context counts in toxic and in clean rows; share: the toxic rows' part of all text.

    A term's log likelihood ratio against `share` must beat the number of candidates, and half of its contexts must be
    toxic ones.
    """
    need = math.log(max(len(pos), 2)) + 3.0

    def evidence(t: str) -> float:
        a, b = pos[t], neg.get(t, 0)
        p = a / (a + b)
        if p < 0.5 or p <= share:
            return 0.0
        return a * math.log(p / share) + (b * math.log((1 - p) / (1 - share)) if b else 0.0)

    good = {t: e for t in pos if (e := evidence(t)) > need}
    chosen: dict[str, bool] = {}
    # Shortest first: a longer form adds nothing that a chosen beginning does not already match, and a whole word is
    # better than its own beginning where it is nearly all that the beginning occurs in.
    for t in sorted(good, key=lambda t: (len(t.rstrip("*")), t.endswith("*"), t)):
        word = t.rstrip("*")
        if any(s and word.startswith(c) for c, s in chosen.items()):
            continue
        if t.endswith("*"):
            same = [w for w in good if not w.endswith("*") and w.startswith(word) and pos[w] >= 0.9 * pos[t]]
            if same:
                chosen[same[0]] = False
                continue
        chosen[word] = t.endswith("*")
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Lexicon and weights from labelled rows: about `toxic` and `clean` of them at most, picked by hash of the id."""
    with arrow_batches(docs.sparkSession, FIT_BYTES):
        return _fit(docs, labels, id_col, text_col, label_col, toxic, clean)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic: int, clean: int) -> Model:
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("bad")).groupBy("id").agg(F.max("bad").alias("bad"))
    counts = {r["bad"]: r["n"] for r in known.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if not counts.get(True):
        return Model({}, {}, 0.0)
    rate = lambda n, most: min(1 << 20, int((1 << 20) * most / max(n, 1)) + 1)
    part = F.when(F.col("bad"), F.lit(rate(counts[True], toxic))).otherwise(F.lit(rate(counts.get(False, 0), clean)))
    ids = known.filter(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 20)) < part)
    # The sample is bounded by the two parameters, so it may go to every task.
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id"), "labelled")
    bad, good = rows.filter("bad"), rows.filter("not bad")
    n_bad, n_good = bad.count(), good.count()
    if not n_bad:
        return Model({}, {}, 0.0)
    size = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.sum(F.length("text")).alias("n")).collect()}
    # One long row, or copies of one, are no evidence: a term needs several rows with contexts of their own.
    found = {t: n for t, (n, docs_) in _counted(bad, _frequent(bad, 3), docs=True).items() if n >= 4 and docs_ >= 3}
    none = {t: n for t, (n, _) in _counted(good, frozenset(found), docs=False).items()}
    terms = _choose(found, none, max(size.get(True) or 0, 1) / max(sum(x or 0 for x in size.values()), 1))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(terms)
        for batch in batches:
            cols: tuple[list, list] = ([], [])
            for text in batch.column("text").to_pylist():
                found, n = find_hits(text or "", match)
                cols[0].append(n)
                cols[1].append([f"{term} {edits}{int(told)}" for _, _, term, edits, told in found])
            yield pa.RecordBatch.from_arrays([batch.column("bad"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.string()))], names=["bad", "n", "hits"])

    # As many short rows as the sample has; the driver fits four numbers to them.
    seen = [(bool(r["bad"]), r["n"], [(h.rsplit(" ", 1)[0], int(h[-2]), h[-1] == "1") for h in r["hits"]]) for r in rows.select("text", "bad").mapInArrow(tally, "bad boolean, n bigint, hits array<string>").collect()]
    words = [sum(n for b, n, _ in seen if b == side) + 1 for side in (False, True)]
    count: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
    told = [[0, 0], [0, 0]]
    for is_bad, _, hits in seen:
        for term, edits, quoted in hits:
            count[term, edits][is_bad] += 1
            told[quoted][is_bad] += 1
    quoted = _quoted_share(told, words)
    weight: dict[tuple[str, int], float] = {}
    for t in terms:
        for edits in (0, 1, 2):
            c, b = count[(t, edits)]
            ratio = math.log((b + 0.5) / words[1]) - math.log((c + 0.5) / words[0])
            # A misspelling that training has hardly seen counts half of the term.
            weight[(t, edits)] = 0.5 * weight[(t, 0)] if edits and b + c < 3 else min(6.0, max(0.0, ratio))
    total = np.array([sum(weight[t, e] * (quoted if q else 1.0) for t, e, q in hits) for _, _, hits in seen])
    bad_row, size = np.array([b for b, _, _ in seen]), np.array([n for _, n, _ in seen])
    none = total <= 0
    base = float((bad_row[none].sum() + 0.1) / (none.sum() + 1.0))
    # Two rows that are always there: one weak hit in a long clean row, three strong ones in a short toxic row.
    x = _features(np.append(total[~none], [3.0, 12.0]), np.append(size[~none], [1000, 100]))
    coef = _logistic(x, np.append(bad_row[~none], [False, True]).astype(float), np.array([-3.0, 0.4, 0.5, 0.0]))
    return Model(terms, weight, base, tuple(coef), quoted)


def _quoted_share(told: list[list[int]], words: list[int]) -> float:
    """What a quoted hit is worth beside a plain one: the ratio of their log ratios of rates in toxic and clean text."""
    ratio = [max(0.0, math.log((bad + 0.5) / words[1]) - math.log((good + 0.5) / words[0])) for good, bad in told]
    many = sum(told[1])
    seen = min(1.0, ratio[1] / ratio[0]) if ratio[0] > 0 else QUOTED
    return (many * seen + QUOTED_HITS * QUOTED) / (many + QUOTED_HITS)


def score_column(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts have the share of toxic rows among those without a hit."""

    @F.arrow_udf("double")
    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = Matcher(model.terms)
        for chunk in col:
            texts = chunk.to_pylist()
            out = np.full(len(texts), model.base)
            for a, part in _parts(texts):
                for k in _touched(part, match):
                    out[a + k] = model.score(part[k], match)
            yield pa.array(np.clip(out, 0.0, 1.0))

    return run(text)


def _parts(texts: list[str | None], limit: int = PART_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    a, size = 0, 0
    for k, t in enumerate(texts):
        if k > a and size + len(t or "") > limit:
            yield a, texts[a:k]
            a, size = k, 0
        size += len(t or "")
    if a < len(texts):
        yield a, texts[a:]


def _touched(texts: list[str | None], match: Matcher) -> list[int]:
    """Rows with a hit: the distinct words of all rows are matched once."""
    lower = [t.lower() if t else "" for t in texts]
    found = [{*WORD.findall(t), *(t[a:b] for a, b in masked_words(t))} for t in lower]
    every = set().union(*found) if found else set()
    bad = {w for w in every if match(w) is not None}
    return [k for k, ws in enumerate(found) if not bad.isdisjoint(ws)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score, predicted for every row; rows are independent, so repeated rows get equal scores."""
    out = docs.select(F.col(id_col), score_column(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
