"""Operators beyond SQL against plain loops over small inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from chronolith.llm import imatch, langid, ngram_lm, packing, setsketch, toxicity
from chronolith.llm.queries import public_tokenizer


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have equal sums under every odd base modulo 2**64."""
    from tokenizers import Tokenizer

    texts = [t for n in (1024, 2048, 4096) for t in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = setsketch.near_duplicates(df, width=3, percent=85).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)
    whole = Tokenizer.from_file(public_tokenizer()[0])
    for r in packing.pack(df, public_tokenizer()).collect():
        ids = np.array(whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0], "<u4")[r["start"] :][: r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
    model = ngram_lm.fit(df)
    assert model.vocabulary == len(texts) + 1 and model.tokens == 2 * len(texts)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    rng = random.Random(2)
    x, y = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(80)) for c in "xy")
    rows = [(5, x), (5, y), (7, y + " end"), (3, x + " end"), (None, x + " last"), (None, "alone here with words"), (9, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as node", "3 as n")
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(df).collect())
    assert got == {(5, 3, False): 1, (5, 5, True): 1, (7, 5, False): 1, (3, 3, True): 1, (None, 3, False): 1, (None, None, True): 1, (9, 9, True): 2}
    kept = setsketch.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("5", y), ("3", x + " end"), ("None", "alone here with words"), ("9", ""), ("9", "")])
    named = df.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert {r["component_id"] for r in setsketch.near_duplicates(named).collect()} == {"d3", "d5", "d9", None}
    assert setsketch.keep_one(df.limit(0)).count() == 0


class PlainModel:
    """Interpolated absolute discounting with dictionaries."""

    def __init__(self, texts):
        rows = [self.tokens(t) for t in texts]
        self.counts = [collections.Counter(tuple(t[i : i + k]) for t in rows for i in range(len(t) - k + 1)) for k in (1, 2, 3)]
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])
        self.d, self.total, self.kinds = [], [], []
        for c in self.counts:
            ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
            self.d.append(min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95))
            self.total.append(collections.Counter())
            self.kinds.append(collections.Counter())
            for gram, x in c.items():
                self.total[-1][gram[:-1]] += x
                self.kinds[-1][gram[:-1]] += 1

    @staticmethod
    def tokens(text):
        return (text or "").lower().split() + ["</s>"]

    def p(self, word, context):
        if not context:
            seen = self.counts[0][word,]
            return (seen - self.d[0]) / self.n if seen else self.d[0] * self.v / self.n / (self.v + 1)
        k, low = len(context), self.p(word, context[1:])
        if not self.total[k][context]:
            return low
        return max(self.counts[k][*context, word] - self.d[k], 0) / self.total[k][context] + self.d[k] * self.kinds[k][context] / self.total[k][context] * low

    def score(self, text):
        t = self.tokens(text)
        return sum(math.log10(self.p(w, tuple(t[max(0, i - 2) : i]))) for i, w in enumerate(t))

    def base(self, text):
        return sum(math.log10((self.counts[0][w,] + 1) / (self.n + self.v + 1)) for w in self.tokens(text))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 40))) for _ in range(250)]
    return [*texts, *(f"Hot x{k % 7}" for k in range(200)), None, ""]


@pytest.mark.parametrize("per_shard", [2_000_000, 37])
def test_language_model_by_brute_force(spark, corpus, monkeypatch, per_shard):
    """Also where the word `hot` and others have successors in many shards."""
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", per_shard)
    plain = PlainModel(corpus)
    model = ngram_lm.fit(spark.createDataFrame([(t,) for t in corpus], "text string"))
    assert (model.tokens, model.vocabulary, model.nodes) == (plain.n, plain.v, {k + 1: len(c) for k, c in enumerate(plain.counts)})
    asked = [*corpus[:60], "zzz yyy xxx", "w1 zzz w2 w3", "hot hot X1", "", None]
    for r in ngram_lm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect():
        text = asked[r["doc_id"]]
        many = len(plain.tokens(text))
        assert r["n_tokens"] == many and abs(r["base_score"] - plain.base(text)) < 1e-9 * many + 1e-9
        assert abs(r["score"] - plain.score(text)) <= many * model.step  # a quantised number is off by half a step; two are added


def test_probabilities_sum_to_one_and_nonsense_scores_low(spark, corpus):
    plain = PlainModel(corpus)
    known = [w for w, in plain.counts[0]]
    for context in ((), ("w1",), ("w0", "w1"), ("zzz",), ("hot", "x1")):
        assert abs(sum(plain.p(w, context) for w in known) + (plain.v + 1) * plain.p("never seen", context) - 1) < 1e-9
    model = ngram_lm.fit(spark.createDataFrame([(t,) for t in corpus], "text string"))
    nonsense = " ".join(f"q{k}q" for k in range(100))
    rows = [(k, t) for k, t in enumerate(corpus[:250]) if len(plain.tokens(t)) > 5] + [(-1, nonsense)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[-1] < min(x for k, x in got.items() if k >= 0)


def plain_levels(t, rare):
    h = xxhash.xxh64_intdigest(struct.pack("<i", 17), xxhash.xxh64_intdigest(struct.pack("<q", t), 42))
    low, level = h & 255, 0
    most = 3 if rare else 5
    while level < most - 1 and low & 3 == 0:
        level, low = level + 1, low >> 2
    return (5 + level if rare else level) * 8 + (h >> 40 & 7)


def test_fingerprints_by_plain_loops(spark):
    """Lexicon by counted documents, cells by hashes, likeness by cells, all again in Python."""
    rng = random.Random(12)
    words = [f"word{k}" for k in range(900)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) ** 0.8 for k in range(900)], k=rng.randrange(0, 120))) for _ in range(120)] + ["", "only rareone raretwo", "only rareone raretwo", "THE Word1 word1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    term = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) >> 8
    sets = [sorted({term(w) for w in t.lower().split()}) for t in texts]
    df_of = collections.Counter(t for s in sets for t in s)
    n = len(texts)
    band = {t & (1 << 23) - 1 for t, c in df_of.items() if max(2.0, 0.001 * n) <= c <= 0.2 * n}
    often = {t & (1 << 20) - 1 for t, c in df_of.items() if c > 0.2 * n}

    def fingerprint(s):
        lx = [t for t in s if t & (1 << 23) - 1 in band]
        rare = [t for t in s if t & (1 << 23) - 1 not in band and t & (1 << 20) - 1 not in often]
        cells = collections.defaultdict(list)
        for t in lx:
            cells[plain_levels(t, False)].append(t)
        for t in rare:
            cells[plain_levels(t, True)].append(t)
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        whole = md5(" ".join(str((c << 56) + t) for c in range(40) for t in sorted(cells.get(c, []))) if lx else "-" + " ".join(map(str, s)))
        return whole + "".join(md5("".join(f" {(c << 56) + t}" for t in sorted(cells[c])))[:8] if c in cells else "-" * 8 for c in range(64))

    def likeness(x, y):
        if x == y:
            return 1.0
        best = 0.0
        for level in range(8):
            a, b = ([v[32 + (level * 8 + k) * 8 :][:8] for k in range(8)] for v in (x, y))
            some = sum(p != "-" * 8 or q != "-" * 8 for p, q in zip(a, b, strict=True))
            best = max(best, sum(p == q != "-" * 8 for p, q in zip(a, b, strict=True)) / max(some, 4))
        return best

    prints = [fingerprint(s) for s in sets]
    for r in imatch.edited_likeness(df).collect():
        k = r["doc_id"]
        after = texts[k - 1] if k else texts[-1]
        cut = len(texts[k]) // 3
        edited = texts[k][: len(texts[k]) - cut] + after[:cut]
        other = fingerprint(sorted({term(w) for w in edited.lower().split()}))
        assert r["fingerprint"] == prints[k] and r["edited_fingerprint"] == other, texts[k]
        assert abs(r["near_edited"] - likeness(prints[k], other)) < 1e-9 and abs(r["near_next"] - likeness(prints[k], prints[k - 1 if k else -1])) < 1e-9


def test_the_next_row_in_many_buckets(spark):
    ids = [3 * k * k for k in range(60)] + [None] * 25 + [7, 7, 7]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, text string")
    for quantiles in (1, 4, 2000):
        got = {r["text"]: r["next_text"] for r in imatch.next_rows(df, "id", ["text"], per_bucket=4, quantiles=quantiles).collect()}
        turn = lambda t: hashlib.md5(t.encode()).hexdigest()
        order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), turn(r[1])))]
        assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


def test_the_plan_of_the_next_row_does_not_grow_with_a_power_of_the_quantiles(spark):
    df = spark.createDataFrame([(k, str(k)) for k in range(240)], "id long, text string")
    most = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(most)
    spark.conf.set(most, "1000000")
    try:
        plan = imatch.next_rows(df, "id", ["text"], per_bucket=4)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(most, before)
    assert len(plan) < 20_000  # 60 quantiles; with a column for each step of the bisection it had 527,000


def test_language_scores_and_path_by_plain_loops(spark):
    """Viterbi over all paths' scores, walked word by word with dictionaries, against the operator's spans."""
    rng = random.Random(3)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7)))
    rows = [(k, " ".join(word(lang) for _ in range(40)), lang) for k, lang in enumerate(rng.choices(list(letters), k=120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    mixed = [" ".join(word(lang) for lang in (["aa"] * 7 + ["cc"] * 9 + ["bb"] * 5)) for _ in range(20)] + ["a", "12 , .", "p!a?", word("aa") + " " + "ж" * 4]
    for text, (lang, share, spans) in zip(mixed, langid.label_spans(model, mixed), strict=True):
        cut = langid.cut_words([text])
        score = []
        for j in range(len(cut.start)):
            at = range(cut.start[j], cut.end[j])
            own = [float(model.word[cut.whole[j], k]) + sum(float(model.gram[g[c], k]) for g in cut.gram for c in at) for k in range(3)]
            open_ = model.allowed[cut.script[j]]
            score.append([s if open_[k] or not open_.any() else -1e6 for k, s in enumerate(own)])
        tables = []
        state = [list(score[0])] if score else []
        for j in range(1, len(score)):
            back = []
            nxt = []
            for k in range(3):
                options = [(state[-1][m] - (langid.PENALTY if m != k else 0), m == k, -m) for m in range(3)]
                top = max(options)
                back.append(-top[2])
                nxt.append(top[0] + score[j][k])
            tables.append(back)
            state.append(nxt)
        if not score:
            assert (lang, share, spans) == ("und", 0.0, [])
            continue
        k = int(np.argmax(state[-1]))
        path = [k]
        for back in reversed(tables):
            k = back[k]
            path.append(k)
        path.reverse()
        size = [int(b - a) for a, b in zip(cut.start, cut.end, strict=True)]
        want = collections.Counter()
        for p, n in zip(path, size, strict=True):
            want[model.langs[p]] += n
        assert sum(n for _, n in spans) == sum(size) and abs(share - max(want.values()) / sum(size)) < 1e-9 and want[lang] == max(want.values())
        runs = [(model.langs[p], sum(n for _, n in g)) for p, g in itertools.groupby(zip(path, size, strict=True), key=lambda x: x[0])]
        assert runs == spans


def test_toxicity_scores_by_plain_loops(spark):
    """Every word against every term by edit distances, windows and weights by hand."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bdfglmnprt") + rng.choice("aeiou") for _ in range(3))
    terms = {"slurword": False, "vile": True, "grubstem": True, "nasty": False}
    weight = {(t, e): 1.5 + k / 4 - e / 2 for k, t in enumerate(terms) for e in (0, 1, 2)}
    model = toxicity.Model(terms, weight, 0.02, (-3.0, 0.6, 0.4, 0.1))

    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    def find(w):
        exact = [t for t, stem in terms.items() if (w.startswith(t) if stem else w == t)]
        if exact:
            return max(exact, key=len), 0
        far = {t: min(distance(w[:k], t) for k in (range(len(w) + 1) if stem else [len(w)])) for t, stem in terms.items()}
        near = [(-d, len(t), t) for t, d in far.items() if len(w) >= 4 and d <= (0 if len(t) < 5 else 1 if len(t) < 8 else 2)]
        if near:
            return max(near)[2], -max(near)[0]
        swaps = [t for t, stem in terms.items() if len(t) == 4 and (stem or len(w) == 4) and distance(w[:4], t) == 1 and sorted(w[:4]) == sorted(t)]
        return (swaps[0], 1) if swaps else None

    def score(text):
        ws = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text.lower())]
        total = 0.0
        for k, (a, b) in enumerate(ws):
            got = find(text.lower()[a:b])
            if got is None:
                continue
            near = ws[max(0, k - 5) : k + 6]
            left, right = text[near[0][0] : a], text[b : near[-1][1] + 1]
            told = any(text.lower()[p:q] in toxicity.REPORTING for p, q in near)
            total += weight[got] * (model.quoted if told or (any(q in left for q in toxicity.QUOTES) and any(q in right for q in toxicity.QUOTES)) else 1.0)
        if total <= 0:
            return 0.02
        x = np.array([1.0, min(total, 25.0), math.log((total + 0.5) / (len(ws) + 20.0)) + 4, math.log1p(len(ws)) - 5])
        return max(0.02, 1 / (1 + math.exp(-float(x @ np.array(model.coef)))))

    bad = ["slurword", "slurwrod", "vile", "vileness", "grubstems", "grubtsem", "nasty", "nsty", "nastyy", "slur", "vlie", "lsurwrod", "sluwrd"]
    texts = [" ".join(rng.choice(bad) if rng.random() < 0.15 else rng.choice([word(), word(), '"', "said"]) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert all(abs(r["score"] - score(texts[r["doc_id"]])) < 1e-9 for r in got)


def test_remembered_chunks_are_confirmed_by_bytes(monkeypatch):
    """With a hash that is the same for every chunk of a length, the ids are still those of the tokenizer."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "segment_hashes", lambda raw, a, b: np.stack([(b - a).astype(np.uint64)] * 2, 1))
    monkeypatch.setattr(packing, "CACHE", 6)
    whole, rng = Tokenizer.from_file(public_tokenizer()[0]), random.Random(1)
    enc = packing.Encoder(*public_tokenizer())
    for _ in range(6):
        texts = [" ".join("".join(rng.choices("abcde", k=rng.randrange(1, 9))) for _ in range(20)) for _ in range(8)]
        ids, at = enc.rows(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
