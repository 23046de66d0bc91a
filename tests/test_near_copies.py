"""Near copies against difflib over all pairs, and the bounds that keep pairs from being compared."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions import similarity, text, vectors
from chronolith.operators import clean, dedup, nearcopies
from chronolith.sources.views import posts


def edited(rng, base, alphabet, edits):
    out = list(base)
    for _ in range(edits):
        at, many = rng.randrange(len(out) + 1), rng.choice([1, 1, 4])
        kind = rng.random()
        if kind < 0.4:
            del out[at : at + many]
        elif kind < 0.7:
            out[at:at] = [rng.choice(alphabet) for _ in range(many)]
        elif at < len(out):
            out[at] = rng.choice(alphabet)
    return "".join(out)


def test_ratio_equals_difflib(monkeypatch):
    monkeypatch.setattr(similarity, "SHORT", 0)
    rng = random.Random(1)
    found = 0
    for _ in range(600):
        alphabet = rng.choice(["ab", "abc d", "abcdefghij klm", "aé日🙂 "])
        a = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 30, 120, 400])))
        b = edited(rng, a, alphabet, rng.choice([0, 1, 3, 10]))
        if rng.random() < 0.1:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        for least in (0.0, 0.5, 0.9, 0.985):
            assert similarity.ratio(a, b, least) == (want if want >= least else None)
            found += want >= least
    assert 600 < found < 2400


def test_stretches_that_hashes_confuse():
    """Thue-Morse words, whose polynomial hashes are equal: the plain way decides."""
    a = "".join("ab"[k.bit_count() & 1] for k in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    want = difflib.SequenceMatcher(None, a[:1500] + b[:1500], b[:1500] + a[:1500], autojunk=False).ratio()
    assert similarity.ratio(a[:1500] + b[:1500], b[:1500] + a[:1500], 0.3) == (want if want >= 0.3 else None)


def brute(rows, least=0.985):
    by_text = {}
    for i, c in sorted(rows):
        by_text.setdefault(c, i)
    out = set()
    for (c, i), (d, j) in itertools.combinations(sorted(by_text.items(), key=lambda x: x[1]), 2):
        if c[:24] == d[:24] and abs(len(c) // 32 - len(d) // 32) <= 1 and abs(len(c) - len(d)) <= max(3, max(len(c), len(d)) // 50):
            r = difflib.SequenceMatcher(None, c, d, autojunk=False).ratio()
            if r >= least:
                out.add((i, j, r))
    return out | {(by_text[c], i, 1.0) for i, c in rows if by_text[c] != i}


@pytest.fixture(scope="module")
def crowd():
    """Texts of three heads: near copies, others that share most of a template, and strangers."""
    rng = random.Random(6)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{k}" for k in range(400)]
    out = []
    for head in ("the first head of all texts", "another head of many texts here", "a third one that few texts have"):
        template = [rng.choice(words) for _ in range(40)]
        for _ in range(14):
            base = head + " " + " ".join(w if rng.random() < 0.7 else rng.choice(words) for w in template)
            out += [base, *(edited(rng, base, "abc 1", rng.choice([0, 1, 2, 3, 5])) for _ in range(2))]
        out += [head + " " + " ".join(rng.choice(words) for _ in range(30)) for _ in range(5)]
    return [(f"{k:03d}", t) for k, t in enumerate(out)]


@pytest.mark.parametrize("direct", [64, 0, 20])
def test_near_copy_pairs_are_those_of_all_pairs(spark, crowd, monkeypatch, direct):
    df = spark.createDataFrame(crowd, "id string, text string")
    rows = [(r["id"], r["c"]) for r in dedup._long_canonical(df).collect()]
    monkeypatch.setattr(nearcopies, "DIRECT", direct)
    monkeypatch.setattr(nearcopies, "SAMPLE", 25)
    got = {tuple(r) for r in dedup.near_copy_pairs(df).collect()}
    assert got == brute(rows) and len(got) > 40


def test_near_copy_pairs_of_documents(spark):
    df = posts(spark, "/root/testdata/sf0.001")
    rows = [(r["id"], r["c"]) for r in dedup._long_canonical(df).collect()]
    assert {tuple(r) for r in dedup.near_copy_pairs(df).collect()} == brute(rows)


def test_a_head_that_many_strangers_share(spark):
    """1,500 texts with one head and half a template: 1.1 million pairs, few of which become candidates."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5000)]
    template = " ".join(rng.choice(words) for _ in range(20))
    rows = [(f"{k}", f"one head for all of them {template} " + " ".join(rng.choice(words) for _ in range(20))) for k in range(1500)]
    rows += [(f"x{k}", rows[k][1][:-1] + "q") for k in range(10)]
    df = spark.createDataFrame(rows, "class string, c string")
    made = nearcopies.candidates(df, []).select("class", "class2").collect()
    assert {(f"{k}", f"x{k}") for k in range(10)} <= {tuple(r) for r in made} and len(made) < 15_000


def test_the_first_of_two_copies_leads(spark):
    """The ratio minds which text comes first; the cleaner compares leaders with newcomers."""
    rng = random.Random(11)
    while True:
        a = "".join(rng.choice("ab c") for _ in range(230))
        b = edited(rng, a, "ab c", 4)
        ca, cb = (" ".join(x.split()) for x in (a, b))
        one, two = (difflib.SequenceMatcher(None, *x, autojunk=False).ratio() for x in ((ca, cb), (cb, ca)))
        if min(len(ca), len(cb)) >= 200 and ca[:24] == cb[:24] and one >= 0.985 > two:
            break
    for first, second, near in ((a, b, True), (b, a, False)):
        rows = [(2020, 1, "comments", k, "u", f"t{k}", "memes", t, n) for n, (k, t) in enumerate([("1", first), ("2", second)])]
        df = spark.createDataFrame(rows, "year int, month int, kind string, id string, author string, thread_id string, subreddit string, text string, created_utc long")
        got = {r["id"]: r["reason"] for r in clean.exact(df, near=1).collect()}
        assert got == {"1": "kept", "2": "near_copy_cap" if near else "kept"}


def test_empty_texts_and_zero_vectors(spark):
    row = spark.createDataFrame([("", [0.0, 0.0], [1.0, 2.0])], "t string, a array<double>, b array<double>")
    got = row.select(text.mark_share(F.col("t")).alias("m"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.unit(F.col("a")).alias("u"), vectors.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("v"), vectors.softmax(F.col("b")).alias("s")).first()
    assert got["m"] == 0 and got["c"] == 0 and got["u"] == [0.0, 0.0] and got["v"] == [0.6, 0.8]
    assert abs(sum(got["s"]) - 1) < 1e-12 and got["s"][1] > got["s"][0]
    marks = spark.createDataFrame([("é" * 2,)], "t string").select(text.mark_share(F.col("t")).alias("m")).first()
    assert marks["m"] == 0.5


def test_caps_together_and_rows_that_need_no_fold(spark):
    """All caps at once against one loop over all rows; rows whose keys cannot be used up are not folded."""
    import re
    from collections import Counter

    rng = random.Random(9)
    bases = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(90)) for _ in range(5)]
    rows = []
    for k in range(260):
        busy = rng.random() < 0.5
        text = rng.choice([f"short text {rng.randrange(12 if busy else 10**6)}", rng.choice(bases) + rng.choice(["", " end", " x", "!"]) if busy else " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))])
        rows.append((2020, 1 + k % 2, "comments", f"{k:04d}", rng.choice(["ann", "bob", "", "[deleted]"]) if busy else f"u{k}", rng.choice(["t1", "t2", None, ""]) if busy else f"x{k}", rng.choice(["memes", "Memes", "me_irl"]), text, k // 3))
    df = spark.createDataFrame(rows, "year int, month int, kind string, id string, author string, thread_id string, subreddit string, text string, created_utc long")
    caps = {"author": 6, "thread": 9, "copies": 2, "near": 3}
    got = {r["id"]: r["reason"] for r in clean.exact(df, **caps).collect()}
    for month in (1, 2):
        used, leaders = Counter(), {}
        for r in sorted((r for r in rows if r[1] == month), key=lambda r: (r[8], r[3])):
            board, who, text = r[6].lower(), r[4].lower(), r[7]
            held = [("author_cap", (board, who), 6)] if who not in ("", "[deleted]") else []
            held += [("thread_cap", r[5], 9)] if r[5] else []
            held += [("exact_copy_cap", (board, text), 2)]
            why = next((n for n, key, cap in held if used[n, key] >= cap), None)
            c = re.sub(r"\W+", " ", text.casefold()).strip()
            if why is None and len(text) >= 200 and len(c) >= 160:
                band, key = len(c) // 32, None
                for b in (band - 1, band, band + 1):
                    for other in leaders.get((b, c[:24]), []):
                        if key is None and abs(len(other) - len(c)) <= max(3, len(c) // 50) and difflib.SequenceMatcher(None, other, c, autojunk=False).ratio() >= 0.985:
                            key = other
                if key is None:
                    leaders.setdefault((band, c[:24]), []).append(c)
                    key = c
                held.append(("near_copy_cap", (board, key), 3))
                why = "near_copy_cap" if used["near_copy_cap", (board, key)] >= 3 else None
            if why is None:
                used.update((n, key) for n, key, _ in held)
            assert got[r[3]] == (why or "kept"), r
    assert len(set(got.values())) >= 4
    seen = []
    plain = clean._contended
    clean._contended = lambda *a: seen.append(plain(*a)) or seen[-1]
    try:
        clean.exact(df, **caps)
    finally:
        clean._contended = plain
    counts = {r["contended"]: r["count"] for r in seen[0].groupBy("contended").count().collect()}
    assert counts[False] > 60 and counts[True] > 60


def test_texts_go_to_no_pair_that_lacks_too_many_runs(spark):
    """Texts of one head and length: paired by their bands alone, all of them were sent."""
    rng = random.Random(8)
    head = "the same head of every one "
    texts = [head + "".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    texts.append(texts[2][:300] + "z" + texts[2][301:])
    df = spark.createDataFrame(list(enumerate(texts)), "class long, c string")
    assert [(r["class"], r["class2"]) for r in nearcopies.candidates(df, []).collect()] == [(2, 6)]
