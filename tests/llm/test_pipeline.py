"""Every stage of the pipeline against plain loops, and on nulls, empty tables, repeated ids and clashing names."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from chronolith.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(cp.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """What every stage but the last is given and returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        after = cp.stored(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    match = toxicity.Matcher(model.terms)
    assert set(texts(after)) == {k for k, t in texts(before).items() if model.score(t, match) < cp.THRESHOLD}
    assert 0 < after.count() < before.count()


def test_exact_dedup(steps):
    before, after = (texts(x) for x in steps["exact_dedup"])
    last = {t or "": k for k, t in sorted(before.items())}
    assert set(after) == set(last.values())


def test_near_dedup(steps):
    before, after = (texts(x) for x in steps["near_dedup"])
    sets = {}
    for k, t in before.items():
        ws = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[k] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    up = {k: k for k in before}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(before), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert set(after) == {k for k in before if top(k) == k}


def plain_mix(rows, weights=(5, 2, 1), cap=3, block=512):
    """(doc_id, words) in the order of the mix; rows: (doc_id, source, words)."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(w) for _, x, w in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    rest, open_, target = sum(size.values()), set(sources), {}
    while over := {s for s in open_ if rest * weight[s] > cap * size[s] * sum(weight[x] for x in open_)}:
        target |= {s: cap * size[s] for s in over}
        rest, open_ = rest - sum(target[s] for s in over), open_ - over
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    streams, quota = {}, {}
    for s in sources:
        own = sorted((hashlib.md5(f"{i}:7".encode()).hexdigest(), i, len(w)) for i, x, w in rows if x == s)
        want, n = int(target[s] + 0.5), size[s]
        rounds = -(-n // block)
        quota[s] = (want // n) * rounds + -(-(want % n) // block) if n else 0
        streams[s], at, left = [], 0, want
        for copy in itertools.count():  # (rank of the block that holds the row's first word, place, doc_id, words)
            if not n or left <= 0:
                break
            at = 0
            for _, i, words in own:
                if min(words, left) > 0:
                    streams[s].append((at // block + 1 + copy * rounds, at, i, min(words, left)))
                at, left = at + words, left - words
    total = sum(quota.values())
    bounds, used, position = np.cumsum([quota[s] for s in sources]), collections.Counter(), {}
    for slot in range(total):
        point = ((slot + 1) * mixing.GOLDEN % 2**64 >> 11) * 2.0**-53
        s = sources[int(np.searchsorted(bounds, int(point * total), "right"))]
        used[s] += 1
        if used[s] <= quota[s]:
            position[s, used[s]] = slot
    for k, s in enumerate(sources):
        for rank in range(used[s] + 1, quota[s] + 1):
            position[s, rank] = rank * len(sources) + k + total
    made = [(position[s, rank], at, i, words) for s in sources for rank, at, i, words in streams[s]]
    return [(i, words) for _, _, i, words in sorted(made)]


def test_mixing(steps):
    before, after = steps["mixing"]
    want = plain_mix([(r["doc_id"], r["source"], WORD.findall(r["text"] or "")) for r in before.collect()])
    got = [(r["doc_id"], len(WORD.findall(r["text"]))) for r in STAGE["mixing"](before.sparkSession, before, SF).collect()]
    assert got == want and collections.Counter(got) == collections.Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in after.collect())
    full = texts(before)
    for r in after.collect():
        own = WORD.findall(r["text"])
        assert r["text"] == full[r["doc_id"]] or own == WORD.findall(full[r["doc_id"]])[: len(own)]


def test_packing(spark, steps):
    from tokenizers import Tokenizer

    docs = steps["mixing"][1]
    whole = Tokenizer.from_file(cp.public_tokenizer()[0])
    want, total = collections.Counter(), 0
    for r in docs.collect():
        n = len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        total += n
        first = n % 2048 or 2048
        want.update([(r["doc_id"], 0, 0, first), *((r["doc_id"], 1 + k, first + 2048 * k, 2048) for k in range((n - first) // 2048))])
    rows = STAGE["packing"](spark, docs, SF).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    big = sum(1 for r in rows if r["length"] > 1024)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * max(-(-total // 2048), big) + 1


ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "one two three four five six", None, None), (3, "one two three four five six", None, None), (3, "another text of this id here", "en", "a"),
    (None, "a row without an id but with words", "en", "a"), (None, "and one more without an id", "en", ""), (4, "\n\t ", "en", "b"), (5, "word " * 3000, "fr", "b"),
]


@pytest.mark.parametrize("name", list(STAGE))
def test_edges(spark, name):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumns({c: F.lit(k) for k, c in enumerate(("__id", "__toxic", "__n", "__size", "row", "mixed", "id", "n", "digest", "node", "size", "words"))})
    out = STAGE[name](spark, df, SF)
    assert STAGE[name](spark, df.limit(0), SF).count() == 0
    if name == "packing":
        assert out.filter("piece = 0").count() == len(ROWS)
        return
    assert out.columns == df.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    ids = collections.Counter((r[0], r[1]) for r in ROWS)
    if name == "toxicity":
        assert got == ids
    elif name == "exact_dedup":
        assert got == {k: 1 for k in ids if k != (1, None)}
    elif name == "near_dedup":
        assert got == {k: (2 if k[0] in (1, 2, 4) and ids[k] > 1 else 1) for k in ids}
    else:
        words = sum(len(WORD.findall(r[1] or "")) for r in ROWS)
        assert abs(sum(len(WORD.findall(t)) * n for (_, t), n in got.items()) - words) <= 4
        assert all(n <= 3 * ids[k] + 1 for k, n in got.items()) and not {(1, None), (2, "")} & set(got)
