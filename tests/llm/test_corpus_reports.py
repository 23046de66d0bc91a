"""Alignment, decontamination and the filter audit against plain loops, and on odd rows."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from chronolith.llm import alignment, decontaminate, filter_audit
from chronolith.llm.queries import public_tokenizer

CLASHING = ("id", "text_sha", "part", "mask", "n", "slice", "stripe", "place", "digest", "first", "good", "all", "words", "items", "spans", "n_words", "times", "one")
LONG = " ".join(f"w{k % 977}" for k in range(30000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, "one two three", None), (3, "one two three", None), (3, "other text of this id", ""), (None, "a row without an id", "b"), (None, "a row without an id", "b"),
    (4, "\n\t ", "b"), (5, LONG, "b"), (6, "Grüße 日本語 ünïcödé 🙂 text", "c"), (7, " ", "c"), (8, "  two  blanks and a wide one ", "c"), (9, "a▁b stays out", "c"), (10, "<unk> <s> <0x0A><|endoftext|>", "c"),
    (11, "\x00a\r\nb\n\n c", "c"), (12, "x" * 5000 + " y", "c"), (13, "é ́e .​", "c"), (14, "one two three", "a"), (15, "don't 've  it's 12 345", "a"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHING})


# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("piece_bpe_32k.model")
    a = Tokenizer.from_file(public_tokenizer()[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path), (*public_tokenizer()[1:], path)


def plain_alignment(tokenizers, texts):
    a, b, _ = tokenizers
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in a.get_vocab().items() if all(c in byte_of for c in t)}
    links, made = collections.Counter(), []
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = [bytes_a[i] for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not t or any(b"".join(x) != (" " + t).encode() for x in parts):
            made.append(None)
            continue
        spans = []
        for p, own in zip(parts, ids, strict=True):
            ends = list(itertools.accumulate(map(len, p)))
            spans.append(list(zip([0, *ends[:-1]], ends, own, strict=True)))
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in spans) for lo, hi in zip([0, *both[:-1]], both, strict=True)) if len(both) < 400 else None
        own = [(i, j) for s, e, i in spans[0] for x, y, j in spans[1] if x < e and s < y] if len(spans[0]) < 400 else None
        if own is None:  # the same by walking both sides at once
            own, ends, i, j = [], [[e for _, e, _ in side] for side in spans], 0, 0
            while i < len(spans[0]):
                own.append((spans[0][i][2], spans[1][j][2]))
                i, j = i + (ends[0][i] <= ends[1][j]), j + (ends[1][j] <= ends[0][i])
        links.update(own)
        made.append((len(ids[0]), len(ids[1]), len(both), own, groups))
    best = collections.Counter()
    for (_, j), n in links.items():
        best[j] = max(best[j], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[3]), sum(links[x] == best[x[1]] for x in m[3]), sum(links[x] for x in m[3]), m[4] and hashlib.sha256(m[4].encode()).hexdigest()) for m in made
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def compare_alignment(spark, tokenizers, texts):
    df = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, tokenizers[2]).collect()}
    for k, want in enumerate(plain_alignment(tokenizers, texts)):
        assert got[k][:6] == want[:6] and (want[6] is None or got[k][6] == want[6]), (k, texts[k][:60])
    return got


def test_alignment_of_odd_texts(spark, tokenizers, monkeypatch):
    rng = random.Random(5)
    pool = [" ", " ", "  ", "\n", "\t", "a", "the", "Wörter", " ", " ", "　", "é", "é", "日本", "🙂", "12", "'s", ".", "\u0085", "\r\n", "\x1c", "ing", "ŀ", "<s>", "​", "ß"]
    texts = [t for _, t, _ in ODD] + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    whole = compare_alignment(spark, tokenizers, texts)
    assert any(x[0] == 0 for x in whole.values()) and sum(x[0] > 0 for x in whole.values()) > 390
    monkeypatch.setattr(alignment, "SLICE_BYTES", 600)  # many slices, of which the counts are the sum
    monkeypatch.setattr(alignment, "LEAST_STRIPES", 3)
    assert compare_alignment(spark, tokenizers, texts) == whole


def test_alignment_of_documents(spark, tokenizers):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    compare_alignment(spark, tokenizers, texts)


def test_alignment_edges(spark, tokenizers):
    rows = alignment.align(frame(spark, ODD), tokenizers[2]).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, *_ in ODD)
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(tuple(r[c] for c in COLUMNS))
    assert by[1] == by[2] == by[9] == {(0, 0, 0, 0, 0, 0, "")} and len(by[3]) == 2 and len(by[None]) == 1
    assert alignment.align(frame(spark, ODD).limit(0), tokenizers[2]).count() == 0
    nothing = alignment.align(frame(spark, ODD[:2]), tokenizers[2]).collect()
    assert [r["n_links"] for r in nothing] == [0, 0]


# ---------------------------------------------------------------- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]


def plain_contamination(text, items, width=10):
    words = plain_words(text)
    flat = [w for w, *_ in words]
    hit, found = set(), set()
    for item, t in items:
        own = [w for w, *_ in plain_words(t)]
        for k in range(max(1, len(own) - width + 1) if own else 0):
            win = own[k : k + width]
            for i in range(len(flat) - len(win) + 1):
                if flat[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add("" if item is None else str(item))
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return len(flat), len(hit), sorted(found), [(a, b, words[a][1], words[b][2]) for a, b in spans]


def test_contamination(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["the", "Be", "été", "日本", "x9", "o'clock", "re-do", "A", "ŒUVRE", "q"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "...", "_", "  "]) for _ in range(n))

    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 14, 30]))) for k in range(12)] + [(None, text(11)), (20, None), (21, "?!"), (22, ""), (2, text(10)), (100, text(12))]
    texts = [t for _, t, _ in ODD] + [text(rng.randrange(60)) for _ in range(40)]
    for _ in range(40):
        own = rng.choice(items)[1] or ""
        texts.append(text(rng.randrange(5)) + own[rng.randrange(1 + len(own) // 3) :].upper() + text(rng.randrange(5)))
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(7) for c in CLASHING})
    long_items = [(k, t) for k, t in items if len(plain_words(t)) >= 9]
    for own, width in ((items, 10), (long_items, 10), (items, 3)):
        docs = frame(spark, [(k % 70, t, "s") for k, t in enumerate(texts)] + [(0, texts[0], "s")] * 2)
        bench = wanted if own is items else spark.createDataFrame(own, "item_id long, text string")
        want = collections.Counter(repr((k % 70, *plain_contamination(t, own, width))) for k, t in [*enumerate(texts), (0, texts[0]), (0, texts[0])])

        def got():
            rows = decontaminate.contamination(docs, bench, width=width).collect()  # noqa: B023
            return collections.Counter(repr((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), [tuple(s) for s in r["spans"]])) for r in rows)

        assert got() == want
        with monkeypatch.context() as m:  # several automata, whose findings meet
            m.setattr(decontaminate, "AUTOMATON_WINDOWS", 60)
            assert got() == want
    assert any(plain_contamination(t, long_items)[1] for t in texts) and not all(plain_contamination(t, long_items)[1] for t in texts)


def test_contamination_without_items_or_rows(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(docs, none).collect()
    assert len(rows) == len(ODD) and not any(r["n_hit"] or r["items"] for r in rows)
    assert {r["doc_id"]: r["n_words"] for r in rows}[5] == 30000
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    hit = collections.Counter(r["doc_id"] for r in decontaminate.contamination(docs, items).collect() if r["n_hit"] == 3)
    assert hit == {3: 2, 14: 1}


# ---------------------------------------------------------------- filter audit


def plain_audit(rows, labels):
    """rows: (doc_id, text, source); the filters applied one after another in all orders."""
    by_text = collections.defaultdict(list)
    for i, t, _ in rows:
        by_text[t or ""].append(i)
    failing = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(x is not None and x < i for x in by_text[t])
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), smaller)
        failing.append((s or "", {f for f, bad in zip("ABCDE", tests, strict=True) if bad}, any(x == i is not None and q == 1 for x, q, _ in labels), any(x == i is not None and tox == 1 for x, _, tox in labels)))
    out, shares = {}, collections.Counter()
    for part in {s for s, *_ in failing}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in failing if x[0] == part]
            total = list(left)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = sum(f in x[1] for x in total)
                shares[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(x[1] == {f} for x in total), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark):
    rng = random.Random(8)
    many = [" ".join(rng.choice(["a", "b", "Cc", "d" + str(rng.randrange(400)), "e", "f$", "G"][: rng.choice([2, 4, 5, 7])]) for _ in range(rng.choice([5, 199, 200, 260]))) for _ in range(120)]
    many += [" ".join(f"u{k}" for k in range(n)) for n in (199, 200, 201)] + ["A" + "b" * 49, "A" + "b" * 48, "é A" + "b" * 47, "#", "a|b", "a b " * 200]
    rows = ODD + [(100 + k % 97, t, rng.choice(["a", "b", None])) for k, t in enumerate(many)] + [(300 + k, rng.choice(many), "a") for k in range(30)]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 330, 2)] + [(100, 1, 1), (102, None, 1), (None, 1, 1), (104, 0, 0), (104, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(7) for c in CLASHING})
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NUMBERS) for r in filter_audit.audit(frame(spark, rows), table).collect()}
    assert got == plain_audit(rows, labels)


def test_filter_audit_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = frame(spark, ODD)
    assert filter_audit.audit(df.limit(0), none).count() == 0
    rows = filter_audit.audit(df, none).collect()
    assert len(rows) == 4 * 600 and {r["part"] for r in rows} == {"", "a", "b", "c"} and not any(r["good_lost"] or r["toxic_lost"] for r in rows)
    for r in rows:
        assert r["kept"] >= 0 and r["unique_fails"] <= r["removed"]
