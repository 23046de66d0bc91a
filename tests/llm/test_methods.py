"""The operators against brute force, and the parts that their methods consist of."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import components, mixing, packing, setsketch, toxicity
from chronolith.llm.common import words
from chronolith.llm.elias_fano import EliasFano
from chronolith.llm.queries import QUERIES, public_tokenizer
from chronolith.llm.sql import ORACLES
from tools.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    said = compare(spark, connect(SF), name, SF)
    assert "equal" in said, said


def test_words_of_buffers():
    col = pa.array(["a B  c", None, "", "é a\tb\x0bc\n", "c", "x"])
    h, at = words(col)
    assert np.diff(at).tolist() == [3, 0, 0, 4, 1, 1]
    h = [tuple(x) for x in h.tolist()]
    assert h[2] == h[6] == h[7] and h[0] == h[4] and h[1] == h[5] and len(set(h)) == 5
    assert [tuple(x) for x in words(col.slice(3, 2))[0].tolist()] == h[3:8]


def near_group(rng, size):
    base = [f"b{rng.randrange(10**6)}" for _ in range(160)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(160)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    texts = near_group(rng, 260) + [" ".join(f"r{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    texts += texts[:20]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, percent, sparse in ((3, 85, 4), (5, 80, 4), (5, 80, 0)):  # with sparse=0 every block is compared as a matrix
        sets = [set(zip(*[w[k:] for k in range(width)], strict=False)) if len(w := t.split()) >= width else {tuple(w)} for t in texts]
        up = list(range(len(texts)))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in itertools.combinations(range(len(texts)), 2):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
        got = {r["doc_id"]: r for r in setsketch.near_duplicates(df, width=width, percent=percent, sparse=sparse).collect()}
        assert all(got[k]["component_id"] == top(k) and got[k]["n_shingles"] == len(sets[k]) for k in range(len(texts)))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    x, y = np.concatenate([a[:600], b]), a
    regs = setsketch.registers(np.concatenate([x, y, np.union1d(x, y)]), np.cumsum([0, 900, 900, 1200]))
    assert (setsketch.merge(regs[0], regs[1]) == regs[2]).all()
    est = setsketch.estimate(regs[:1], regs[1:2], np.array([900.0]), np.array([900.0]))[0]
    assert abs(est - 0.5) < 0.15


@pytest.mark.parametrize("alone", [0, components.ALONE])
def test_components(spark, alone):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(40)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), alone=alone).collect()}
    assert all(got.get(x, x) == top(x) for x in up)
    assert components.components(spark.createDataFrame([], "a long, b long"), alone=alone).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (700, 701), (900, 2**55), (500, 3000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n))
    ef = EliasFano.build(v)
    at = np.arange(len(v))
    assert (ef.access(at) == v).all() and (ef.find(v) == at).all()
    assert (ef.find(np.setdiff1d(np.concatenate([rng.integers(0, top + 9, 300), [top + 5]]), v)) == -1).all()


def test_schedule_keeps_quotas_and_spreads(spark):
    quotas = [500, 250, 0, 249, 1]
    sources = spark.createDataFrame([(k, q, sum(quotas[:k])) for k, q in enumerate(quotas)], "source_no long, quota long, lo long")
    rows = mixing.schedule(sources).collect()
    seen = collections.defaultdict(list)
    for r in rows:
        seen[r["source_no"]].append(r["rank"])
    assert all(sorted(seen[k]) == list(range(1, q + 1)) for k, q in enumerate(quotas)) and len({r["position"] for r in rows}) == 1000
    order = [r["source_no"] for r in sorted(rows, key=lambda r: r["position"])]
    for a in range(0, 900, 50):  # every stretch of 100 slots holds the sources in their shares
        early = collections.Counter(order[a : a + 100])
        assert abs(early[0] - 50) <= 3 and abs(early[1] - 25) <= 3


def test_schedule_of_many_sources(spark):
    rows = mixing.schedule(spark.range(5000).selectExpr("id as source_no", "id % 3 as quota", "(id div 3) * 3 + if(id % 3 = 2, 1, 0) as lo")).collect()
    assert collections.Counter(r["source_no"] for r in rows) == {k: k % 3 for k in range(5000) if k % 3}


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("b", 10), ("a", 10), (None, 1000), ("c", 100), ("d", 0)], "source string, n long")
    got = mixing.source_targets(sizes, (5, 2, 1), 3).orderBy("source_no").collect()
    assert [r["source"] for r in got] == ["a", "b", "c", "d", None]
    # a, b and d are capped at once, then c; the rest is the last source's
    assert [r["target"] for r in got] == [30.0, 30.0, 300.0, 0.0, 760.0] and [r["lo"] for r in got] == [0, 3, 6, 9, 9]
    assert mixing.source_targets(sizes.limit(0), (5, 2, 1), 3).count() == 0


def test_chunked_encoding_equals_whole(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    parts = ["word", " ", "  ", "\n", "\t", "it's", "12", "é", "日本", " ", "　", " ", "🙂", "<|endoftext|>", "don't", "x\n y", "..", "\u0085", "à", "end. "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ["", None]
    enc = packing.Encoder(*public_tokenizer())
    want = [x.ids for x in Tokenizer.from_file(public_tokenizer()[0]).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from what is remembered
        ids, at = enc.rows(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_sum_of_squares_is_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 2049, 4000))[::-1]
    bins, offsets = packing.sum_of_squares(sizes, 2048)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 2048 and len(fill) <= 1.01 * max(sizes.sum() / 2048, (sizes > 1024).sum()) + 2
    assert ((offsets + sizes) <= 2048).all()


def distance(a, b):
    """Edits between two words, a swap of neighbours that stay as they are counting one."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_by_brute_force():
    rng = random.Random(8)
    terms = {"abcab": False, "bcabca": False, "cabba": False, "abbabc": False}
    match = toxicity.Matcher(terms)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 9)))
        near = {t for t in terms if distance(w, t) <= 1}
        got = match(w)
        assert (got is None) == (not near) and (got is None or (got[0] in near and got[1] == (w != got[0])))


def test_two_edits_swaps_and_signs():
    terms = {"slurwordy": False, "abominable": False, "grotesk": True, "scum": False, "vile": True, "idiot": False}
    match = toxicity.Matcher(terms)
    for w, want in {
        "slruwrody": ("slurwordy", 2), "slurwdy": ("slurwordy", 2), "xslurwordyx": ("slurwordy", 2), "lsurowrdy": ("slurwordy", 2), "slurword": ("slurwordy", 1), "abomniabel": ("abominable", 2), "abmnable": ("abominable", 2),
        "grotekslich": ("grotesk", 1), "gortekslich": None, "scmu": ("scum", 1), "csum": ("scum", 1), "scam": None, "vlieness": ("vile", 1), "vilely": ("vile", 0), "sc*m": ("scum", 1), "id1ot": ("idiot", 1), "1diot": ("idiot", 1), "st*r": None,
    }.items():
        assert match(w) == want, w
    hits, n = toxicity.find_hits("You id1ot, *sc*m*! he said $lurwordy 12% a%b idiot99 x", match)
    assert [(t, e) for _, _, t, e, _ in hits] == [("idiot", 1), ("scum", 1), ("slurwordy", 1), ("idiot", 0)] and hits[2][4] and n > 5
    assert toxicity.find_hits("$lurwordy", match)[0][0][:4] == (0, 9, "slurwordy", 1) or toxicity.find_hits("$lurwordy", match)[0][0][:4] == (1, 9, "slurwordy", 1)
    assert toxicity.masked_words("a%%% **b** 2024 x1y") == [(15, 18)][:0] and toxicity.masked_words("(ab1cd)") == [(1, 6)]


def test_edits_by_brute_force_over_long_terms():
    rng = random.Random(5)
    terms = {"".join(rng.choice("abcd") for _ in range(n)): False for n in (8, 9, 11, 5, 6)}
    match = toxicity.Matcher(terms)

    def edits(w, most):
        out = {w: 0}
        for k in range(most):
            for x in [x for x, n in out.items() if n == k]:
                near = [x[:i] + x[i + 1 :] for i in range(len(x))] + [x[:i] + c + x[i:] for i in range(len(x) + 1) for c in "abcdz"]
                near += [x[:i] + c + x[i + 1 :] for i in range(len(x)) for c in "abcdz"] + [x[:i] + x[i + 1] + x[i] + x[i + 2 :] for i in range(len(x) - 1)]
                for y in near:
                    out.setdefault(y, k + 1)
        return out

    for t in terms:
        for w in rng.choices(sorted(edits(t, toxicity.most_edits(len(t)))), k=250):
            n, got = distance(t, w), match(w)
            assert len(w) < 4 or n > toxicity.most_edits(len(t)) or (got is not None and got[1] <= n), (t, w, n)


def test_toxic_and_quoted(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfglmnprt") + rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for k in range(400):
        w = [word() for _ in range(60)]
        bad = k % 5 == 0
        for _ in range(3 if bad else 0):
            w[rng.randrange(60)] = rng.choice(["slurword", "vilename", "grubstem" + word()])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id % 3 <> 0"), labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sum(got[k] == (k % 5 == 0) for k in range(0, 400, 3)) >= 132
    match = toxicity.Matcher(model.terms)
    filler = " ".join(word() for _ in range(20))
    plain, quoted, misspelt = (model.score(t.replace("_", filler), match) for t in ("_ slurword vilename _", '_ he said "slurword vilename" _', "_ slurwrod vilenname slurwor _"))
    assert plain > 0.3 > model.score(filler, match) and quoted < plain and misspelt > 0.3


def test_queries_keep_their_columns(spark):
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert QUERIES["op6_ngram_lm"](spark, SF).columns[0] == "doc_id"


def test_native_plans_run_no_python(spark):
    import contextlib
    import io

    for name in ("op1_url_filter", "op3_chat_format", "op8_imatch", "op10_exact_dedup"):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            QUERIES[name](spark, SF).explain("formatted")
        assert not any(x in out.getvalue() for x in ("Python", "Pandas", "Arrow", "CartesianProduct")), name


def test_toxicity_learns_from_all_rows_within_the_sample(spark):
    """5,000 toxic and 10,000 clean rows are within the sample's bounds, so a term in one of 500 toxic rows is learned."""
    rng = random.Random(7)
    common = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu na pe ri so".split() for b in "ta ne si ro lu wa ke mi po du fa ge zi vo".split()]
    rare = set(range(0, 5000, 500))
    rows = []
    for k in range(15000):
        ws = [rng.choice(common) for _ in range(6)]
        if k in rare:
            ws[3] = "grobnik"
        rows.append((k, " ".join(ws), int(k < 5000)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    match = toxicity.Matcher(model.terms)
    assert match("grobnik") is not None and not any(map(match, common))
