"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from chronolith.llm import chat_format, exact_dedup, imatch, langid, mixing, ngram_lm, packing, setsketch, toxicity, url_filter
from chronolith.llm.queries import public_tokenizer
from chronolith.shared import qualified

LONG = " ".join(f"w{k % 977}" for k in range(30000))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "one two three four five six", None, None), (3, "one two three four five six", None, None), (4, "One TWO three four five six", "de", "b"),
    (5, LONG, "fr", "b"), (6, "\n\t ", "en", ""), (None, "a row without an id but with words", "en", "a"), (7, "Grüße 日本語 ünïcödé 🙂 text", "de", "c"), (8, "x", None, "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("kept", "size", "digest", "id", "comp", "n", "keep_id", "term", "turn", "row", "mixed", "node", "source_no", "position", "taken", "__x", "__id", "__n", "__size", "__toxic", "__d", "__r")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    rows = exact_dedup.exact_dedup(docs, keep="max").collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        by[t or ""].append(i)
    for r in rows:
        same = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(same) and (r["keep_id"] == max((x for x in same if x is not None), default=None))
    assert collections.Counter(r["text_sha256"] for r in rows if r["kept"]) == {hashlib.sha256(k.encode()).hexdigest(): 1 for k in by}
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(docs, keep="min").filter("doc_id <= 2").collect()} == {1}
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first_copies(docs, keep="max")
    assert kept.columns == docs.columns and kept.count() == len(by)


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.lit("00" * 16)))
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df, keep="max").collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}


def test_near_duplicates(docs, empty):
    rows = setsketch.near_duplicates(docs, width=3, percent=85).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert got[4]["component_id"] == 3 and not got[4]["kept"] and got[1]["n_shingles"] == 0 and got[1]["kept"] and got[2]["kept"]
    assert got[8]["n_shingles"] == 1 and got[None]["component_id"] is None and got[None]["kept"]
    assert setsketch.near_duplicates(empty).count() == 0


def test_language(docs, empty, spark):
    model = langid.fit(docs)
    got = {r["doc_id"]: r["p"]["lang"] for r in docs.select("doc_id", langid.predict(F.col("text"), model).alias("p")).collect()}
    assert got[1] == got[2] == got[6] == "und" and got[5] == "fr" and got[8] in {"en", "de", "fr"}
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(empty, docs).count() == 0


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (99, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_language_model(docs, empty):
    model = ngram_lm.fit(docs)
    rows = ngram_lm.score(docs, model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and got[1]["n_tokens"] == got[2]["n_tokens"] == got[6]["n_tokens"] == 1 and got[5]["n_tokens"] == 30001
    assert all(r["n_known"] == r["n_tokens"] for r in rows)
    none = ngram_lm.fit(empty)
    assert {(r["base_score"], r["score"], r["train_tokens"]) for r in ngram_lm.score(docs, none).collect()} == {(0.0, 0.0, 0)}
    assert ngram_lm.score(empty, model).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_no"]] += r["taken"]
        target[r["source_no"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1e-6
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in rows)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert abs(mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] - sum(r["size"] for r in rows)) <= len(target)
    assert mixing.apply_mix(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, public_tokenizer(), capacity=256).collect()
    assert len({r["doc_id"] for r in rows}) == 9 and sum(r["piece"] == 0 for r in rows) == len(ROWS)
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(empty, public_tokenizer()).count() == 0


def test_fingerprints(docs, empty):
    rows = imatch.edited_likeness(docs).collect()
    assert len(rows) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = collections.Counter()
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 3}) == 1 and all(0 <= r["near_edited"] <= 1 for r in rows)
    assert imatch.edited_likeness(empty).count() == 0
    assert imatch.edited_likeness(docs.filter("doc_id = 5")).first()["n_chars"] == len(LONG)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.Example.ORG/es/x?y#z", "x://org/", "x://org", "http://example.org:80/es/", "http://a.com/fr/1", "http://a.com/de/1", "http://a.com/de/1", "http://q.org?a/b", "ftp://e/" + "p/" * 5000]
    pages = spark.createDataFrame([(k % 12, u, "h") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = url_filter.rule_table(spark, [("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/"), ("block", "com/de/")])
    got = {(r["host"], r["path"][:9]): (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got[("a.b.example.org", "/es/x")] == ("example.org/es/", "block") and got[("org", "/")] == ("org/", "allow") and got[("org", "")] == (None, "allow")
    assert got[("example.org:80", "/es/")] == (None, "allow") and got[("a.com", "/de/1")] == ("com/de/", "block") and got[("q.org", "")] == (None, "allow") and got[("", "")] == (None, "allow")
    assert url_filter.judge_urls(pages, rules).count() == len(urls) and url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\n", "<|im_start|>user\nhi<|im_end|>\n", "<\\s>", "a\\<|im_sep|>b", "", None, "<<s>", "<|im_<|im_sep|>sep|>", LONG]
    rows = [(1, k, ("user", "assistant")[k // 2 % 2], t) for k, t in enumerate(nasty)] + [(2, 0, None, None), (2, 0, "ro\nle\\n<s>", "x"), (2, None, "assistant", "first"), (None, 1, "user", "no id"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1))
    made = chat_format.format_conversations(df).withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.under_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in made.collect()}
    assert [(x["role"], x["text"]) for x in got[1]["back"]] == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    assert got[1]["loss"] == "".join(t or "" for _, _, r, t in rows[: len(nasty)] if r == "assistant")
    assert [(x["role"], x["text"]) for x in got[2]["back"]] == [("assistant", "first"), ("", ""), ("", ""), ("ro\nle\\n<s>", "x")]
    assert got[1]["formatted"].count("<|im_sep|>") == 5 and got[1]["formatted"].count("[INST]") == 0
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_copies_with_string_ids(spark):
    rows = [("b", "x"), ("a", "x"), (None, "x"), (None, "y"), (None, None), ("c", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("number", F.lit(1))
    for keep, want in (("max", "b"), ("min", "a")):
        kept = exact_dedup.keep_first_copies(df, keep=keep)
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([(want, "x"), ("None", "y"), ("c", "")]) and kept.columns == df.columns


def test_paths_without_a_scheme_are_not_taken_for_a_disk(spark, tmp_path):
    """With a default file system that is a store, /x lies there, and level files are not looked for on a worker's disk."""
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.kept.link./shared", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://kept/")
    try:
        assert qualified(spark, "/shared/x") == "viewfs://kept/shared/x"
        assert ngram_lm.Files(qualified(spark, "/shared/x")).local is None
    finally:
        conf.set("fs.defaultFS", before)
    assert ngram_lm.Files(qualified(spark, f"{tmp_path}/x")).local == f"{tmp_path}/x"


def test_long_urls_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("chronolith.shared.BROADCAST_BYTES", 2000)
    rules = url_filter.rule_table(spark, [("block", "a.org/x")])
    urls = [(k, f"http://a.org/x{'y' * 500}{k}") for k in range(20)] + [(99, "http://b.org/")]
    out = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules)
    assert {r["page_id"]: r["verdict"] for r in out.collect()} == {k: "block" if k < 99 else "allow" for k, _ in urls}
