"""The queries of this package: each reads its whole table through its operator and keeps the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import alignment, chat_format, decontaminate, exact_dedup, filter_audit, imatch, langid, mixing, ngram_lm, packing, setsketch, toxicity, url_filter
from chronolith.llm.common import crc_mod, table
from chronolith.shared import bounded_batches

#: Fixed rules of the url query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.filter(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), langid.predict(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))
    extra = spark.range(1, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(turns).alias("turn"))
    extra = extra.select("conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat_format.format_conversations(rows.unionByName(extra))
    made = made.withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.under_loss(F.col("formatted"), F.col("loss_spans")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_mod(F.col("doc_id"), 4) != 2))
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), toxicity.score_column(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    model = ngram_lm.fit(docs.filter(~held_out))
    return ngram_lm.score(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3).drop("source_no")


def public_tokenizer() -> tuple[str, str, str]:
    """Paths of the public byte-level vocabulary, as JSON and as ranks, and its pre-splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizer(), capacity=2048, end_id=0)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), (*public_tokenizer()[1:], public_tokenizers.path("piece_bpe_32k.model")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_langid": op2_langid,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_setsketch": op5_setsketch,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_mixing": op7_mixing,
    "op8_imatch": op8_imatch,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_alignment": op11_alignment,
    "op12_decontamination": op12_decontamination,
    "op13_filter_audit": op13_filter_audit,
}
