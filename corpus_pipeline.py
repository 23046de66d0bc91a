"""A corpus from documents: toxic ones go, copies and near copies go, sources are mixed, sequences are packed.

Every stage works on all rows its predecessor kept, each row by itself: rows that repeat a doc_id or have none are judged
like others. Null texts count as empty. All stages but the last return the columns of documents; further columns, whatever
their names, are carried along. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import exact_dedup, mixing, packing, setsketch, toxicity
from chronolith.llm.common import table
from chronolith.llm.queries import public_tokenizer
from chronolith.shared import bounded_batches, stored

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score reaches THRESHOLD go; the model learns from labelled rows of `docs`.

    Empty and null texts score low and stay; without a label nothing is learned and every row stays.
    """
    bounded_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(F.col("text"), model) < THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, the one with the largest doc_id; null and empty texts are one text, null ids the smallest."""
    return exact_dedup.keep_first_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more stays, the one with the smallest doc_id.

    Rows without words are in no group and stay; null ids are the largest.
    """
    return setsketch.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in the order of its schedule; one row of a source may be cut to the words still
    wanted. Rows without words are not in the mix; null sources are one source.
    """
    return mixing.apply_mix(docs, weights=(5, 2, 1), cap=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place; a row that the mix repeats has pieces for each time."""
    return packing.pack(docs, public_tokenizer(), capacity=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Set sketches, the automaton and the packing order are beyond SQL; tests/llm/test_pipeline.py compares every stage with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
