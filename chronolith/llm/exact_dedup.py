"""Exact duplicates by 128-bit content hash, with the bytes compared inside groups.

The first pass writes digests and counts them; only rows of digests that occur more than once are asked for their text,
combined before the shuffle, so a text that a third of all rows share moves once per task. Up to BROADCAST_ROWS repeated
digests, unique rows never move their text; beyond, finding the repeated ones moves every text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.shared import small, stored


def digest(text: Column) -> Column:
    """128 bits of the text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digests: DataFrame | None = None) -> DataFrame:
    """(digest, text, collided, keep_id, group_size) for every text that occurs more than once.

    collided: another text has the same digest. keep: "min" or "max" id of a class stays. digests: those of docs, if there.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    again = stored((rows if digests is None else digests).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "digests")
    shared = rows.join(small(again), "digest", "left_semi")
    pick = F.max if keep == "max" else F.min
    classes = shared.groupBy("digest", "text").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    texts = classes.groupBy("digest").agg(F.count("*").alias("texts"), F.first("keep_id").alias("k"), F.first("group_size").alias("g"))
    one = texts.filter("texts = 1").select("digest", F.col("k").alias("keep_id"), F.col("g").alias("group_size"))
    more = classes.join(texts.filter("texts > 1").select("digest"), "digest", "left_semi")
    return one.withColumn("text", F.lit(None).cast("string")).withColumn("collided", F.lit(False)).unionByName(more.withColumn("collided", F.lit(True)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null is the empty text and belongs with it. In each class the row with the
    smallest (or, with keep="max", largest) id is kept; of rows that repeat that id, one. A null id is kept only where
    its class has no other id. An empty table gives an empty result; further columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    classes = stored(exact_classes(docs, id_col, text_col, keep, rows), "classes")
    plain = classes.filter("not collided").select("digest", "keep_id", "group_size")
    clash = classes.filter("collided").select("digest", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    n_plain, n_clash = plain.count(), clash.count()
    out = rows.join(small(plain, n_plain), "digest", "left")
    if n_clash:
        late = clash.select("digest", F.col("sha").alias("text_sha256"), F.col("keep_id").alias("k2"), F.col("group_size").alias("g2"))
        out = out.join(small(late, n_clash), ["digest", "text_sha256"], "left").withColumn("keep_id", F.coalesce("k2", "keep_id")).withColumn("group_size", F.coalesce("g2", "group_size"))
    # Of rows that repeat the kept id the first is kept: a sum per text that combines before the shuffle.
    first = out.filter(F.col("group_size").isNotNull() & F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "text_sha256").agg(F.min("row").alias("row"))
    out = out.join(small(first.select("row", F.lit(True).alias("first")), n_plain + n_clash), "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("first").isNotNull()).alias("kept"),
        "text_sha256",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without later copies, all columns kept; the digest deals rows out and the text itself decides.

    One aggregation with a combine step before the shuffle, so a hot class never meets in one task. Null texts count as
    empty; the surviving row keeps its own null or empty text. A null id is kept only where its text has no other; of rows
    that repeat an id one is kept. All columns are kept, whatever their names; an empty table gives an empty result.
    """
    pick = F.max_by if keep == "max" else F.min_by
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    there = F.col(f"`{id_col}`").isNotNull() if keep == "max" else F.col(f"`{id_col}`").isNull()
    number = F.struct(there.alias("there"), F.col(f"`{id_col}`").alias("id"))  # ids of any kind; null ones come last
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.struct(digest(text).alias("digest"), F.coalesce(text, F.lit("")).alias("text"), number.alias("number"), row.alias("row")).alias("all"))
    return keyed.groupBy("all.digest", "all.text").agg(pick("all.row", "all.number").alias("kept_row")).select("kept_row.*")
