"""Source mixing on a low-discrepancy schedule of equal blocks.

Every source is a stream of its documents in a shuffled (hashed) order, cut into blocks of equal words. Slots of the
schedule take golden-ratio points; the cumulative quotas turn a point into a source; the k-th slot of a source takes the
k-th block of its stream, which begins again at its end. The slot is the place in the mixed corpus, so that any stretch of
it holds the sources in the shares of their targets. Sources, streams and slots are tables: running sums form inside
ranges and over range totals, so neither many sources nor one large source meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import NOT_SPACE
from chronolith.operators.prefix import running_before
from chronolith.shared import fresh_name, scratch, small, stored

GOLDEN = 0x9E3779B97F4A7C15  # 2**64 / golden ratio
BLOCK_WORDS = 512
SLOT_CHUNK = 16384
#: Neighbouring cells of the cumulative quotas that are looked up together, and the larger pieces that these come from.
CELLS, PIECE = 64, 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int, block: int = BLOCK_WORDS) -> DataFrame:
    """source, source_no, source_size, target, blocks, quota, last_words, lo of (source, n): all sizes shared by weight.

    Sources in code point order, null last, take the weights in turn. No target is above cap times its source's size: the
    excess is shared again among the others by weight. The smaller a source is for its weight, the earlier it is capped;
    so one pass over that order, with what is left before each source, finds who is. Whole numbers decide; the one
    division comes last. quota: blocks that the source gives; lo: quotas of all sources before it.
    """
    turns = F.array(*[F.lit(int(w)) for w in weights])
    named = sizes.select("source", F.col("source").isNull().alias("none"), "n", F.lit(1).cast("long").alias("one"))
    named = running_before(named, ["none", "source"], "one", "source_no")
    named = named.withColumn("w", F.element_at(turns, (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
    named = named.select("source", "source_no", "n", "w", (F.col("n") / F.col("w")).alias("ratio"), (F.col("n") * cap).alias("most"))
    whole = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    asked = running_before(named, ["ratio", "source_no"], {"given": "most", "gone": "w"})
    asked = asked.withColumn("rest", F.lit(whole["n"]) - F.col("given")).withColumn("open", F.lit(whole["w"]) - F.col("gone"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    asked = asked.withColumn("over", big("rest") * F.col("w").cast("decimal(9,0)") > big("most") * F.col("open").cast("decimal(18,0)"))
    last = asked.filter("not over").agg(F.max("rest").alias("rest"), F.max("open").alias("open")).first()
    share = (F.lit(last["rest"] or 0) * F.col("w")).cast("double") / F.lit(float(last["open"] or 1))
    made = asked.withColumn("target", F.when(F.col("over"), F.col("most").cast("double")).otherwise(share))
    words, n = F.floor(F.col("target") + 0.5), F.greatest(F.col("n"), F.lit(1))
    made = made.withColumn("words", words).withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.lit(1))).withColumn("part", F.col("words") % n)
    quota = F.when(F.col("n") > 0, F.expr("words div n") * F.col("blocks") + F.ceil(F.col("part") / block)).otherwise(F.lit(0))
    made = made.select("source", "source_no", F.col("n").alias("source_size"), "target", "blocks", quota.cast("long").alias("quota"), (F.col("part") % block).alias("last_words"))
    return stored(running_before(made, ["source_no"], "quota", "lo"), "sources")


def schedule(sources: DataFrame) -> DataFrame:
    """(position, source_no, rank): rank 1..quota of every source (source_no, quota, lo), spread evenly over the positions.

    Slots beyond a quota give way; ranks that the points have not reached by the last slot follow at the end.
    """
    spark = sources.sparkSession
    seen = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    total, many = int(seen["total"]), int(seen["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.asarray(batch.column("id"))
            with np.errstate(over="ignore"):
                point = ((slot.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.floor(point * total).astype(np.int64))], names=["slot", "cell"])

    # Every cell of [0, total) belongs to one source; neighbouring cells are looked up together.
    spans = sources.filter("quota > 0").select("source_no", "lo", (F.col("lo") + F.col("quota")).alias("hi"))
    spans = spans.withColumn("piece", F.explode(F.expr(f"sequence(lo div {PIECE}, (hi - 1) div {PIECE})"))).repartition("piece")
    spans = spans.withColumn("group", F.explode(F.expr(f"sequence(greatest(lo, piece * {PIECE}) div {CELLS}, (least(hi, (piece + 1) * {PIECE}) - 1) div {CELLS})"))).drop("piece")
    spans = stored(spans, "spans", total)
    slots = spark.range(total).mapInArrow(run, "slot bigint, cell bigint").withColumn("group", F.expr(f"cell div {CELLS}"))
    slots = slots.join(small(spans), "group").filter("lo <= cell and cell < hi").select("slot", "source_no", F.expr(f"slot div {SLOT_CHUNK}").alias("chunk"))
    counts = stored(slots.groupBy("source_no", "chunk").agg(F.count("*").alias("n")), "slots", total)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source_no", "chunk", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot"))
    ranked = slots.withColumn("inside", inside).join(starts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("before") + F.col("inside")).alias("rank"))
    quota = sources.select("source_no", "quota")
    kept = ranked.join(small(quota, many), "source_no").filter("rank <= quota").select(F.col("slot").alias("position"), "source_no", "rank")
    reached = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    short = quota.join(reached, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
    late = short.select("source_no", F.explode(F.expr("sequence(got + 1, quota)")).alias("rank")).select((F.col("rank") * F.lit(many) + F.col("source_no") + F.lit(total)).alias("position"), "source_no", "rank")
    return kept.unionByName(late)


def _plan(rows: DataFrame, weights: Sequence[int], cap: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, source, size, ...) with source_no, source_size, target, blocks, at, taken, first_position; and the schedule."""
    turn = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(str(seed))).cast("binary"))
    rows = stored(rows.withColumn("turn", turn), "sizes")
    n = rows.count()
    carry = rows.columns
    sources = source_targets(stored(rows.groupBy("source").agg(F.sum("size").alias("n")), "totals"), weights, cap, block)
    many = sources.count()
    facts = sources.select(F.col("source").alias("of"), "source_no", "source_size", "target", "blocks")
    named = rows.join(small(facts, many), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = stored(running_before(named, ["turn", "id", "size"], "size", "at", ["source_no"]), "placed", n)

    # What the schedule takes of each block; the last slot of a source may take the first words only.
    slots = stored(schedule(sources), "schedule", n)
    cut = (F.col("rank") == F.col("quota")) & (F.col("last_words") > 0)
    takes = slots.join(small(sources.select("source_no", F.col("blocks").alias("round"), "quota", "last_words"), many), "source_no").withColumn("block", F.pmod(F.col("rank") - 1, F.col("round")))
    takes = takes.groupBy("source_no", "block").agg(F.sum(F.when(cut, 0).otherwise(1)).alias("full"), F.max(F.when(cut, F.col("last_words")).otherwise(0)).alias("part"), F.min("position").alias("position"))

    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.withColumn("begin", begin).withColumn("words", end - begin).join(takes, ["source_no", "block"], "left")
    of_part = F.greatest(F.lit(0), F.least(F.col("words"), F.coalesce("part", F.lit(0)) + F.col("block") * block - F.col("begin")))
    pieces = pieces.withColumn("took", F.coalesce("full", F.lit(0)) * F.col("words") + of_part)
    keys = [*carry, "source_no", "source_size", "target", "blocks", "at"]
    summed = pieces.groupBy(*keys).agg(F.sum("took").cast("long").alias("taken"), F.min(F.when(F.col("took") > 0, F.col("position"))).alias("first_position"))
    none = placed.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_position"))
    return summed.unionByName(none), slots


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, block: int = BLOCK_WORDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken, first_position, source_no for every row of docs.

    size: words of the text, null 0. taken: words of the row that the schedule's blocks hold, repeats counted; a source's
    taken words are its target, rounded to a whole word. first_position: the slot that holds the row's first words, null
    where nothing is taken. A row is taken at most `cap` times its size. Null sources are one source, the last. Ties in the
    shuffled order fall to id and size; rows without words take part with nothing; rows of equal id and size may be told
    apart only by their place in the stream. An empty table gives an empty result. Reruns agree.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # Rows that are alike in all of it are told apart by a number, so that each is summed by itself.
    made, _ = _plan(rows.withColumn("row", F.monotonically_increasing_id()), weights, cap, block, seed)
    return made.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_position", "source_no")


def apply_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, block: int = BLOCK_WORDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them, in the order of the schedule: whole rows as often as taken, and the first words of a row
    that is taken in part.

    A row cut short has its remaining words parted by single blanks. Every row counts by itself, also where ids repeat or
    are null; rows without words are not in the mix. All columns are kept, whatever their names.
    """
    row = fresh_name("row", docs.columns)
    info = fresh_name("mixed", docs.columns, [row])
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    text = F.col(f"`{text_col}`")
    rows = keyed.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"))
    with scratch(docs.sparkSession):
        made, slots = _plan(rows, weights, cap, block, seed)
        copies = made.filter("taken > 0").withColumn("copy", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
        copies = copies.withColumn("rank", F.expr(f"at div {block} + 1 + copy * blocks")).withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
        dealt = stored(copies.join(slots, ["source_no", "rank"]).select(F.col("row").alias(row), F.struct("position", "at", "words", "size").alias(info)), "copies", keep=True)
    out = keyed.join(small(dealt), row)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({NOT_SPACE})"), 1), F.lit(1), F.col(f"{info}.words").cast("int")), " ")
    order = [F.col(f"{info}.position"), F.col(f"{info}.at")]
    out = out.withColumn(text_col, F.when(F.col(f"{info}.words") == F.col(f"{info}.size"), text).otherwise(cut))
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*[f"`{c}`" for c in docs.columns])
