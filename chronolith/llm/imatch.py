"""I-Match fingerprints, in built-in expressions only.

A term is 56 bits of a lower-cased word's xxhash64. The lexicon are the terms whose document frequency, counted exactly over
all rows, lies in a band of inverse document frequency; a row has a bounded number of distinct terms and a term of the band
needs a fixed share of the rows, so there are some hundred thousand of them at any corpus size. Every task holds the band
as a bit set of 2**23 places (1 MB), and the terms above the band as one of 2**20; a rarer term that shares a place with
one of them is taken for it, the same way in every text.

The lexicon is split at random into cells of different density: level 0 has three quarters of it, each further level a
quarter of what is left, and a level has eight cells. The rarer terms are split alike into levels of their own, which carry
texts with few terms. A fingerprint holds the hash of the sorted distinct lexicon terms of a text, and the hash of the ones
in each cell. Sparse cells of a long text and dense cells of a short one hold a term or two, so some survive an edit of any
size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import SPACE
from chronolith.shared import small, stored

#: Places of the bit sets of band and frequent terms, and the bits of a term.
BAND_PLACES, FREQUENT_PLACES, TERM_BITS = 1 << 23, 1 << 20, 56
LEVELS, RARE_LEVELS, PER_LEVEL = 5, 3, 8
CELLS = (LEVELS + RARE_LEVELS) * PER_LEVEL
CELL_HEX, WHOLE_HEX = 8, 32
#: Rows of one bucket of the document order, about, and the quantiles that the driver cuts the order by; more buckets
#: than that come from dividing the ids between two quantiles evenly.
BUCKET_ROWS, QUANTILES = 4096, 2000
#: Document share of a lexicon term: rarer ones are noise, more frequent ones say nothing.
LEAST_SHARE, MOST_SHARE = 0.001, 0.2


def terms(text: Column) -> Column:
    """Sorted distinct terms of a text."""
    found = F.array_remove(F.split(F.lower(text), SPACE), "")
    return F.sort_array(F.array_distinct(F.transform(found, lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - TERM_BITS))))


def _bit_set(counts: DataFrame, places: int) -> DataFrame:
    """One row, `bits`: an array of places / 64 longs with a bit for each term."""
    words = counts.groupBy(F.shiftright(F.col("term").bitwiseAND(F.lit(places - 1)), 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(term % 64 as int))")).alias("bits"))
    every = counts.sparkSession.range(places // 64, numPartitions=4).select(F.col("id").alias("word"))
    full = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))


def lexicon(docs: DataFrame, text_col: str, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """One row with the bit sets `band` and `frequent`. Counts go over all rows and whole texts."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts = stored(counts.filter(F.col("df") >= max(2.0, least * n)), "terms")
    band, frequent = _bit_set(counts.filter(F.col("df") <= most * n), BAND_PLACES), _bit_set(counts.filter(F.col("df") > most * n), FREQUENT_PLACES)
    return stored(band.select(F.col("bits").alias("band")).join(F.broadcast(frequent.select(F.col("bits").alias("frequent")))), "lexicon")


def _level(bits: int, most: int) -> int:
    level = 0
    while level < most - 1 and bits & 3 == 0:
        level, bits = level + 1, bits >> 2
    return level


#: Level of a term by the low bits of its hash: a quarter of each level's terms goes on to the next. First of lexicon terms,
#: then of rarer ones.
_LEVELS = [_level(b, LEVELS) for b in range(4 ** (LEVELS - 1))] + [LEVELS + _level(b, RARE_LEVELS) for b in range(4 ** (LEVELS - 1))]


def _key(term: Column, rare: int) -> Column:
    """A term behind its level * 8 + cell."""
    h = F.xxhash64(term, F.lit(17))
    half = len(_LEVELS) // 2
    level = F.get(F.array(*[F.lit(x) for x in _LEVELS]), (h.bitwiseAND(F.lit(half - 1)) + rare * half).cast("int"))
    cell = level * PER_LEVEL + F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(PER_LEVEL - 1)).cast("int")
    return cell * F.lit(1 << TERM_BITS) + term


def _has(bits: Column, term: Column, places: int) -> Column:
    return F.getbit(F.get(bits, F.shiftright(term.bitwiseAND(F.lit(places - 1)), 6).cast("int")), (term % 64).cast("int")) == 1


def with_fingerprints(rows: DataFrame, bits: DataFrame, text_cols: dict[str, str]) -> DataFrame:
    """rows plus a fingerprint column for each text column named; {new column: text column}.

    A fingerprint is the hex hash of the whole set of lexicon terms, then one hash per cell, empty cells as dashes. A
    text without lexicon terms has the hash of all its terms, so only texts of the same terms look equal.
    """
    # The lexicon is one row of some 1 MB, read by scalar subqueries.
    view = "imatch_lexicon_" + bits.inputFiles()[0].rsplit("/", 2)[-2].replace("-", "_")
    bits.createOrReplaceTempView(view)
    keep = rows.columns
    for new, text_col in text_cols.items():
        rows = rows.withColumn("ts", terms(F.coalesce(F.col(text_col), F.lit("")))).withColumn("band", F.expr(f"(select band from {view})")).withColumn("frequent", F.expr(f"(select frequent from {view})"))
        kind = lambda t: F.when(_has(F.col("band"), t, BAND_PLACES), _key(t, 0)).when(_has(F.col("frequent"), t, FREQUENT_PLACES), F.lit(-1).cast("long")).otherwise(_key(t, 1))
        rows = rows.withColumn("keys", F.sort_array(F.filter(F.transform("ts", kind), lambda k: k >= 0))).drop("band", "frequent")
        # Terms in cell order, a bar for each step to the next cell: one pass, then cut at the bars.
        place = lambda k: f"cast(shiftright({k}, {TERM_BITS}) as int)"
        joined = F.expr(
            f"""concat(array_join(transform(keys, (k, i) -> concat(
                  repeat('|', {place('k')} - if(i = 0, 0, {place('element_at(keys, greatest(i, 1))')})), ' ', cast(k as string))), ''),
                repeat('|', {CELLS - 1} - if(size(keys) = 0, 0, {place('element_at(keys, greatest(size(keys), 1))')})))"""
        )
        rows = rows.withColumn("cut", F.split(F.when(F.size("keys") > 0, joined).otherwise(F.lit("|" * (CELLS - 1))), r"\|", -1))
        each = F.array_join(F.transform("cut", lambda x: F.when(x == "", F.lit("-" * CELL_HEX)).otherwise(F.substring(F.md5(x.cast("binary")), 1, CELL_HEX))), "")
        # Lexicon terms in their sorted order, which is that of their cells first.
        lexical = F.filter("keys", lambda k: k < LEVELS * PER_LEVEL * (1 << TERM_BITS))
        rows = rows.withColumn("lx", lexical)
        whole = F.md5(F.when(F.size("lx") > 0, F.array_join(F.col("lx").cast("array<string>"), " ")).otherwise(F.concat(F.lit("-"), F.array_join(F.col("ts").cast("array<string>"), " "))).cast("binary"))
        keep = [*keep, new]
        rows = rows.withColumn(new, F.concat(whole, each)).select(*keep)
    return rows


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the best level's share of agreeing cells among those that either text has.

    A level counts with PER_LEVEL / 2 cells at least, so one lucky cell says little.
    """
    none, each = "-" * CELL_HEX, F.sequence(F.lit(0), F.lit(PER_LEVEL - 1))

    def share(level: Column) -> Column:
        cell = lambda x, k: F.substring(x, (level * PER_LEVEL + k) * CELL_HEX + WHOLE_HEX + 1, F.lit(CELL_HEX))
        hits = F.size(F.filter(each, lambda k: (cell(a, k) != none) & (cell(a, k) == cell(b, k))))
        seen = F.size(F.filter(each, lambda k: (cell(a, k) != none) | (cell(b, k) != none)))
        return hits / F.greatest(seen, F.lit(PER_LEVEL // 2))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(LEVELS + RARE_LEVELS - 1)), share))
    return F.when(a == b, F.lit(1.0)).otherwise(best)


def next_rows(rows: DataFrame, id_col: str, carry: list[str], per_bucket: int = BUCKET_ROWS, enrich: Callable[[DataFrame], DataFrame] = lambda x: x, also: tuple[str, ...] = (), quantiles: int = QUANTILES) -> DataFrame:
    """rows plus next_<c> for the carried columns of the next row in descending id order; the last is followed by the first.

    The order is cut into buckets that each meet in one task, by quantiles of the ids and evenly between two quantiles;
    the first row of every bucket is also dealt to the bucket before; `enrich` then adds the columns `also`, once per row.
    So nothing but a row per bucket crosses all of them. Null ids come last. Rows of equal or null id follow each other in
    the order of a digest of the carried columns, by which null ids are dealt over buckets too.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.count("*").alias("n"), F.count(id_col).alias("ids"), F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
    if not seen["n"]:
        return enrich(rows).select("*", *[F.col(c).alias(f"next_{c}") for c in [*carry, *also]])
    cuts = min(max(1, seen["ids"] // per_bucket), quantiles)
    fine = max(1, -(-seen["ids"] // (cuts * per_bucket)))
    bounds = rows.agg(F.percentile_approx(id_col, [k / cuts for k in range(1, cuts)] or [0.5], 10 * cuts + 100).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds) - {seen["low"]})  # range k holds ids from bounds[k - 1] to below bounds[k]
    edges = [seen["low"] or 0, *bounds, (seen["high"] or 0) + 1]
    array = F.array(*[F.lit(int(b)) for b in edges[:-1]])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    # Bisecting by powers of two. A fold names the place so far as its variable; a column for each step would be put into
    # the next one's four places for it by the optimizer, so that a plan grew with a power of the quantiles.
    step = lambda at, by: F.when((at + by < len(edges) - 1) & (F.get(array, at + by) <= F.col(id_col)), at + by).otherwise(at)
    probe = rows.withColumn("at", F.aggregate(steps, F.lit(0), step)).withColumn("turn", F.md5(F.concat_ws("\0", *carry).cast("binary")))
    low, high = F.get(array, F.col("at")), F.get(F.array(*[F.lit(int(b)) for b in edges[1:]]), F.col("at"))
    inside = F.least(F.lit(fine - 1), F.floor((F.col(id_col).cast("double") - low) * fine / (high.cast("double") - low)))
    last = (len(edges) - 1) * fine
    nulls = max(1, -(-(seen["n"] - seen["ids"]) // per_bucket))
    of_null = F.lit(last) + F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") * nulls / 2.0**32)
    bucket = F.when(F.col(id_col).isNull(), of_null).otherwise(F.lit(last - 1) - (F.col("at") * fine + inside)).cast("long")
    dealt = probe.withColumn("bucket", bucket).drop("at")
    heads = stored(dealt.groupBy("bucket").agg(F.max(id_col).alias("head")), "heads")
    # One row of every bucket goes to the bucket before it, and one of the first bucket to the last; a row for each bucket.
    final = heads.agg(F.max("bucket").alias("b")).first()["b"]
    moves = heads.withColumn("to", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.lit(final)))
    ghosts = moves.select(F.col("bucket").alias("of"), "head", "to")
    first = dealt.join(small(ghosts, -(-seen["n"] // per_bucket)), (F.col("bucket") == F.col("of")) & F.col(id_col).eqNullSafe(F.col("head")))
    first = stored(first.groupBy("to").agg(F.min(F.struct("turn", *carry)).alias("g")).select(F.col("to").alias("bucket"), F.col("g").alias("g")), "firsts")
    ghost_rows = first.select(F.lit(None).cast(dict(rows.dtypes)[id_col]).alias(id_col), *[F.col(f"g.{c}").alias(c) for c in ["turn", *carry]], "bucket", F.lit(1).alias("ghost"))
    both = dealt.select(id_col, *carry, "turn", "bucket", F.lit(0).alias("ghost")).unionByName(ghost_rows)
    w = Window.partitionBy("bucket").orderBy("ghost", F.col(id_col).desc_nulls_last(), "turn")
    both = enrich(both)
    for c in [*carry, *also]:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.filter("ghost = 0").drop("bucket", "ghost", "turn")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, fingerprint for every row; null texts count as empty, equal texts have equal fingerprints."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_fingerprints(rows, lexicon(rows, "text"), {"fingerprint": "text"})


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n / share) code points replaced by the first as many (or all) of the next row's.
    A single row is its own next. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = lexicon(rows, "text")
    paired = next_rows(rows, "id", ["text"], enrich=lambda both: with_fingerprints(both, bits, {"fingerprint": "text"}), also=("fingerprint",))
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    paired = paired.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    made = with_fingerprints(paired, bits, {"edited_fingerprint": "edited"})
    return made.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
