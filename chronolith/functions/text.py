"""Text functions as column expressions; Python only where Unicode tables are needed."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronolith.functions import patterns as P

#: White space that both this library and its SQL treat as such.
BLANKS = " \t\n\r\x0b\x0c"


@F.arrow_udf(StringType())
def unescape_nfc(col: pa.Array) -> pa.Array:
    """HTML entities undone twice (an ampersand may itself be escaped), then Unicode NFC."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", html.unescape(html.unescape(t))) for t in col.to_pylist()], pa.string())


def drop_images(c: Column) -> Column:
    """Alt texts stay, images, their URLs and placeholders go."""
    c = F.regexp_replace(c, r"(?i)!\[(?:img|image|gif)?\]\([^)]*\)", "")
    c = F.regexp_replace(c, P.MARKDOWN_IMAGE, "$1")
    for pattern in (P.HTML_IMAGE, P.IMAGE_URL, P.IMAGE_PLACEHOLDER):
        c = F.regexp_replace(c, pattern, "")
    return c


def drop_controls(c: Column) -> Column:
    """Control and format characters go, but for line ends, tabs and the joiner of emoji."""
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\n\t\x{200D}]]", "")


def tidy_lines(c: Column) -> Column:
    """Runs of blanks become one, lines are trimmed, empty lines go."""
    lines = F.transform(F.split(c, "[\n  ]"), lambda x: F.btrim(F.regexp_replace(x, r"(?U)[^\S\n]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize(c: Column) -> Column:
    """The whole normal form of a raw text; null is empty."""
    return tidy_lines(drop_controls(drop_images(unescape_nfc(F.coalesce(c, F.lit(""))))))


def document(kind: Column, title: Column, selftext: Column, body: Column) -> Column:
    """A comment's body, or a submission's title and text, whichever are present; all are normalised first."""
    text = F.when(F.lower(selftext).isin(*P.REMOVED), "").otherwise(F.coalesce(selftext, F.lit("")))
    title = F.coalesce(title, F.lit(""))
    both = F.when((title != "") & (text != ""), F.concat(title, F.lit("\n"), text)).when(title != "", title).otherwise(text)
    return F.when(kind == "comments", F.coalesce(body, F.lit(""))).otherwise(both)


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    """Runs of visible characters."""
    return F.regexp_extract_all(c, F.lit(r"([^\x20\x09-\x0D]+)"), 1)


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def folded(c: Column) -> Column:
    """Lower-cased, white space runs as single blanks."""
    return F.array_join(tokens(F.lower(c)), " ")


def canonical(c: Column) -> Column:
    """Lower-cased, all but letters, digits and the underscore as single blanks."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def url_dominated(c: Column) -> Column:
    """A text with a link in which nothing but links and punctuation is left, or less than a fifth of 30 characters and more."""
    left = F.btrim(F.regexp_replace(c, P.URL, ""), F.lit(P.AROUND_LINKS))
    return c.rlike(P.URL) & ((F.length(left) == 0) | ((F.length(c) >= 30) & (F.length(left) / F.length(c) < 0.2)))


def mark_share(c: Column) -> Column:
    """Share of combining marks among the characters; 0 for an empty text."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, r"[^\p{Mn}]", "")), F.length(c)), F.lit(0.0))


def top_word_share(c: Column) -> Column:
    """Share of the most frequent word, 0 for texts under eight words; one pass over the sorted words."""
    ws = F.sort_array(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_']+)"), 1))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("n"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(w == a["word"], a["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(a["most"], run).alias("most"), (a["n"] + 1).alias("n"))

    return F.aggregate(ws, start, step, lambda a: F.when(a["n"] >= 8, a["most"] / a["n"]).otherwise(0.0))


def first_line(c: Column) -> Column:
    return F.coalesce(F.substring_index(c, "\n", 1), F.lit(""))


def phrase_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z']*)"), 1)


def runs(ws: Column, size: int) -> Column:
    """All runs of `size` neighbouring words, joined by blanks: the array zipped with itself, shifted."""
    out = ws
    for k in range(1, size):
        rest = F.slice(ws, F.lit(k + 1), F.greatest(F.size(ws) - k, F.lit(0)))
        out = F.zip_with(out, rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(out, F.lit(1), F.greatest(F.size(ws) - (size - 1), F.lit(0)))


def word_grams(c: Column) -> Column:
    """Words of two and more letters, digits or underscores, lower-cased, and their neighbouring pairs."""
    ws = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    return F.concat(ws, runs(ws, 2))


def phrases(ws: Column, first: int = 4, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Array of (phrase, start) for all word n-grams from word index `first` on, without filters."""
    made = [F.filter(F.transform(runs(ws, n), lambda p, i: F.struct(p.alias("phrase"), i.alias("start"))), lambda x: x["start"] >= first) for n in sizes]
    return F.concat(*made)


def marked(board: Column, text: Column) -> Column:
    """The board's mark in front of a text, as the tokenizer's input has it."""
    return F.concat(F.lit("<|subreddit_"), board, F.lit("|> "), text)


def after_mark(c: Column, mark: str = "<|endoftext|>") -> Column:
    """The text behind the first mark, or up to the second."""
    return F.split_part(c, F.lit(mark), F.lit(2))


def hash_number(c: Column) -> Column:
    """A stable number from 0 to 2**32 - 1 of a string, the same in other engines."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")
