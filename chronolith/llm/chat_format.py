r"""Conversations as one marked string each, and back again, in Spark expressions only.

Turn:   <|im_start|>ROLE\nTEXT<|im_end|>\n     adjacent turns of one role share a turn, their texts parted by <|im_sep|>.
Escape: a backslash is doubled; a control string gets a backslash after its first character, so that none of them is
left inside a text. Line ends in a role become \n. All of it is undone by unescape().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose lengths are summed together.
BLOCK = 256
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The marks of this template and of other common ones, all of which are escaped inside texts.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\[](){}|^$.*+?" else c for c in s)


_FOUND = "|".join([r"(\\)", *(f"({_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROL)])
_ESCAPED = "|".join([r"(\\)\\", *(f"({_quoted(c[0])})\\\\(?={_quoted(c[1:])})" for c in CONTROL)])
_GROUPS = "".join(f"${k}" for k in range(1, len(CONTROL) + 2))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _FOUND, _GROUPS + r"\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, _GROUPS)


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    # A doubled backslash is taken first, so a literal backslash before an n survives.
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda part: F.replace(unescape(part), F.lit("\\n"), F.lit("\n"))), "\\")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation.

    Turns are sorted by (turn, role, text), nulls first; null texts and roles count as empty; repeated rows stay. The
    spans (start, length in code points) cover the escaped texts of loss_role, one per input row, and no mark.
    A conversation is one output row, so its turns meet in one task; a combine step gathers them before the shuffle.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Turns of a role that follow each other are a slice of the array, from one change of role to the next.
    opens = sorted_.withColumn("opens", F.expr("filter(sequence(0, size(ts) - 1), i -> i = 0 or ts[i].role <> ts[i - 1].role)"))
    merged = F.expr(
        """transform(opens, (at, k) -> named_struct('role', ts[at].role,
             'texts', transform(slice(ts, at + 1, coalesce(get(opens, k + 1), size(ts)) - at), t -> t.text)))"""
    )
    safe = F.transform(merged, lambda m: F.struct(m["role"].alias("role"), _escape_role(m["role"]).alias("shown"), F.transform(m["texts"], escape).alias("texts")))
    base = opens.select("conv_id", safe.alias("ms"))
    whole = F.array_join(F.transform("ms", lambda m: F.concat(F.lit(START), m["shown"], F.lit("\n"), F.array_join(m["texts"], SEP), F.lit(END + "\n"))), "")
    role = loss_role.replace("'", "''")
    # Lengths of whole turns, summed by blocks of BLOCK and over blocks, so that no array grows turn by turn.
    size = F.transform("ms", lambda m: F.lit(len(START) + 1 + len(END) + 1).cast("long") + F.length(m["shown"]) + F.aggregate(m["texts"], F.lit(0).cast("long"), lambda a, x: a + F.length(x) + len(SEP)) - len(SEP))
    base = base.select("conv_id", "ms", whole.alias("formatted"), size.alias("sizes"))
    base = base.withColumn("sums", F.expr(f"transform(sequence(0, (size(sizes) - 1) div {BLOCK}), b -> aggregate(slice(sizes, b * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + x))"))
    base = base.withColumn("before", F.expr("aggregate(sums, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"))
    spans = F.expr(
        f"""flatten(transform(ms, (m, i) -> if(m.role <> '{role}', array(),
              aggregate(m.texts, named_struct('out', cast(array() as array<struct<start:bigint,length:bigint>>), 'at',
                  before[i div {BLOCK}] + aggregate(slice(sizes, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0L, (a, x) -> a + x) + {len(START)} + length(m.shown) + 1),
                (a, x) -> named_struct('out', concat(a.out, array(named_struct('start', a.at, 'length', cast(length(x) as bigint)))), 'at', a.at + length(x) + {len(SEP)}),
                a -> a.out))))"""
    )
    return base.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: every input row again, in order."""
    parts = F.filter(F.split(formatted, _quoted(START), -1), lambda p: p != "")
    one = lambda p: F.transform(
        F.split(F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END) - 1), _quoted(SEP), -1),
        lambda x: F.struct(_unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(x).alias("text")),
    )
    return F.flatten(F.transform(parts, one))


def under_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between its spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
