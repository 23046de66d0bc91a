"""Arithmetic on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.try_divide(dot(a, b), size))


def unit(a: Column) -> Column:
    """a with length 1; a zero vector stays."""
    return _scaled(a, norm(a))


def _scaled(a: Column, by: Column) -> Column:
    """a divided by a number that is found once: a lambda takes it as a value, so it is not worked out for every entry."""
    held = F.transform(F.array(by), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))))
    return F.element_at(held, 1)


def softmax(a: Column) -> Column:
    """Maximum and sum are found once for each array."""
    e = F.element_at(F.transform(F.array(F.array_max(a).cast("double")), lambda m: F.transform(a, lambda x: F.exp(x.cast("double") - m))), 1)
    return F.element_at(F.transform(F.array(e), lambda v: _scaled(v, F.aggregate(v, F.lit(0.0), lambda s, y: s + y))), 1)


def divergence(p: Column, q: Column) -> tuple[Column, Column]:
    """Terms of Jensen-Shannon divergence (nats) and total variation of two aligned probabilities, to be summed."""
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return 0.5 * term(p) + 0.5 * term(q), 0.5 * F.abs(p - q)


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean of the states (arrays of numbers) whose mask is 1; null where none is."""
    kept = F.transform(F.filter(F.zip_with(states, mask, lambda s, m: F.struct(s.alias("s"), m.alias("m"))), lambda x: x["m"] == 1), lambda x: F.transform(x["s"], lambda v: v.cast("double")))
    zero = F.transform(F.element_at(states, 1), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, _scaled(total, F.size(kept).cast("double")))
