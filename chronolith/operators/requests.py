"""Requests to a generating model: what is in range, and the model's time of those that are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolith.functions import timeutil
from chronolith.functions.text import stripped
from chronolith.operators.tokens import Tokenizer, word_ids

# Bounds of a request.
MOST_CHARS, YEARS, NEW_TOKENS, PROMPT_TOKENS = 160, (2008, 2024), (1, 64), (1, 64)


def judged(prompt: Column, date: Column, count: Column, tokenizer: Tokenizer = word_ids) -> tuple[Column, Column]:
    """The reason that a request is refused for, or 'ok', and the normalised time of one that is not.

    date: an ISO date or a bare year; count: new tokens, as text. What is no date or number is an invalid parameter; then the
    prompt, without white space around it, the year and the count have to be in range, and then the prompt's tokens. Beyond
    the years of training the time is extrapolated.
    """
    text, seconds = stripped(F.coalesce(prompt, F.lit(""))), timeutil.parse(date)
    year, many = F.substring(date, 1, 4).try_cast("int"), count.try_cast("int")
    ranged = F.length(text).between(1, MOST_CHARS) & year.between(*YEARS) & many.between(*NEW_TOKENS)
    reason = (
        F.when(seconds.isNull() | year.isNull() | many.isNull(), "invalid parameter").when(~ranged, "out of range")
        .when(~F.size(tokenizer(text)).between(*PROMPT_TOKENS), "prompt tokens").otherwise("ok")
    )
    return reason, F.when(reason == "ok", timeutil.normalized(seconds))
