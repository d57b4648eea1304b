"""Scalar functions over text, numbers and scores; all are built-in expressions that stay in generated code."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: White space, ASCII punctuation and ASCII digits.
SEPARATORS = r"[\x09-\x0d\x20-\x40\x5b-\x60\x7b-\x7e]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def lower(c: Column) -> Column:
    """ASCII letters in lower case; others stay as they are."""
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """Maximal runs of characters that aren't separators, in lower case. A null text has null tokens, an empty one none."""
    return F.filter(F.split(lower(c), SEPARATORS), lambda x: x != "")


def without(words: Column, stopwords: list[str]) -> Column:
    """words but for stopwords; order and repeats stay."""
    return F.filter(words, lambda x: ~x.isin(stopwords)) if stopwords else words


def punctuation_to_blank(c: Column) -> Column:
    return F.regexp_replace(lower(c), PUNCTUATION, " ")


def drop_stopwords(c: Column, stopwords: list[str]) -> Column:
    """Words between blanks that aren't stopwords, a blank after each."""
    return F.array_join(F.transform(without(F.filter(F.split(c, " +"), lambda x: x != ""), stopwords), lambda x: F.concat(x, F.lit(" "))), "")


def digits_to_blank(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", " ")


def cleanup(c: Column, stopwords: list[str]) -> Column:
    """Punctuation, then stopwords, then digits; so "m5" is no stopword and ends as "m "."""
    return digits_to_blank(drop_stopwords(punctuation_to_blank(c), stopwords))


def is_number(c: Column) -> Column:
    """Whether the whole of c is a JSON number."""
    return c.rlike(NUMBER)


def djb2(c: Column) -> Column:
    """hash * 33 + byte over the bytes of UTF-8 as signed numbers, from 5381, modulo 2**32."""
    coded, n = F.hex(F.encode(c, "UTF-8")), F.octet_length(c)
    number = lambda i: F.conv(F.substr(coded, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    signed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: number(i) - F.when(number(i) > 127, 256).otherwise(0))
    return F.when(n == 0, F.lit(5381).cast("long")).otherwise(F.aggregate(signed, F.lit(5381).cast("long"), lambda h, x: F.pmod(h * 33 + x, F.lit(1 << 32))))


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def log_loss(p: Column, y: Column, least: float = 1e-15) -> Column:
    """-ln of the probability given to the label y (0 or 1), which is held off 0 by `least`."""
    return -F.ln(F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(least)))
