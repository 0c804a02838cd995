"""How an extracted value compares with what was expected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, similarity

#: Similarity from which a value is a hit, and almost one; keys of which only digits count.
HIT, NEAR = 0.9, 0.75
DIGITS_ONLY = ["phone", "documentNumber", "document_number", "nit"]


def text_similarity(key: Column, expected: Column, got: Column) -> Column:
    only = lambda x: F.regexp_replace(x, "[^0-9]", "")
    return F.when(key.isin(*DIGITS_ONLY), similarity(only(expected), only(got))).otherwise(similarity(fold(expected), fold(got)))


def containment(expected: Column, got: Column) -> Column:
    """1 if one holds the other; 0.92 at least if a word of five letters or more of what was expected stands in it."""
    e, g = fold(expected), fold(got)
    shared = F.exists(F.split(e, " "), lambda w: (F.length(w) >= 5) & F.contains(g, w))
    base = similarity(e, g)
    return F.when((e == "") | (g == ""), F.when((e == "") & (g == ""), 1.0).otherwise(0.0)).when(F.contains(g, e) | F.contains(e, g), 1.0).when(shared, F.greatest(base, F.lit(0.92))).otherwise(base)


def count_ratio(expected: Column, got: Column) -> Column:
    return F.when(expected <= 0, 1.0).otherwise(F.least(F.lit(1.0), got / expected))


def list_similarity(expected: Column, got: Column) -> Column:
    """The mean over what was expected of its best match in what was got; one that holds the other matches."""
    best = lambda e: F.coalesce(F.array_max(F.transform(got, lambda g: containment(e, g))), F.lit(0.0))
    total = F.aggregate(F.transform(expected, best), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(expected) == 0, 1.0).otherwise(total / F.size(expected))


def state(score: Column, got: Column) -> Column:
    return F.when(F.coalesce(F.trim(got), F.lit("")) == "", "vacio").when(score >= HIT, "acierto").when(score >= NEAR, "casi").otherwise("error")
