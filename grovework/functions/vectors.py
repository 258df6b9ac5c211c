"""Vector functions over array columns, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """v with length one; a zero vector stays zero, so its cosines are 0."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def letter_histogram(text: Column) -> Column:
    """Counts of a..z in the lower-cased text: the embedder without a model."""
    count = lambda low, c: (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double")
    # a lambda's variable: lower() is slow and would be repeated for each letter
    return F.get(F.transform(F.array(F.lower(text)), lambda low: F.array(*(count(low, c) for c in LETTERS))), F.lit(0))
