"""Vector expressions with double accumulation, left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x))


def valid(v: Column, dim: int) -> Column:
    """Of the stated length, every component finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def similarity_exp(d: Column, dim: int) -> Column:
    return F.exp(-d / (dim / 10))


def hashed(text: Column, dimension: int) -> Column:
    """One component, -1 to 1, of an embedding made of hashes: a stand-in where no model is at hand."""
    word = F.substring(F.sha2(F.concat(text, F.lit(f":{dimension}")), 256), 1, 8)
    return F.conv(word, 16, 10).cast("bigint") / F.lit(2147483648.0) - 1
