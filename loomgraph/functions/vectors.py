"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_to_cosine(d: Column) -> Column:
    """Of unit vectors."""
    return 1 - d * d / 2


def unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    n = norm(a)
    return F.transform(doubles(a), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def concept_hash(v: Column, positive_only: bool = False) -> Column:
    """SHA-256 of the vector's sign bits, most significant first, padded with zeros to whole bytes. A bit is set
    for a component of 0 or more, or above 0 with ``positive_only``."""
    bit = F.transform(doubles(v), lambda x: F.when((x > 0) if positive_only else (x >= 0), "1").otherwise("0"))
    whole = F.rpad(F.array_join(bit, ""), F.ceil(F.size(v) / 8).cast("int") * 8, "0")
    nibbles = F.transform(F.sequence(F.lit(1), F.length(whole), F.lit(4)), lambda i: F.conv(F.substr(whole, i, F.lit(4)), 2, 16))
    return F.sha2(F.unhex(F.array_join(nibbles, "")), 256)
