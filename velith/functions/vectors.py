"""Vector arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velith.functions.text import col


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def euclid(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.when(size != 0, size))


def unit_size(v: Column | str) -> Column:
    """What a vector is divided by to be of length 1; a zero vector stays zero."""
    return F.get(F.transform(F.array(norm(v)), lambda x: F.when(x == 0, 1.0).otherwise(x)), F.lit(0))


def distance(a: Column | str, b: Column | str, size_a: Column | None = None, size_b: Column | None = None) -> Column:
    """1 minus the product of unit vectors, whose sizes may be given; a zero vector stays zero."""
    return 1.0 - dot(a, b) / ((unit_size(a) if size_a is None else size_a) * (unit_size(b) if size_b is None else size_b))
