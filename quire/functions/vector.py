"""Functions of vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length of the two."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays. The norm is worked out once: a fold over one pair of it and the vector."""
    both = F.array(F.struct(norm(v).alias("n"), doubles(v).alias("v")))
    return F.get(F.transform(both, lambda b: F.when(b["n"] == 0, b["v"]).otherwise(F.transform(b["v"], lambda x: x / b["n"]))), F.lit(0))


def parse_embedding(c: Column) -> Column:
    return F.from_json(c, "array<double>")
