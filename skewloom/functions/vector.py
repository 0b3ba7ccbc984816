"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """To length 1; the zero vector stays."""
    return bound(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """Mean 0 and (population) variance 1 over the entries."""
    size = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / size
    centred = bound(mean, lambda m: F.transform(a, lambda x: x - m))
    return bound(centred, lambda c: bound(F.sqrt(dot(c, c) / size + eps), lambda d: F.transform(c, lambda x: x / d)))
