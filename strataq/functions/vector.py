"""Vector distances as column expressions (smaller is nearer)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; a zero vector is similar to nothing (0)."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "euclidean":
        return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "dot":
        return -dot(a, b)
    if metric == "manhattan":
        return _sum(a, b, lambda x, y: F.abs(x - y))
    raise ValueError(metric)
