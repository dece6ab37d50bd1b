"""Vector arithmetic in doubles, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(v: Column, q: Column, metric: str) -> Column:
    """l2: one less the squared distance; cosine; ip."""
    if metric == "l2":
        return F.lit(1.0) - F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        return dot(v, q) / F.greatest(norm(v) * norm(q), F.lit(1e-30))
    if metric == "ip":
        return dot(v, q)
    raise ValueError(f"unknown metric: {metric}")


def is_valid(v: Column, dimension: int) -> Column:
    return v.isNotNull() & (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
