"""Vectors as array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The sum of products; a longer array's rest is left out by the callers' check of sizes."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for arrays of different sizes, for empty ones and where a norm is 0 or not finite; may be negative."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0) & (scale < float("inf")) & ~F.isnan(scale)
    return F.when(fine, dot(a, b) / scale).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values)).cast("array<float>")


def usable(a: Column) -> Column:
    """Not null, not empty, and of finite numbers alone."""
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
