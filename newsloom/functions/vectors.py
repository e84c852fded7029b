"""Array-of-float expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null when either has no length."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def l2_normalise(a: Column) -> Column:
    """``a`` scaled to length one; an all-zero vector stays as it is."""
    norm = l2_norm(a)
    divisor = F.when(norm == 0.0, F.lit(1.0)).otherwise(norm)
    # The divisor is bound once as the element of a one-item array.
    scaled = F.transform(F.array(divisor), lambda d: F.transform(a, lambda x: x.cast("double") / d))
    return F.get(scaled, F.lit(0))
