"""Array-of-double column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    """Direct differences; the dot-product identity would lose ties to cancellation."""
    return F.sqrt(squared_euclidean(a, b))


def l2_normalise(v: Column, eps: float = 1e-9) -> Column:
    norm = F.greatest(F.sqrt(_sum(F.transform(v, lambda x: x * x))), F.lit(eps))
    return F.transform(v, lambda x: x / norm)


def triplet_hinge(anchor: Column, positive: Column, negative: Column, margin: float) -> Column:
    gap = squared_euclidean(anchor, positive) - squared_euclidean(anchor, negative) + F.lit(float(margin))
    return F.greatest(gap, F.lit(0.0))


def finite_or_null(value: Column) -> Column:
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)
