"""Scalar confidence maps."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_confidence(distance: Column, threshold: Column) -> Column:
    """1 - d/t clipped to [0, 1]; a vanishing threshold only trusts a vanishing distance."""
    return F.when(
        threshold <= 1e-12, F.when(distance <= 1e-12, F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - distance / threshold)))


def support_reliability(support: Column, prior: float) -> Column:
    if prior < 0:
        raise ValueError("sample_count_prior must be >= 0")
    return support.cast("double") / (support.cast("double") + F.lit(float(prior)))


def neighbour_confidence(distance: Column, scale: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-distance / F.greatest(scale, F.lit(1e-12)))))


def alignment_confidence(bitscore: Column, evalue: Column, offset: float = 50.0) -> Column:
    """bits/(bits+offset), else 1/(1+e), else 0."""
    bits, e = bitscore.cast("double"), evalue.cast("double")
    floor = F.lit(max(float(offset), 1e-9))
    return (
        F.when(~F.isnan(bits) & (bits > 0), bits / (bits + floor))
        .when(~F.isnan(e) & (e >= 0), 1.0 / (1.0 + e))
        .otherwise(F.lit(0.0))
    )
