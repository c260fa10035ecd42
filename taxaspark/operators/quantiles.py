"""Exact quantiles by histogram refinement.

A group's values are never gathered: each pass counts them in bins and narrows the bracket to
the bin that holds the wanted order statistic, so a pass returns at most ``BINS`` rows a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024
SMALL_GROUP = 100_000  # below this the built-in exact percentile holds a group in memory

Key = tuple
Bracket = tuple[float, float]
Histogram = Callable[[dict[Key, Bracket]], dict[Key, list[tuple[int, int, float, float]]]]


def refine_quantile(extents: dict[Key, tuple[float, float, int]], prob: float, histogram: Histogram) -> dict[Key, float]:
    """Quantile of each key, interpolated between order statistics.

    ``extents`` gives (min, max, count); ``histogram`` maps brackets to (bin, count, min, max)
    rows of the values inside them. Brackets always end on data values, so no value is lost
    between passes.
    """
    wanted: dict[Key, tuple[int, float]] = {}
    brackets: dict[Key, tuple[float, float, int]] = {}  # low, high, values below low
    result: dict[Key, float] = {}
    for key, (low, high, n) in extents.items():
        place = (n - 1) * prob
        first = min(math.floor(place), n - 1)
        wanted[key] = (first, place - first)
        brackets[key] = (low, high, 0)
        if low == high:
            result[key] = low
    while open_keys := {k: b for k, b in brackets.items() if k not in result}:
        found = histogram({k: (b[0], b[1]) for k, b in open_keys.items()})
        for key, (_, _, below) in open_keys.items():
            first, share = wanted[key]
            rows = sorted(found[key])
            value, narrowed = _locate(rows, first, below)
            if value is None:
                brackets[key] = narrowed
                continue
            if share > 0:
                upper, narrowed = _locate(rows, first + 1, below)
                if upper is None:
                    # first is the last of its bin, so first + 1 starts the next one
                    upper = narrowed[0]
                value += (upper - value) * share
            result[key] = value
    return result


def _locate(rows, place: int, below: int):
    """(value, None) if the order statistic is a bin's end point, else (None, narrower bracket)."""
    for i, (_, count, low, high) in enumerate(rows):
        if place < below + count:
            if low == high or place == below + count - 1:
                return high, None
            if place == below and (count == 1):
                return low, None
            return None, (low, high, below)
        below += count
    raise ValueError("order statistic outside the histogram")


def bin_of(value, low, high):
    """Bin number, monotone in ``value``; works on columns and on floats alike."""
    return F.least(F.lit(BINS - 1), F.floor((value - low) / (high - low) * BINS)).cast("int")


def exact_quantile(df: DataFrame, keys: list[str], value: str, prob: float, name: str = "quantile", weight: str | None = None) -> DataFrame:
    """``prob`` quantile of ``value`` per ``keys`` (linear interpolation, nulls ignored).

    A row with a ``weight``, a whole number above zero, counts so many times.

    Small groups use the built-in exact percentile, which holds a group's values; beyond
    ``SMALL_GROUP`` rows the same number comes from histogram passes.
    """
    spark = df.sparkSession
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), times.alias("_w"))
    stats = present.groupBy(*keys).agg(F.min("_v"), F.max("_v"), F.sum("_w").alias("n"))
    extents = {tuple(r[k] for k in keys): (r[-3], r[-2], r[-1]) for r in stats.collect()}
    if max((n for _, _, n in extents.values()), default=0) <= SMALL_GROUP:
        return present.groupBy(*keys).agg(F.percentile("_v", F.lit(prob), F.col("_w")).alias(name))

    def histogram(brackets):
        bounds = spark.createDataFrame(
            [(*k, lo, hi) for k, (lo, hi) in brackets.items()],
            _bounds_schema(df, keys),
        )
        # one row per group: a table this size is always broadcast
        joined = present.join(F.broadcast(bounds), keys)
        inside = joined.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counted = inside.groupBy(*keys, bin_of(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_b")).agg(
            F.sum("_w").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        out: dict = {k: [] for k in brackets}
        for r in counted.collect():
            out[tuple(r[k] for k in keys)].append((r["_b"], r["n"], r["lo"], r["hi"]))
        return out

    rows = [(*k, v) for k, v in refine_quantile(extents, prob, histogram).items()]
    return spark.createDataFrame(rows, _value_schema(df, keys, name))


def _bounds_schema(df, keys):
    return ", ".join([*_typed(df, keys), "_lo double", "_hi double"])


def _value_schema(df, keys, name):
    return ", ".join([*_typed(df, keys), f"{name} double"])


def _typed(df: DataFrame, keys: list[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
