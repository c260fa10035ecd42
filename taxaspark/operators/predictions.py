"""The shape every comparison method returns: one row per query, calls beside nearest labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark import RANKS


def carried(df: DataFrame) -> list[Column]:
    """Key columns plus the truth under ``true_<rank>``."""
    kept = [F.col(c) for c in ("holdout_fraction", "split", "process_id") if c in df.columns]
    return kept + [F.col(r).alias(f"true_{r}") for r in RANKS if r in df.columns]


def rank_map(value) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(r) for r in RANKS]), F.array(*[value(r) for r in RANKS]))


def long_form(predictions: DataFrame, method: str) -> DataFrame:
    """One row per (query, rank); methods without a cascade have no committed rank."""
    extra = {
        "predicted_rank": F.lit(None).cast("string"),
        "is_novel": F.lit(None).cast("boolean"),
    }
    full = predictions.withColumns({c: v for c, v in extra.items() if c not in predictions.columns})
    item = [
        F.struct(
            F.lit(r).alias("rank"),
            F.col(f"true_{r}").alias("truth"),
            F.col(r).alias("call"),
            F.col("nearest")[r].alias("nearest"),
            F.col("confidence")[r].alias("confidence"),
        )
        for r in RANKS
    ]
    keys = ["holdout_fraction", "split", "process_id", "predicted_rank", "is_novel"]
    return full.select(F.lit(method).alias("method"), *keys, F.explode(F.array(*item)).alias("r")).select(
        "method", *keys, "r.*"
    )
