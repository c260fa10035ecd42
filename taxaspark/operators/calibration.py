"""Reliability bins, calibration error, and confidence maps.

Input rows carry a ``confidence`` and a 0/1 ``correct``; correctness is that of the nearest label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.operators import isotonic
from taxaspark.session import stage


def correctness(long: DataFrame) -> DataFrame:
    """Long predictions with ``correct`` = nearest label equals the truth."""
    return long.withColumn("correct", (F.col("nearest") == F.col("truth")).cast("int"))


def held_out_table(predictions: DataFrame) -> DataFrame:
    """One row per query with four columns per rank, as saved for the report panel.

    Taken from the wide predictions, which already hold a query on one row: no shuffle.
    """
    columns = []
    for r in RANKS:
        columns += [
            F.col("nearest")[r].alias(f"nearest_{r}"),
            F.col(f"true_{r}"),
            F.col("confidence")[r].alias(f"confidence_{r}"),
            (F.col("nearest")[r] == F.col(f"true_{r}")).cast("int").alias(f"correct_{r}"),
        ]
    return predictions.select("process_id", "holdout_fraction", "split", "predicted_rank", "is_novel", *columns)


def unpivot_saved(saved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Saved wide predictions back to (rank, confidence, correct); ranks without both columns are skipped."""
    present = [r for r in RANKS if {f"confidence_{r}", f"correct_{r}"} <= set(saved.columns)]
    rows = [
        F.struct(F.lit(r).alias("rank"), F.col(f"confidence_{r}").alias("confidence"), F.col(f"correct_{r}").cast("double").alias("correct"))
        for r in present
    ]
    if not rows:
        return saved.sparkSession.createDataFrame([], "rank string, confidence double, correct double")
    return saved.select(*(keys or []), F.explode(F.array(*rows)).alias("r")).select(*(keys or []), "r.*")


def bin_edges(n_bins: int) -> list[float]:
    if n_bins < 1:
        raise ValueError("n_bins must be >= 1")
    width = 1.0 / n_bins
    return [i * width for i in range(n_bins)] + [1.0]


def bin_index(confidence: Column, n_bins: int) -> Column:
    """Bin by comparing with the edges themselves; outside [0, 1] there is no bin."""
    edges = bin_edges(n_bins)
    out = None
    for i in range(n_bins):
        upper = (confidence <= edges[i + 1]) if i == n_bins - 1 else (confidence < edges[i + 1])
        cond = (confidence >= edges[i]) & upper
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def reliability_bins(rows: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """Per group and bin: edges, mean confidence, accuracy, count; empty bins stay with count 0."""
    edges = bin_edges(n_bins)
    found = rows.groupBy(*keys, bin_index(F.col("confidence"), n_bins).alias("bin_index")).agg(
        F.count("*").alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )
    grid = F.explode(F.array(*[
        F.struct(F.lit(i).alias("bin_index"), F.lit(edges[i]).alias("conf_low"), F.lit(edges[i + 1]).alias("conf_high"))
        for i in range(n_bins)
    ]))
    frame = found.select(*keys).distinct().select(*keys, grid.alias("g")).select(*keys, "g.*")
    return frame.join(found, [*keys, "bin_index"], "left").select(
        *keys, "bin_index", "conf_low", "conf_high", "mean_confidence", "accuracy", F.coalesce("count", F.lit(0)).alias("count")
    )


def calibration_error(rows: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """(keys, n, ece); n counts every score, also those in no bin."""
    per_bin = rows.groupBy(*keys, bin_index(F.col("confidence"), n_bins).alias("b")).agg(
        F.count("*").alias("c"), F.avg("confidence").alias("conf"), F.avg(F.col("correct").cast("double")).alias("acc")
    )
    gap = F.when(F.col("b").isNotNull(), F.col("c") * F.abs(F.col("acc") - F.col("conf")))
    return per_bin.groupBy(*keys).agg(F.sum("c").alias("n"), (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("c")).alias("ece"))


def report(rows: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """Bins and error side by side, one row per (keys, bin)."""
    return reliability_bins(rows, keys, n_bins).join(calibration_error(rows, keys, n_bins), keys)


@dataclass(frozen=True)
class ConfidenceMap:
    """Raw confidence to P(correct): piecewise linear, logistic or constant."""

    method: str
    constant: float | None = None
    boundaries: tuple[float, ...] = ()
    values: tuple[float, ...] = ()
    slope: float = 0.0
    intercept: float = 0.0

    def column(self, raw: Column) -> Column:
        if self.constant is not None:
            return F.when(raw.isNotNull(), F.lit(self.constant))
        if self.method == "platt":
            out = 1.0 / (1.0 + F.exp(-(F.lit(self.slope) * raw + F.lit(self.intercept))))
        else:
            out = _interpolate(self.boundaries, self.values)(raw)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def _interpolate(boundaries: tuple[float, ...], values: tuple[float, ...]):
    x, y = np.array(boundaries), np.array(values)

    @F.pandas_udf("double")
    def apply(raw: pd.Series) -> pd.Series:
        return pd.Series(np.interp(raw.to_numpy(dtype=float), x, y))

    return apply


def fit_map(rows: DataFrame, method: str = "isotonic") -> ConfidenceMap:
    """Map from ``confidence`` to the chance of being ``correct``."""
    if method not in ("isotonic", "platt"):
        raise ValueError(f"unknown calibrator method: {method!r}")
    # Equal scores collapse to one weighted row before anything is sorted.
    pooled = stage(
        rows.groupBy(F.col("confidence").cast("double").alias("confidence")).agg(
            F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").cast("double").alias("n")
        ),
        "pooled",
    )
    r = pooled.agg(F.sum("n").alias("n"), F.sum(F.col("accuracy") * F.col("n")).alias("hits"),
                   F.min("accuracy").alias("lo"), F.max("accuracy").alias("hi")).first()
    if not r.n:
        raise ValueError("cannot fit a confidence map without rows")
    if r.lo == r.hi and r.lo in (0.0, 1.0):
        return ConfidenceMap(method, constant=r.lo)
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="confidence", labelCol="accuracy", weightCol="n").fit(pooled)
        return ConfidenceMap(method, boundaries=tuple(model.boundaries.toArray()), values=tuple(model.predictions.toArray()))
    outcomes = F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), (F.col("n") * F.col("accuracy")).alias("w")),
        F.struct(F.lit(0.0).alias("y"), (F.col("n") * (1.0 - F.col("accuracy"))).alias("w")),
    ))
    weighted = pooled.select(array_to_vector(F.array("confidence")).alias("features"), outcomes.alias("o")).select("features", "o.*").where("w > 0")
    # The L2 penalty with C = 1 against a summed loss is 1/n against Spark's mean loss.
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / r.n, elasticNetParam=0.0, standardization=False,
                               maxIter=1000, tol=1e-10).fit(weighted)
    return ConfidenceMap(method, slope=float(model.coefficients[0]), intercept=float(model.intercept))


def fit_rank_maps(rows: DataFrame, method: str = "isotonic", ranks=RANKS) -> dict[str, ConfidenceMap]:
    """One map per rank that has rows."""
    present = {r[0] for r in rows.select("rank").distinct().collect()}
    return {r: fit_map(rows.where(F.col("rank") == r), method) for r in ranks if r in present}


def apply_rank_maps(rows: DataFrame, maps: dict[str, ConfidenceMap]) -> DataFrame:
    """Remap ``confidence`` by rank; ranks without a map pass through."""
    parts = [rows.where(F.col("rank") == r).withColumn("confidence", m.column(F.col("confidence"))) for r, m in maps.items()]
    rest = rows.where(~F.col("rank").isin(list(maps))) if maps else rows
    return reduce(DataFrame.unionByName, parts, rest)


def maps_table(spark: SparkSession, maps: dict[str, ConfidenceMap]) -> DataFrame:
    """(rank, method, boundary, value) rows: the saved form of a map set."""
    out = []
    for rank, m in maps.items():
        if m.constant is not None:
            out.append((rank, "constant", None, m.constant))
        elif m.method == "platt":
            out += [(rank, "platt", 0.0, m.intercept), (rank, "platt", 1.0, m.slope)]
        else:
            out += [(rank, "isotonic", float(b), float(v)) for b, v in zip(m.boundaries, m.values)]
    return spark.createDataFrame(out, "rank string, method string, boundary double, value double")


def maps_from_table(table: DataFrame) -> dict[str, ConfidenceMap]:
    rows: dict[str, list] = {}
    for r in table.orderBy("rank", "boundary").collect():
        rows.setdefault(r["rank"], []).append(r)
    out = {}
    for rank, points in rows.items():
        kind = points[0].method
        if kind == "constant":
            out[rank] = ConfidenceMap("isotonic", constant=points[0].value)
        elif kind == "platt":
            out[rank] = ConfidenceMap("platt", intercept=points[0].value, slope=points[1].value)
        else:
            out[rank] = ConfidenceMap("isotonic", boundaries=tuple(p.boundary for p in points), values=tuple(p.value for p in points))
    return out


def leave_one_holdout(rows: DataFrame, method: str = "isotonic", by: tuple[str, ...] = ()) -> DataFrame:
    """Remap each fraction's scores with a map fitted on the other fractions (one fraction: on itself), per group ``by``."""
    if method == "isotonic":
        return isotonic.leave_one_out(rows, list(by))
    parts = []
    for group in (r.asDict() for r in rows.select(*by).distinct().collect()) if by else [{}]:
        same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.lit(group[k])), group, F.lit(True))
        parts += _leave_one_out_of(rows.where(same), method)
    return reduce(DataFrame.unionByName, parts) if parts else rows


def _leave_one_out_of(rows: DataFrame, method: str) -> list[DataFrame]:
    fractions = [r[0] for r in rows.select("holdout_fraction").distinct().orderBy("holdout_fraction").collect()]
    parts = []
    for f in fractions:
        others = rows.where(F.col("holdout_fraction") != f) if len(fractions) > 1 else rows
        fitted = fit_map(others, method)
        parts.append(rows.where(F.col("holdout_fraction") == f).withColumn("confidence", fitted.column(F.col("confidence"))))
    return parts


def raw_gate(rows: DataFrame, n_bins: int = 10, ece_threshold: float = 0.1) -> DataFrame:
    """(rank, n, ece, failed) over the pooled held-out rows."""
    return calibration_error(rows, ["rank"], n_bins).withColumn("failed", F.col("ece") > ece_threshold)


def decision(bad: list[str], still_bad: list[str], recalibrate: bool) -> str:
    if not bad:
        return "pass"
    if not recalibrate:
        return "fail"
    return "fail_after_recalibrate" if still_bad else "pass_after_recalibrate"
