"""Single nearest training row, with a distance-scale confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.functions.scores import neighbour_confidence
from taxaspark.operators import metric_index
from taxaspark.operators.nearest import LABEL_COLUMNS, nearest_hits
from taxaspark.operators.predictions import carried, rank_map
from taxaspark.operators.quantiles import exact_quantile
from taxaspark.session import stage

# Beyond so many pairs of training rows, an index is built. Both ways give the same rows.
DIRECT_PAIRS = 10**9


@dataclass(frozen=True)
class NeighborModel:
    rows: DataFrame
    scales: dict[float, float]  # fraction -> median leave-one-out distance
    index: metric_index.MetricIndex | None = None


def row_labels(train: DataFrame) -> DataFrame:
    """Training rows as a label table; ties go to the smallest process_id."""
    return train.select(
        "holdout_fraction",
        F.lit("row").alias("rank"),
        F.col("process_id").alias("label"),
        F.lit(1).cast("long").alias("support"),
        *RANKS,
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        "vec",
    ).select(*LABEL_COLUMNS)


def _queries(df: DataFrame) -> DataFrame:
    empty = F.lit(None).cast("double")
    return df.select(*carried(df), empty.alias("lat"), empty.alias("lon"), "vec")


def leave_one_out(train: DataFrame, rows: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """Distance of each training row to its nearest other row."""
    found = nearest_hits(_queries(train), rows, {"row": 1}, skip_self=True, broadcast_bytes=broadcast_bytes)
    return found.select("holdout_fraction", "process_id", F.get("hits", F.lit(0))["distance"].alias("distance"))


def gaps_by_index(index: metric_index.MetricIndex, most_pairs: float | None = 0.5) -> DataFrame | None:
    """(holdout_fraction, distance, copies) per different vector: how far its nearest other row is. Copies have none."""
    one = index.rows.where("copies = 1").select("holdout_fraction", F.col("label").alias("process_id"), "vec")
    found = metric_index.nearest(index, one, skip_self=True, most_pairs=most_pairs)
    if found is None:
        return None
    alone = found.select("holdout_fraction", F.col("found.distance").alias("distance"), F.lit(1).cast("long").alias("copies"))
    return alone.unionByName(index.rows.where("copies > 1").select("holdout_fraction", F.lit(0.0).alias("distance"), "copies"))


def fit(train: DataFrame, broadcast_bytes: int | None = None, by_index: bool | None = None, most_pairs: float | None = 0.5) -> NeighborModel:
    """``by_index``: search through a metric index; unset, that is done beyond ``DIRECT_PAIRS`` pairs of training rows.

    The index is given up where it would compare more than the share ``most_pairs`` of all pairs. Results are the same.
    """
    rows = stage(row_labels(train), "rows")
    fractions = {r[0]: r[1] for r in rows.groupBy("holdout_fraction").count().collect()}
    if by_index is None:
        by_index = sum(n * n for n in fractions.values()) > DIRECT_PAIRS
    index = metric_index.build(rows) if by_index else None
    gaps = gaps_by_index(index, most_pairs) if index else None
    if gaps is None:
        index, gaps = None, leave_one_out(train, rows, broadcast_bytes).withColumn("copies", F.lit(1).cast("long"))
    median = exact_quantile(stage(gaps, "loo"), ["holdout_fraction"], "distance", 0.5, weight="copies")
    medians = {r.holdout_fraction: r["quantile"] for r in median.collect()}
    # One row has no other row, and copies have no distance: both leave the scale at one.
    return NeighborModel(rows, {f: s if (s := medians.get(f)) and s > 1e-12 else 1.0 for f in fractions}, index)


def _hits_by_index(model: NeighborModel, queries: DataFrame, most_pairs: float | None) -> DataFrame | None:
    found = metric_index.nearest(model.index, queries, most_pairs=most_pairs)
    if found is None:
        return None
    return queries.drop("vec").join(found, ["holdout_fraction", "process_id"], "left").withColumn("hit", F.col("found"))


def predict(model: NeighborModel, queries: DataFrame, broadcast_bytes: int | None = None, most_pairs: float | None = 0.5) -> DataFrame:
    """Nearest training row of each query, by the model's index if it has one that prunes."""
    rows = _queries(queries)
    found = _hits_by_index(model, rows, most_pairs) if model.index else None
    if found is None:
        found = nearest_hits(rows, model.rows, {"row": 1}, broadcast_bytes=broadcast_bytes).withColumn("hit", F.get("hits", F.lit(0)))
    hit = F.col("hit")
    scale = F.lit(1.0)
    for f, s in model.scales.items():
        scale = F.when(F.col("holdout_fraction") == F.lit(f), F.lit(s)).otherwise(scale)
    row = found.select(
        *[c for c in found.columns if c not in ("hits", "hit", "found", "compared", "lat", "lon")],
        *[hit[r].alias(r) for r in RANKS],
        hit["label"].alias("nearest_id"),
        hit["distance"].alias("nearest_distance"),
    )
    score = neighbour_confidence(F.col("nearest_distance"), scale)
    return row.withColumn("confidence", rank_map(lambda r: score)).withColumn("nearest", rank_map(F.col))
