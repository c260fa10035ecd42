"""Calibrated cascade species → genus → family → order with novelty flags."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.functions.scores import distance_confidence, support_reliability
from taxaspark.operators.centroids import centroid_spacing, fit_centroids
from taxaspark.operators.nearest import Metric, SharedLabels, nearest_hits, share_labels
from taxaspark.operators.predictions import rank_map
from taxaspark.operators.quantiles import exact_quantile
from taxaspark.session import stage


@dataclass(frozen=True)
class FallbackSettings:
    seq_weight: float = 0.8
    geo_weight: float = 0.2
    rank_percentile: float = 90.0
    sample_count_prior: float = 5.0
    n_nearest_relatives: int = 5

    def __post_init__(self):
        if self.sample_count_prior < 0:
            raise ValueError("sample_count_prior must be >= 0")
        if self.n_nearest_relatives < 1:
            raise ValueError("n_nearest_relatives must be >= 1")

    @property
    def weights(self) -> tuple[float, float]:
        total = self.seq_weight + self.geo_weight
        return self.seq_weight / total, self.geo_weight / total


@dataclass(frozen=True)
class FallbackModel:
    """Centroid table plus a few numbers per (fraction, rank)."""

    settings: FallbackSettings
    centroids: DataFrame
    spacing: dict
    thresholds: dict | None = None
    calibrators: dict = field(default_factory=dict)  # rank -> confidence map
    shared: SharedLabels | None = None  # the centroids, measured and broadcast ahead of many searches

    @property
    def metric(self) -> Metric:
        return Metric(*self.settings.weights, scales=self.spacing)

    def prepared(self) -> "FallbackModel":
        """The same model, whose centroids are no longer read for every table it predicts."""
        return replace(self, shared=share_labels(self.centroids))

    def with_calibrators(self, calibrators: dict | None) -> "FallbackModel":
        return replace(self, calibrators=dict(calibrators or {}))


def fit(train: DataFrame, settings: FallbackSettings = FallbackSettings()) -> FallbackModel:
    """``train``: holdout_fraction, process_id, the four ranks, lat, lon, vec."""
    centroids = fit_centroids(train)
    return FallbackModel(settings, centroids, centroid_spacing(centroids))


def hits(model: FallbackModel, queries: DataFrame, relatives: int = 1) -> DataFrame:
    """Nearest label per rank; ``relatives`` of them for species and genus."""
    k = {"species": relatives, "genus": relatives, "family": 1, "order": 1}
    return nearest_hits(queries, model.shared or model.centroids, k, model.metric)


def long_hits(hit_rows: DataFrame) -> DataFrame:
    """One row per (query, rank, place)."""
    exploded = hit_rows.select("*", F.explode("hits").alias("hit")).drop("hits")
    return exploded.select(*[c for c in exploded.columns if c != "hit"], F.col("hit.rank").alias("rank"),
                           F.col("hit.label").alias("nearest"), F.col("hit.distance").alias("distance"),
                           F.col("hit.support").alias("support"))


def calibrate(model: FallbackModel, val: DataFrame) -> FallbackModel:
    """Threshold per (fraction, rank): a percentile of the nearest distances of seen species' rows."""
    distances = stage(long_hits(hits(model, val)).select("holdout_fraction", "rank", "distance"), "val-distances")
    cut = exact_quantile(distances, ["holdout_fraction", "rank"], "distance", model.settings.rank_percentile / 100.0)
    found = {(r.holdout_fraction, r["rank"]): r["quantile"] for r in cut.collect()}
    return replace(model, thresholds={g: found.get(g, 0.0) for g in model.spacing})


def _per_rank(model: FallbackModel, values: dict, rank: str) -> Column:
    """A (fraction, rank) constant as a column: one branch per fraction."""
    out = None
    for (f, r), v in sorted(values.items()):
        if r == rank:
            cond = F.col("holdout_fraction") == F.lit(f)
            out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return F.lit(0.0) if out is None else out


def _first(rank: str) -> Column:
    return F.get(F.filter("hits", lambda h: h["rank"] == rank), F.lit(0))


def predict(model: FallbackModel, queries: DataFrame) -> DataFrame:
    """One row per query: committed rank, novelty, taxa, confidence and ranked relatives.

    Everything after the neighbour scan is column expressions on the same row.
    """
    if model.thresholds is None:
        raise RuntimeError("calibrate the model before predicting")
    settings = model.settings
    found = hits(model, queries, settings.n_nearest_relatives)
    row = found.withColumns({f"_{r}": _first(r) for r in RANKS})
    row = row.withColumns({f"_cut_{r}": _per_rank(model, model.thresholds, r) for r in RANKS})
    committed = F.coalesce(*[F.when(F.col(f"_{r}.distance") <= F.col(f"_cut_{r}"), F.lit(r)) for r in RANKS])
    row = row.withColumn("predicted_rank", committed)

    def taxon(rank: str) -> Column:
        """Filled at and above the committed rank, from the committed label's own lineage."""
        out = F.when(F.col("predicted_rank") == rank, F.col(f"_{rank}.label"))
        for deeper in RANKS[: RANKS.index(rank)]:
            out = out.when(F.col("predicted_rank") == deeper, F.col(f"_{deeper}.{rank}"))
        return out

    def confidence(rank: str) -> Column:
        raw = distance_confidence(F.col(f"_{rank}.distance"), F.col(f"_cut_{rank}")) * support_reliability(
            F.col(f"_{rank}.support"), settings.sample_count_prior
        )
        curve = model.calibrators.get(rank)
        return raw if curve is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), curve.column(raw)))

    kept = [c for c in found.columns if c not in ("hits", *RANKS)]
    truth = [F.col(r).alias(f"true_{r}") for r in RANKS if r in found.columns]
    return row.select(
        *kept,
        *truth,
        "predicted_rank",
        (~F.col("predicted_rank").eqNullSafe("species")).alias("is_novel"),
        F.col("_species.label").alias("closest_relative_species"),
        *[taxon(r).alias(r) for r in RANKS],
        rank_map(confidence).alias("confidence"),
        rank_map(lambda r: F.col(f"_{r}.distance")).alias("distance"),
        rank_map(lambda r: F.col(f"_{r}.support")).alias("support"),
        rank_map(lambda r: F.col(f"_{r}.label")).alias("nearest"),
        F.filter("hits", lambda h: h["rank"] == "species").alias("nearest_species"),
        F.filter("hits", lambda h: h["rank"] == "genus").alias("nearest_genera"),
    )


def taxonomy_lookup(train: DataFrame, rank: str) -> DataFrame:
    """Label -> upper taxonomy; the row with the smallest process_id wins."""
    upper = RANKS[RANKS.index(rank) + 1 :]
    return train.groupBy(rank).agg(F.min(F.struct("process_id", *upper)).alias("first")).select(
        rank, *[F.col(f"first.{u}").alias(u) for u in upper]
    )
