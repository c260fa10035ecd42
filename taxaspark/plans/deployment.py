"""The deployed model: fitted on all but a random slice, applied to a table of reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaspark.operators import fallback
from taxaspark.operators.cleaning import cardinalities, clean_pasted_text
from taxaspark.operators.encoders import fit_encoder
from taxaspark.operators.splits import SEED, VAL_FRACTION, random_split
from taxaspark.session import stage


@dataclass(frozen=True)
class Deployment:
    model: fallback.FallbackModel
    encoder: object | None  # None when the rows bring their own vectors
    counts: dict[str, int]


def deploy(rows: DataFrame, encoder: str | None = "kmer_pca", val_fraction: float = VAL_FRACTION, seed: int = SEED,
           settings: fallback.FallbackSettings = fallback.FallbackSettings(), **encoder_settings) -> Deployment:
    """Fit and calibrate on one random split of everything known."""
    split = stage(random_split(rows, val_fraction, seed).withColumn("holdout_fraction", F.lit(0.0)), "deploy-split")
    fitted = None
    if encoder is not None:
        fitted = fit_encoder(encoder, split.where("role = 'train'"), **encoder_settings)
        split = stage(fitted.transform(split), "deploy-encoded")
    model = fallback.fit(split.where("role = 'train'"), settings)
    model = fallback.calibrate(model, split.where("role = 'val'"))
    counts = cardinalities(rows).first().asDict()
    roles = split.agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_val"))
    return Deployment(model, fitted, counts | roles.first().asDict())


def classify(deployment: Deployment, reads: DataFrame) -> DataFrame:
    """``reads``: process_id, lat, lon and a sequence (or vec). A stream classifies batch by batch."""
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ready = reads.withColumns(
        {
            "holdout_fraction": F.lit(0.0),
            "lat": F.when(both, F.col("lat").cast("double")),
            "lon": F.when(both, F.col("lon").cast("double")),
        }
    )
    if deployment.encoder is not None:
        ready = deployment.encoder.transform(ready)
    return fallback.predict(deployment.model, ready)


def classify_pasted(deployment: Deployment, reads: DataFrame, column: str = "raw") -> DataFrame:
    """Pasted text: unusable reads come back with their error and no prediction."""
    parsed = clean_pasted_text(reads, column)
    half = F.col("lat").isNull() != F.col("lon").isNull()
    parsed = parsed.withColumn("error", F.coalesce("error", F.when(half, F.lit("half_coordinates"))))
    good = classify(deployment, parsed.where(F.col("error").isNull()).drop(column, "error", "invalid"))
    bad = parsed.where(F.col("error").isNotNull()).select("process_id", "error", "invalid")
    return good.unionByName(bad, allowMissingColumns=True)
