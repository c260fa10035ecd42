"""Report tables: the rows behind each chart and card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.functions.vectors import finite_or_null

# Display names of the methods.
METHOD_LABELS = {"ours": "ours", "blast": "Similarity search", "naive_bayes": "Naive Bayes", "nearest_neighbor": "1-NN"}
METRICS = tuple(f"{r} {kind}" for r in RANKS for kind in ("coverage", "accuracy"))


def _labelled(method: Column) -> Column:
    out = method
    for key, label in METHOD_LABELS.items():
        out = F.when(method == key, F.lit(label)).otherwise(out)
    return out


def reliability_rows(reports: DataFrame) -> DataFrame:
    """Bins that can be drawn: counted, with finite means."""
    finite = finite_or_null(F.col("mean_confidence")).isNotNull() & finite_or_null(F.col("accuracy")).isNotNull()
    return reports.where((F.col("count") > 0) & finite).select("rank", "mean_confidence", "accuracy", "count", "ece")


def preferred_reports(raw: DataFrame, recalibrated: DataFrame) -> DataFrame:
    """The recalibrated reports when there are any, else the raw ones; known ranks only."""
    chosen = recalibrated if recalibrated.take(1) else raw
    return chosen.where(F.col("rank").isin(list(RANKS)))


def fcw_rows(curves: DataFrame, wanted_fraction: float | None, rank: str, subset: str, methods: list[str]) -> DataFrame:
    """(method, label, threshold, fcw) of one fraction; without a match, the first one."""
    fractions = [r[0] for r in curves.select("holdout_fraction").distinct().orderBy("holdout_fraction").collect()]
    chosen = next((f for f in fractions if wanted_fraction is not None and abs(f - wanted_fraction) < 1e-9), None)
    chosen = chosen if chosen is not None or not fractions else fractions[0]
    return curves.where(
        (F.col("holdout_fraction") == F.lit(chosen)) & (F.col("rank") == rank) & (F.col("subset") == subset) & F.col("method").isin(methods)
    ).select("method", _labelled(F.col("method")).alias("label"), "threshold", finite_or_null(F.col("fcw")).alias("fcw"))


def curve_at(curve: DataFrame, threshold: float) -> DataFrame:
    """Each method's curve at ``threshold`` by linear interpolation, flat beyond its ends."""
    by_method = Window.partitionBy("method").orderBy("threshold")
    t = F.lit(float(threshold))
    pairs = curve.withColumn("next_t", F.lead("threshold").over(by_method)).withColumn("next_v", F.lead("fcw").over(by_method))
    inside = (F.col("threshold") <= t) & (t < F.col("next_t"))
    value = F.col("fcw") + (F.col("next_v") - F.col("fcw")) * (t - F.col("threshold")) / (F.col("next_t") - F.col("threshold"))
    return pairs.groupBy("method", "label").agg(
        t.alias("threshold"),
        F.coalesce(
            F.max(F.when(inside, value)),
            F.when(t < F.min("threshold"), F.min_by("fcw", "threshold")).otherwise(F.max_by("fcw", "threshold")),
        ).alias("fcw"),
    )


def holdout_percents(results: DataFrame) -> DataFrame:
    return results.select(F.bround(F.col("holdout_fraction") * 100, 0).cast("int").alias("percent")).distinct().orderBy("percent")


def at_percent(results: DataFrame, percent: int) -> DataFrame:
    return results.where(F.bround(F.col("holdout_fraction") * 100, 0).cast("int") == percent)


def metric_bars(scores: DataFrame) -> DataFrame:
    """(method, label, metric, metric_order, value): rank by rank, coverage before accuracy, nulls out."""
    rows = F.explode(F.array(
        F.struct(F.lit("coverage").alias("kind"), F.col("coverage").alias("value")),
        F.struct(F.lit("accuracy").alias("kind"), F.col("accuracy_among_answered").alias("value")),
    ))
    long = scores.select("method", "rank", rows.alias("r")).select("method", F.concat_ws(" ", "rank", "r.kind").alias("metric"), "r.value")
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    return long.where(finite_or_null(F.col("value")).isNotNull()).select(
        "method", _labelled(F.col("method")).alias("label"), "metric", order.alias("metric_order"), "value"
    )


def headline(at_threshold: DataFrame) -> DataFrame:
    """The row of ``ours`` when present, else the first method."""
    return at_threshold.orderBy(F.col("method") != "ours", "method").limit(1).select("method", "label", "fcw")


def relatives_table(predictions: DataFrame) -> DataFrame:
    """Nearest species, then nearest genera, with their place in the list from 1."""
    rows = F.explode(
        F.concat(*[
            F.transform(c, lambda h, i: F.struct((i + 1).alias("place"), h.alias("hit")))
            for c in ("nearest_species", "nearest_genera")
        ])
    )
    return predictions.select("holdout_fraction", "process_id", rows.alias("r")).select(
        "holdout_fraction", "process_id", F.col("r.place").alias("place"), F.initcap("r.hit.rank").alias("taxon_rank"),
        F.col("r.hit.label").alias("label"), F.col("r.hit.genus").alias("genus"), F.col("r.hit.family").alias("family"),
        F.col("r.hit.distance").alias("distance"), F.col("r.hit.support").alias("support"),
    )


def rank_states(predictions: DataFrame) -> DataFrame:
    """Per query and rank, species at the surface: skipped above the committed rank, committed, abyss below; and the taxon shown."""
    place = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("predicted_rank"))
    rows = []
    for i, r in enumerate(RANKS, 1):
        state = F.when(place == i, "committed").when(place > i, "skipped").otherwise("abyss")
        rows.append(F.struct(F.lit(r).alias("rank"), state.alias("state"), F.coalesce(F.col(r), F.col("nearest")[r], F.lit("—")).alias("taxon")))
    return predictions.select("holdout_fraction", "process_id", F.explode(F.array(*rows)).alias("r")).select("holdout_fraction", "process_id", "r.*")


def card_names(predictions: DataFrame) -> DataFrame:
    """Family shown beside a call, and the taxon whose reference picture is looked up."""
    return predictions.select(
        "holdout_fraction", "process_id",
        F.coalesce("family", F.col("nearest")["family"]).alias("icon_family"),
        F.coalesce("species", "closest_relative_species", "genus", F.lit("")).alias("reference_taxon"),
    )
