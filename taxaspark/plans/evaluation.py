"""Held-out evaluation jobs over every fraction: fit, calibrate, predict, score, save."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.operators import calibration, classifier, fallback, metrics, naive_bayes, nearest_neighbor, similarity
from taxaspark.operators.encoders import encoder_name, fit_encoder
from taxaspark.operators.kmers import kmer_vectors
from taxaspark.operators.predictions import long_form
from taxaspark.operators.splits import split_rows
from taxaspark.session import stage
from taxaspark.sources.tables import write_csv_table, write_json_documents, write_predictions


def split_table(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of every fraction with ``split`` in train/val/test."""
    return split_rows(rows, splits).withColumnRenamed("role", "split")


def encode_splits(rows: DataFrame, encoder: str = "kmer_pca", **settings) -> DataFrame:
    """``rows`` (a split table) plus ``vec``: one encoder per fraction, fitted on its own train rows."""
    rows = stage(rows, "split-rows", ("holdout_fraction",))
    fractions = [r[0] for r in rows.select("holdout_fraction").distinct().orderBy("holdout_fraction").collect()]
    parts = []
    for f in fractions:
        part = rows.where(F.col("holdout_fraction") == f)
        parts.append(fit_encoder(encoder, part.where("split = 'train'"), **settings).transform(part))
    return stage(reduce(DataFrame.unionByName, parts), "encoded")


def train_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split") == "train")


def query_rows(rows: DataFrame, splits=("val", "test")) -> DataFrame:
    return rows.where(F.col("split").isin(list(splits)))


def fit_fallback(encoded: DataFrame, settings=fallback.FallbackSettings()) -> fallback.FallbackModel:
    model = fallback.fit(train_rows(encoded), settings)
    return fallback.calibrate(model, query_rows(encoded, ("val",)))


def fallback_predictions(encoded: DataFrame, splits=("val", "test"), settings=fallback.FallbackSettings()) -> DataFrame:
    return fallback.predict(fit_fallback(encoded, settings), query_rows(encoded, splits))


def system_predictions(encoded: DataFrame, splits=("val", "test"), nb_k: int = 4, evalue: float = 1e-10,
                       min_pident: float = 97.0, bitscore_offset: float = 50.0,
                       methods=("ours", "naive_bayes", "nearest_neighbor", "blast")) -> DataFrame:
    """Long predictions of every method, staged once for all the tables drawn from them."""
    train, queries = train_rows(encoded), query_rows(encoded, splits)
    parts = []
    if "ours" in methods:
        parts.append(long_form(fallback_predictions(encoded, splits), "ours"))
    if "naive_bayes" in methods:
        freq = stage(kmer_vectors(encoded.drop("vec"), nb_k), "nb-frequencies")
        model = naive_bayes.fit(train_rows(freq))
        parts.append(long_form(naive_bayes.predict(model, query_rows(freq, splits)), "naive_bayes"))
    if "nearest_neighbor" in methods:
        parts.append(long_form(nearest_neighbor.predict(nearest_neighbor.fit(train), queries), "nearest_neighbor"))
    if "blast" in methods:
        hits = similarity.significant(similarity.best_hits(queries, train), evalue)
        parts.append(long_form(similarity.calls(queries, hits, train, min_pident, bitscore_offset), "blast"))
    return stage(reduce(DataFrame.unionByName, parts), "predictions")


def base_classifier_job(encoded: DataFrame, out: str | None = None) -> DataFrame:
    """Accuracy per (fraction, split, rank) of the nearest-centroid classifier."""
    model = classifier.fit(train_rows(encoded))
    scores = metrics.classifier_accuracy(classifier.predict(model, query_rows(encoded)))
    return _saved(scores, out)


def fallback_job(encoded: DataFrame, out: str | None = None) -> DataFrame:
    """Per fraction: novelty recall and abstention on test, resolved shares, false novelty on val."""
    return _saved(fallback_summary(stage(fallback_predictions(encoded), "fallback")), out)


def fallback_summary(predictions: DataFrame) -> DataFrame:
    test = predictions.where("split = 'test'")
    rates = metrics.novelty_rates(test, ["holdout_fraction"]).select(
        "holdout_fraction", F.col("n").alias("n_test"), F.col("novelty_rate").alias("novelty_detection_recall"), "abstention_rate"
    )
    resolved = metrics.resolved_by_rank(test, ["holdout_fraction"]).groupBy("holdout_fraction").pivot("rank", list(RANKS)).agg(
        F.first("resolved_count").alias("count"), F.first("resolved_accuracy").alias("accuracy")
    )
    return rates.join(resolved, "holdout_fraction", "left").join(metrics.seen_species_rates(predictions), "holdout_fraction", "left")


def benchmark_job(long: DataFrame, out: str | None = None, n_bootstrap: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Coverage and accuracy with intervals per (fraction, method, rank); absent methods stay as null rows."""
    return _saved(metrics.with_missing_methods(metrics.benchmark_scores(long, n_bootstrap, level, seed)), out)


def head_to_head_job(long: DataFrame, out: str | None = None, threshold: float = 0.5, n_thresholds: int = 21,
                     table_fraction: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(comparison table, false-confident-wrong curves)."""
    scores = stage(metrics.subset_scores(long, threshold), "subset-scores")
    chosen = metrics.table_fraction(scores, table_fraction)
    table = metrics.comparison_table(scores, chosen)
    curves = metrics.fcw_curve(metrics.evaluation_subsets(long), ["holdout_fraction", "subset", "method", "rank"], n_thresholds)
    if out:
        write_json_documents(scores, f"{out}/scores")
        write_json_documents(curves, f"{out}/curves")
        write_csv_table(table, f"{out}/table")
    return table, curves


def encoder_scores(predictions: DataFrame, encoder: str, n_bins: int = 10, threshold: float = 0.5) -> DataFrame:
    """Per (fraction, split, rank): accuracy, false-confident-wrong rate, ECE, resolved share, beside the novelty rates."""
    keys = ["holdout_fraction", "split"]
    long = long_form(predictions, encoder)
    ranked = metrics.rank_scores(long, [*keys, "rank"], threshold)
    ece = calibration.calibration_error(calibration.correctness(long), [*keys, "rank"], n_bins).drop("n")
    resolved = metrics.resolved_by_rank(predictions, [*keys])
    rates = metrics.novelty_rates(predictions, keys).drop("n")
    return ranked.join(ece, [*keys, "rank"]).join(resolved, [*keys, "rank"]).join(rates, keys).withColumn("encoder", F.lit(encoder))


def compare_encoders_job(rows: DataFrame, encoders: dict[str, dict], out: str | None = None, n_bins: int = 10,
                         threshold: float = 0.5) -> DataFrame:
    """Same splits and cascade, one encoder at a time; only the vector differs."""
    parts = []
    for name, settings in encoders.items():
        encoded = encode_splits(rows, name, **settings)
        width = encoded.groupBy("holdout_fraction").agg(F.max(F.size("vec")).alias("dimensions"))
        predictions = stage(fallback_predictions(encoded), "encoder-predictions")
        parts.append(encoder_scores(predictions, encoder_name(name), n_bins, threshold).join(width, "holdout_fraction"))
    scores = stage(reduce(DataFrame.unionByName, parts), "encoder-scores")
    return _saved(encoder_table(scores), out)


def encoder_table(scores: DataFrame) -> DataFrame:
    """Per (encoder, fraction, rank): sizes, then each score of the val and of the novel rows; a fraction without val
    rows has nulls there. The family-resolved accuracy of the novel rows is repeated."""
    keys = ["encoder", "holdout_fraction", "rank"]

    def of(split: str, suffix: str) -> DataFrame:
        values = {"n": "n", "ece": "ece", "accuracy": "accuracy", "false_confident_wrong_rate": "false_confident_wrong_rate"}
        return scores.where(F.col("split") == split).select(*keys, *[F.col(v).alias(f"{k}_{suffix}") for k, v in values.items()])

    novel = scores.where("split = 'test'")
    family = novel.where("rank = 'family'").select("encoder", "holdout_fraction", F.col("resolved_accuracy").alias("family_resolved_accuracy"))
    recall = novel.select(*keys, "dimensions", F.col("novelty_rate").alias("novelty_detection_recall"))
    false_flags = scores.where("split = 'val'").select(*keys, F.col("novelty_rate").alias("novelty_rate_val"))
    return recall.join(of("test", "novel"), keys).join(of("val", "val"), keys, "left").join(false_flags, keys, "left").join(family, ["encoder", "holdout_fraction"])

def calibration_job(predictions: DataFrame, out: str | None = None, n_bins: int = 10, ece_threshold: float = 0.1,
                    method: str = "isotonic", recalibrate: bool = True) -> dict:
    """Dump, raw reports, gate, leave-one-holdout remap of the failing ranks, new reports, decision."""
    long = stage(calibration.correctness(long_form(predictions, "ours")), "correctness")
    test = long.where("split = 'test'")
    raw = calibration.report(test, ["rank"], n_bins)
    gate = {r["rank"]: r.ece for r in calibration.raw_gate(test, n_bins, ece_threshold).collect()}  # four rows
    bad = [r for r in RANKS if gate.get(r) is not None and gate[r] > ece_threshold]
    still_bad, remapped, maps = [], None, {}
    if bad and recalibrate:
        remade = calibration.leave_one_holdout(test.where(F.col("rank").isin(bad)), method, by=("rank",))
        fixed = stage(remade.unionByName(test.where(~F.col("rank").isin(bad))), "recalibrated")
        remapped = calibration.report(fixed, ["rank"], n_bins)
        after = calibration.raw_gate(fixed, n_bins, ece_threshold).where("failed").collect()
        still_bad = [r["rank"] for r in after]
        maps = {
            "heldout_fit": calibration.fit_rank_maps(test, method, tuple(bad)),
            "val_fit": calibration.fit_rank_maps(long.where("split = 'val'"), method),
        }
    result = {
        "decision": calibration.decision(bad, still_bad, recalibrate),
        "bad_ranks": bad,
        "raw_ece": gate,
        "raw": raw,
        "per_holdout": calibration.calibration_error(test, ["holdout_fraction", "rank"], n_bins),
        "recalibrated": remapped,
        "maps": maps,
        "predictions": calibration.held_out_table(predictions),
    }
    if out:
        write_predictions(result["predictions"], f"{out}/heldout_predictions")
        write_json_documents(raw, f"{out}/raw_reports")
        write_json_documents(result["per_holdout"], f"{out}/per_holdout")
        if remapped is not None:
            write_json_documents(remapped, f"{out}/recalibrated_reports")
            for kind, fitted in maps.items():
                calibration.maps_table(predictions.sparkSession, fitted).write.mode("overwrite").parquet(f"{out}/maps/{kind}")
    return result


def _saved(df: DataFrame, out: str | None) -> DataFrame:
    if out:
        write_json_documents(df, out)
    return df


