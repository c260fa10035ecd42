"""Scoring aggregates over long predictions.

Input rows: method, holdout_fraction, split, process_id, rank, truth, call, nearest, confidence,
predicted_rank, is_novel. Every metric is a grouped aggregate that combines map-side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark import METHODS, RANKS
from taxaspark.operators.splits import evaluation_subsets
from taxaspark.session import stage


def share(condition: Column) -> Column:
    """Mean of a condition; an unknown condition counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def coverage() -> Column:
    return share(F.col("call").isNotNull())


def accuracy_answered() -> Column:
    return F.avg(F.when(F.col("call").isNotNull(), (F.col("call") == F.col("truth")).cast("double")))


def strict_accuracy() -> Column:
    """An abstention is wrong."""
    return share(F.col("call") == F.col("truth"))


def usable_confidence() -> Column:
    """Missing or non-finite scores count as zero."""
    c = F.col("confidence")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def scored_label() -> Column:
    return F.coalesce("nearest", "call")


def false_confident_wrong(threshold, label: Column | None = None) -> Column:
    """Share of all queries that are a wrong label at or above the threshold."""
    called = F.col("call") if label is None else label
    return share((called != F.col("truth")) & (usable_confidence() >= threshold))


def point_scores(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.count("*").alias("n"), coverage().alias("coverage"), accuracy_answered().alias("accuracy_among_answered")
    )


def with_missing_methods(scores: DataFrame, methods=METHODS) -> DataFrame:
    """A row of nulls for each method that did not run, never a zero."""
    per_fraction = scores.select("holdout_fraction").distinct().withColumn(
        "g", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(r).alias("rank")) for m in methods for r in RANKS]))
    )
    return per_fraction.select("holdout_fraction", "g.*").join(scores, ["holdout_fraction", "method", "rank"], "left")


# --- bootstrap -----------------------------------------------------------------------------

def _outcome_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    call = F.col("call")
    return long.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(call.isNotNull() & (call == F.col("truth"))).alias("n_right"),
        F.count_if(call.isNotNull() & (call != F.col("truth"))).alias("n_wrong"),
    )


def _uniform(seed: int, keys: list[str], stream: str) -> Column:
    """One hashed uniform per group, replicate and stream, never 0 or 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("rep").cast("string"), F.lit(stream))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2**32))


def binomial_ranges(trials: DataFrame, keys: list[str]) -> DataFrame:
    """(keys …, size, p) → (keys …, k, below, upto): the uniforms that the binomial quantile maps to k.

    Only counts within twelve deviations (and thirty) of the mode get a row, so a group has about the square root of
    its size. The weights follow from the ratio of neighbours and are scaled to one.
    """
    spread = F.ceil(12 * F.sqrt(F.col("size") * F.col("p") * (1 - F.col("p")))) + 30
    mode = F.least(F.floor((F.col("size") + 1) * F.col("p")), F.col("size"))
    fixed = (F.col("p") <= 0) | (F.col("p") >= 1)
    ends = trials.withColumn("lo", F.when(fixed, mode).otherwise(F.greatest(F.lit(0), mode - spread)))
    ends = ends.withColumn("hi", F.when(fixed, mode).otherwise(F.least("size", mode + spread)))
    rows = ends.withColumn("k", F.explode(F.sequence("lo", "hi")))
    odds = (F.col("size") - F.col("k") + 1) / F.col("k") * F.col("p") / (1 - F.col("p"))
    rows = rows.withColumn("step", F.when(F.col("k") == F.col("lo"), 0.0).otherwise(F.log(odds)))
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("k")
    rows = rows.withColumn("level", F.sum("step").over(upto))
    rows = rows.withColumn("weight", F.exp(F.col("level") - F.max("level").over(whole)))
    rows = rows.withColumn("c", F.sum("weight").over(upto) / F.sum("weight").over(whole))
    below = F.coalesce(F.lag("c").over(upto), F.lit(-1.0))
    return rows.select(*keys, "k", below.alias("below"), F.when(F.col("k") == F.col("hi"), 2.0).otherwise(F.col("c")).alias("upto"))


def _replicates(counts: DataFrame, keys: list[str], n_bootstrap: int, seed: int) -> DataFrame:
    """(keys …, n, rep, answered, right): how many of n draws are answered, and of these right, are binomial counts."""
    both = F.col("n_right") + F.col("n_wrong")
    reps = counts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1)))).withColumn("u", _uniform(seed, keys, "answered"))
    answered = binomial_ranges(counts.select(*keys, F.col("n").alias("size"), (both / F.col("n")).alias("p")), keys)
    within = (F.col("u") > F.col("below")) & (F.col("u") <= F.col("upto"))
    drawn = reps.join(answered, keys).where(within).select(*counts.columns, "rep", F.col("k").alias("answered"))
    drawn = stage(drawn, "answered")
    share_right = F.when(both > 0, F.col("n_right") / both).otherwise(0.0)
    right = binomial_ranges(drawn.select(*keys, "answered", F.col("answered").alias("size"), share_right.alias("p")).distinct(), [*keys, "answered"])
    drawn = drawn.withColumn("u", _uniform(seed, keys, "right"))
    return drawn.join(right, [*keys, "answered"]).where(within).select(*keys, "n", "rep", "answered", F.col("k").alias("right"))


def bootstrap_intervals(long: DataFrame, keys: list[str], n_bootstrap: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile intervals of coverage and accuracy among answered.

    A draw is right, wrong or unanswered, so the rows themselves are never resampled: a replicate's counts are two
    binomial quantiles of hashed uniforms, by one method at every size, at a cost of about the square root of n.
    """
    counts = _outcome_counts(long, keys)
    if n_bootstrap <= 0:
        null = F.lit(None).cast("double")
        return counts.select(*keys, *[null.alias(c) for c in ("coverage_low", "coverage_high", "accuracy_low", "accuracy_high")])
    reps = _replicates(stage(counts, "outcomes"), keys, n_bootstrap, seed).select(
        *keys,
        (F.col("answered") / F.col("n")).alias("coverage"),
        F.when(F.col("answered") > 0, F.col("right") / F.col("answered")).alias("accuracy"),
    )
    low, high = (1.0 - level) / 2.0, 1.0 - (1.0 - level) / 2.0
    # n_bootstrap values per group
    return reps.groupBy(*keys).agg(
        F.percentile("coverage", F.lit(low)).alias("coverage_low"),
        F.percentile("coverage", F.lit(high)).alias("coverage_high"),
        F.percentile("accuracy", F.lit(low)).alias("accuracy_low"),
        F.percentile("accuracy", F.lit(high)).alias("accuracy_high"),
    )


def benchmark_scores(long: DataFrame, n_bootstrap: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Coverage and accuracy with intervals per (fraction, method, rank), test rows only."""
    keys = ["holdout_fraction", "method", "rank"]
    test = long.where(F.col("split") == "test")
    return point_scores(test, keys).join(bootstrap_intervals(test, keys, n_bootstrap, level, seed), keys, "left")


# --- head to head --------------------------------------------------------------------------


def linear_grid(n: int) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, n)]


def rank_scores(long: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    return long.groupBy(*keys).agg(
        strict_accuracy().alias("accuracy"),
        false_confident_wrong(threshold).alias("false_confident_wrong_rate"),
        F.count("*").alias("n"),
        F.count("call").alias("n_called"),
    )


def fcw_curve(long: DataFrame, keys: list[str], n_thresholds: int = 21) -> DataFrame:
    """False-confident-wrong rate over a threshold grid, abstentions swept by their nearest label.

    One aggregate with a conditional mean per threshold; rows are not repeated per threshold.
    """
    grid = linear_grid(n_thresholds)
    wide = long.groupBy(*keys).agg(
        *[false_confident_wrong(t, scored_label()).alias(f"t{i}") for i, t in enumerate(grid)]
    )
    points = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("fcw")) for i, t in enumerate(grid)]))
    return wide.select(*keys, points.alias("p")).select(*keys, "p.*")


def subset_scores(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    return rank_scores(evaluation_subsets(long), ["holdout_fraction", "subset", "method", "rank"], threshold)


def comparison_table(scores: DataFrame, fraction: float | None = None) -> DataFrame:
    """16 rows, method × rank: all queries beside novel ones; a method that did not run has nulls."""
    spark = scores.sparkSession
    picked = scores if fraction is None else scores.where(F.abs(F.col("holdout_fraction") - fraction) < 1e-9)
    wide = picked.groupBy("method", "rank").pivot("subset", ["all", "novel"]).agg(
        F.first("accuracy").alias("accuracy"), F.first("false_confident_wrong_rate").alias("fcw")
    )
    grid = spark.createDataFrame([(m, r) for m in METHODS for r in RANKS], "method string, rank string")
    return grid.join(wide, ["method", "rank"], "left").select(
        "method",
        "rank",
        F.col("all_accuracy").alias("accuracy"),
        F.col("all_fcw").alias("false_confident_wrong_rate"),
        F.col("novel_accuracy").alias("accuracy_novel"),
        F.col("novel_fcw").alias("false_confident_wrong_rate_novel"),
    )


def table_fraction(fractions: DataFrame, wanted: float) -> float:
    """The configured fraction if it was run, else the middle one in run order."""
    held = [r[0] for r in fractions.select("holdout_fraction").distinct().orderBy("holdout_fraction").collect()]
    if not held:
        raise ValueError("no fraction was evaluated")
    return next((f for f in held if abs(f - wanted) < 1e-9), held[len(held) // 2])


# --- fallback and base classifier ----------------------------------------------------------


def classifier_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy per (fraction, split, rank) of a method that always answers."""
    means = [F.avg((F.col(r) == F.col(f"true_{r}")).cast("double")).alias(r) for r in RANKS]
    wide = predictions.groupBy("holdout_fraction", "split").agg(F.count("*").alias("n"), *means)
    return wide.unpivot(["holdout_fraction", "split", "n"], list(RANKS), "rank", "accuracy")


def novelty_rates(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Share flagged novel and share without any committed rank."""
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(F.col("is_novel")).alias("novelty_rate"),
        share(F.col("predicted_rank").isNull()).alias("abstention_rate"),
    )


def resolved_by_rank(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Count and accuracy of the queries committed at each rank; an unused rank has count 0."""
    at = {r: F.col("predicted_rank") == r for r in RANKS}
    wide = predictions.groupBy(*keys).agg(
        *[F.count_if(at[r]).alias(f"n_{r}") for r in RANKS],
        *[F.avg(F.when(at[r], (F.col(r) == F.col(f"true_{r}")).cast("double"))).alias(f"a_{r}") for r in RANKS],
    )
    rows = F.explode(
        F.array(*[
            F.struct(F.lit(r).alias("rank"), F.col(f"n_{r}").alias("resolved_count"), F.col(f"a_{r}").alias("resolved_accuracy"))
            for r in RANKS
        ])
    )
    return wide.select(*keys, rows.alias("r")).select(*keys, "r.*")


def seen_species_rates(predictions: DataFrame) -> DataFrame:
    """Validation rows: how often a seen species is flagged novel, and accuracy of species calls."""
    species = F.col("predicted_rank") == "species"
    return predictions.where(F.col("split") == "val").groupBy("holdout_fraction").agg(
        share(F.col("is_novel")).alias("false_novelty_flag_rate"),
        F.avg(F.when(species, (F.col("species") == F.col("true_species")).cast("double"))).alias("species_accuracy_when_confident"),
    )
