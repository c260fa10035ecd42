"""Isotonic regression of many groups at once, as tables: fitted in a tree of tasks, applied by a range join.

Pooling adjacent violators can be done piece by piece: runs of rows pooled on their own, put in order and pooled again
give what pooling all rows gives. So sorted ranges of rows are pooled side by side into blocks, sixteen neighbouring
ranges of blocks into one, and so on, until a group's blocks are in one task. Nothing of a fit is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.session import fits_broadcast, stage, task_count

FAN_IN = 16
BUCKETS = 1024  # of the scores from 0 to 1, so that a score meets the few segments around it
_BLOCK = ("low", "high", "n", "hits")


def pooled_scores(rows: DataFrame, keys: list[str], score: str = "confidence", outcome: str = "correct") -> DataFrame:
    """(keys, low, high, n, hits): a block for every different score; rows without a score or outcome have none."""
    x, y = F.col(score).cast("double"), F.col(outcome).cast("double")
    kept = rows.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x))
    found = kept.groupBy(*keys, x.alias("low")).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("hits"))
    return found.select(*keys, "low", F.col("low").alias("high"), "n", "hits")


def _pool(blocks: list[list[float]], low: float, high: float, n: float, hits: float) -> None:
    """Add a block at the end; while the one before it has no lower mean, the two are one."""
    while blocks and blocks[-1][3] * n >= hits * blocks[-1][2]:
        before = blocks.pop()
        low, n, hits = before[0], before[2] + n, before[3] + hits
    blocks.append([low, high, n, hits])


def _pooled(ordered: DataFrame, keys: list[str], finish, out: T.StructType) -> DataFrame:
    """Pool the sorted rows of each partition; ``finish`` makes a group's rows of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, types = None, [], [pa.float64()] * 4

        def told():
            made = [(*now, *row) for row in finish(blocks)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=out.names)

        for batch in batches:
            types = [c.type for c in batch.columns[: len(keys)]] + [pa.float64()] * 4
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                key = row[: len(keys)]
                if key != now:
                    if blocks:
                        yield told()
                    now, blocks = key, []
                _pool(blocks, *row[len(keys) :])
        if blocks:
            yield told()

    return ordered.select(*keys, *_BLOCK).mapInArrow(run, out)


def _segments(blocks: list[list[float]]) -> list[tuple]:
    """The fitted curve as [low, high) pieces with the values at both ends; constant before and behind the scores."""
    points = []
    for low, high, n, hits in blocks:
        points += [(low, hits / n)] + ([(high, hits / n)] if high > low else [])
    edges = [(float("-inf"), points[0][1]), *points, (float("inf"), points[-1][1])]
    return [(a[0], b[0], a[1], b[1]) for a, b in zip(edges, edges[1:], strict=False)]


def fit_curves(pooled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, y_low, y_high) of ``pooled_scores``: pieces of each group's curve, linear from end to end.

    A group's curve is held by one task as its blocks, whose means rise strictly.
    """
    spark = pooled.sparkSession
    fields = [pooled.schema[k] for k in keys]
    block = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in _BLOCK])
    curve = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in ("low", "high", "y_low", "y_high")])
    ranges = task_count(spark)
    while True:
        ordered = pooled.repartitionByRange(ranges, *keys, "low").sortWithinPartitions(*keys, "low")
        pooled = stage(_pooled(ordered, keys, lambda blocks: blocks, block), "isotonic-blocks")
        if ranges <= FAN_IN:
            break
        ranges = -(-ranges // FAN_IN)
    dealt = pooled.repartition(*keys) if keys else pooled.coalesce(1)
    return stage(_pooled(dealt.sortWithinPartitions(*keys, "low"), keys, _segments, curve), "isotonic-curves")


def _bucket(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * BUCKETS).cast("int")


def apply_curves(rows: DataFrame, curves: DataFrame, keys: list[str], score: str = "confidence") -> DataFrame:
    """``rows`` with ``score`` read off its group's curve, within 0 and 1; null where there is no curve or no score.

    A piece is filed under all buckets it reaches into, a score under its own, so that the join is by equality.
    """
    pieces = curves.select(*[F.col(k).alias(f"_{k}") for k in keys], "low", "high", "y_low", "y_high",
                           F.explode(F.sequence(_bucket(F.col("low")), _bucket(F.col("high")))).alias("_bucket"))
    if fits_broadcast(curves.count() + BUCKETS, 64):
        pieces = F.broadcast(pieces)
    x = F.col(score).cast("double")
    same = (F.col("_at") == F.col("_bucket")) & (x >= F.col("low")) & (x < F.col("high"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    slope = (F.col("y_high") - F.col("y_low")) / (F.col("high") - F.col("low"))
    flat = F.col("y_low") == F.col("y_high")  # the endless pieces are
    value = F.when(flat, F.col("y_low")).otherwise(F.col("y_low") + slope * (x - F.col("low")))
    found = rows.withColumn("_at", _bucket(x)).join(pieces, same, "left")
    within = F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
    return found.withColumn(score, within).select(*rows.columns)


def recalibrated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their scores remapped by the curve of their group ``by``, fitted on the same rows."""
    return apply_curves(rows, fit_curves(pooled_scores(rows, by), by), by)


def leave_one_out(rows: DataFrame, by: list[str], fold: str = "holdout_fraction") -> DataFrame:
    """Rows with their scores remapped by a curve fitted on the other folds of their group ``by``, all in one job.

    A score is counted once for its fold and then handed to every other one. With a single fold, it is fitted on itself.
    """
    folds = [r[0] for r in rows.select(fold).distinct().collect()]  # a few settings, each of which is a whole split
    if len(folds) < 2:
        return recalibrated(rows, by)
    each = pooled_scores(rows, [*by, fold])
    targets = each.withColumn("_target", F.explode(F.array(*[F.lit(f) for f in folds]))).where(F.col("_target") != F.col(fold))
    others = targets.groupBy(*by, F.col("_target").alias(fold), "low", "high").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return apply_curves(rows, fit_curves(others, [*by, fold]), [*by, fold])
