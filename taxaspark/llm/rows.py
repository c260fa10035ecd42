"""Row positions without a single-task sort, connected components, and large groups in bounded cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.session import stage

ROWS_PER_RANGE = 1_000_000
_RANGE_BITS = 33  # monotonically_increasing_id: partition above, row below


def positions(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add long ``name``: the row's place, from 0, among its group by ``order``; ``group`` may be empty.

    Ranges of the whole order are sorted side by side, so a group of any size spreads over as many of them as it
    needs; a table of one row per (range, group) gives where each run starts. ``df`` must be cheap to read twice.
    """
    spark = df.sparkSession
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_RANGE))
    keys = [F.col(c) for c in group] + list(order)
    at, run = f"__{name}_at", f"__{name}_range"
    ranged = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    ranged = stage(ranged, "ranged").withColumn(run, F.shiftright(F.col(at), _RANGE_BITS))
    runs = ranged.groupBy(*group, run).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col(run).alias("__r"), (before - F.col("__first")).alias("__shift"))
    same = F.col(run) == F.col("__r")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return ranged.join(runs, same).withColumn(name, F.col(at) + F.col("__shift")).drop(at, run, "__r", "__shift", *[f"__g{i}" for i in range(len(group))])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge; nulls and loops are no edges.

    Alternating large and small stars; every round is a grouped minimum and a join, written to shared scratch.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()
    now, print_ = _written(now)
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("u"), F.least("x", "m").alias("m"))
        large = both.join(least, F.col("x") == F.col("u")).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "u")
        small = large.join(least, F.col("x") == F.col("u")).select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        small, print_now = _written(small.select("e.*").where("x <> y").distinct())
        if print_now == print_:
            roots = small.select(F.col("x").alias("node"), F.col("y").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        now, print_ = small, print_now


def _written(df: DataFrame):
    df = stage(df, "stars")
    return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def whole_groups(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches → frames that hold all rows of every group in them; the last group waits for the next batch."""
    rest = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if frame.empty:
            continue
        same = (frame[order] == frame[order].iloc[-1]).all(axis=1).to_numpy()
        start = 0 if same.all() else len(frame) - int(np.argmin(same[::-1]))
        rest = frame.iloc[start:]
        if start:
            yield frame.iloc[:start]
    if rest is not None:
        yield rest


def group_edges(frame: pd.DataFrame, order: list[str]) -> np.ndarray:
    """Where groups of a sorted frame begin, and its length."""
    return np.flatnonzero(np.concatenate(([True], (frame[order].iloc[1:].to_numpy() != frame[order].iloc[:-1].to_numpy()).any(axis=1), [True])))


def cells(df: DataFrame, group: list[str], by: str, rows: int) -> DataFrame:
    """Cut groups of more than ``rows`` rows by a hash of ``by`` into parts; each pair of parts (i <= j) is a cell.

    Adds part, i and j, a row once for each cell it is in; every pair of rows meets in one cell, or in (i, i).
    """
    sizes = df.groupBy(*group).agg((F.floor((F.count("*") - 1) / rows) + 1).cast("int").alias("parts")).where("parts > 1")
    cut = df.join(sizes, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")
