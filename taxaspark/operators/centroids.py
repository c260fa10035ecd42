"""Class centroids at every rank and the typical spacing between them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.functions.geo import EARTH_RADIUS_KM
from taxaspark.operators.cells import cell_join
from taxaspark.operators.nearest import LABEL_COLUMNS, direct_distance, floats, haversine_matrix, label_count, matrix
from taxaspark.operators.quantiles import refine_quantile
from taxaspark.session import fits_broadcast, stage, task_count

_PAIR_CHUNK = 500_000
SPACING_BINS = 1 << 13  # of a pass over the label pairs; two passes tell distances 2^-26 of the range apart


def lineage_sums(train: DataFrame) -> DataFrame:
    """One row per (fraction, lineage): vector sum, counts and coordinate sums.

    The only pass over the rows; it combines map-side, so a species that holds a third of them
    shuffles one row per task. Every rank's centroid rolls up from here.
    """
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return train.groupBy("holdout_fraction", *RANKS).agg(
        Summarizer.sum(array_to_vector("vec")).alias("total"),
        F.count("*").alias("support"),
        F.sum(F.when(both, F.col("lat"))).alias("lat_sum"),
        F.sum(F.when(both, F.col("lon"))).alias("lon_sum"),
        F.count_if(both).alias("geo_n"),
        F.min("process_id").alias("first_id"),
    )


def _above(rank: str) -> list[Column]:
    """Lineage columns of the first row, null below ``rank``."""
    depth = RANKS.index(rank)
    return [
        F.col(f"first.{r}").alias(r) if RANKS.index(r) >= depth else F.lit(None).cast("string").alias(r)
        for r in RANKS
    ]


def rank_centroids(lineages: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """Centroid, support, geographic mean and upper taxonomy per (fraction, rank, label)."""

    def at(rank: str) -> DataFrame:
        # First row wins: the lineage of the smallest process_id.
        grouped = lineages.groupBy("holdout_fraction", F.col(rank).alias("label")).agg(
            Summarizer.sum(F.col("total")).alias("total"),
            F.sum("support").alias("support"),
            F.sum("lat_sum").alias("lat_sum"),
            F.sum("lon_sum").alias("lon_sum"),
            F.sum("geo_n").alias("geo_n"),
            F.min(F.struct("first_id", *RANKS)).alias("first"),
        )
        return grouped.select(
            "holdout_fraction",
            F.lit(rank).alias("rank"),
            "label",
            "support",
            *_above(rank),
            F.when(F.col("geo_n") > 0, F.col("lat_sum") / F.col("geo_n")).alias("lat"),
            F.when(F.col("geo_n") > 0, F.col("lon_sum") / F.col("geo_n")).alias("lon"),
            F.transform(vector_to_array("total"), lambda x: x / F.col("support")).alias("vec"),
        )

    return reduce(DataFrame.unionByName, [at(r) for r in ranks])


def fit_centroids(train: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    lineages = stage(lineage_sums(train), "lineages")
    return stage(rank_centroids(lineages, ranks).select(*LABEL_COLUMNS), "centroids")


def _pair_values(a_vec, a_geo, a_label, b_vec, b_geo, b_label, kind: str):
    """Distances of label pairs a < b, a bounded strip of rows at a time."""
    step = max(1, _PAIR_CHUNK // max(len(b_label), 1))
    for start in range(0, len(a_label), step):
        part = slice(start, start + step)
        r, j = np.nonzero(a_label[part][:, None] < b_label[None, :])
        if kind == "vec":
            for lo in range(0, len(r), 20_000):
                yield direct_distance(a_vec[part][r[lo : lo + 20_000]], b_vec[j[lo : lo + 20_000]])
        else:
            km = haversine_matrix(a_geo[part, 0], a_geo[part, 1], b_geo[:, 0], b_geo[:, 1])[r, j]
            yield km[~np.isnan(km)]


def _strip_histogram(left, right, brackets: dict) -> list[tuple]:
    """Bin counts of the pair distances between two label tables, per (fraction, rank, kind)."""
    out = []
    sides = [_by_group(t) for t in (left, right)]
    for group, a in sides[0].items():
        b = sides[1].get(group)
        for kind in ("vec", "geo"):
            bounds = brackets.get((*group, kind))
            if b is None or bounds is None:
                continue
            low, high = bounds
            n = np.zeros(SPACING_BINS, np.int64)
            lo, hi = np.full(SPACING_BINS, np.inf), np.full(SPACING_BINS, -np.inf)
            for d in _pair_values(*a, *b, kind):
                d = d[(d >= low) & (d <= high)]
                bins = np.minimum(SPACING_BINS - 1, (d - low) / (high - low) * SPACING_BINS).astype(int)
                n += np.bincount(bins, minlength=SPACING_BINS)
                np.minimum.at(lo, bins, d)
                np.maximum.at(hi, bins, d)
            out += [(*group, kind, int(i), int(n[i]), lo[i], hi[i]) for i in np.flatnonzero(n)]
    return out


def _by_group(table) -> dict:
    label = np.array(table.column("label").to_pylist(), dtype=object)
    rank = np.array(table.column("rank").to_pylist(), dtype=object)
    fraction = floats(table.column("holdout_fraction"))
    vec = matrix(table.column("vec"))
    geo = np.column_stack([floats(table.column("lat")), floats(table.column("lon"))])
    groups = {}
    for f, r in sorted(set(zip(fraction.tolist(), rank.tolist()))):
        at = np.flatnonzero((fraction == f) & (rank == r))
        groups[(f, r)] = (vec[at], geo[at], label[at])
    return groups


_STRIP = "holdout_fraction double, rank string, kind string, bin int, n bigint, lo double, hi double"


def _strip_table(rows: list[tuple]) -> pa.Table:
    names = ["holdout_fraction", "rank", "kind", "bin", "n", "lo", "hi"]
    types = [pa.float64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def centroid_spacing(centroids: DataFrame, broadcast_bytes: int | None = None) -> dict:
    """(fraction, rank) -> (sequence scale, geographic scale or None).

    Median distance over all label pairs of a rank. Fewer than two labels, or a median of exactly
    zero, gives sequence scale 1; fewer than two located labels gives no geographic scale.

    All pairs are gone through twice: once in bins over a range no distance can leave (the diagonal of the box around
    the labels, half the earth's girth), once in bins over the bin that holds the median. Only where that many bins
    still leave several values beside it is there a third pass.
    """
    spark = centroids.sparkSession
    slim = centroids.select("holdout_fraction", "rank", "label", "lat", "lon", "vec")
    rows, row_bytes = label_count(slim)
    limit = {} if broadcast_bytes is None else {"limit": broadcast_bytes}
    small = fits_broadcast(rows, row_bytes, **limit)
    shared = spark.sparkContext.broadcast(slim.toArrow()) if small else None
    # A scan task takes an even share of the label rows; the triangle is balanced by hashing.
    spread = slim.repartition(task_count(spark), "label", "rank", "holdout_fraction") if small else slim

    def histogram(brackets: dict) -> dict:
        if small:

            def scan(batches):
                for batch in batches:
                    yield from _strip_table(_strip_histogram(batch, shared.value, brackets)).to_batches()

            counted = spread.mapInArrow(scan, _STRIP)
        else:

            def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
                return _strip_table(_strip_histogram(left, right, brackets) if left.num_rows and right.num_rows else [])

            counted = cell_join(slim, slim, kernel, _STRIP, row_bytes)
        merged = counted.groupBy("holdout_fraction", "rank", "kind", "bin").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        out: dict = {k: [] for k in brackets}
        for r in merged.collect():
            out[(r.holdout_fraction, r["rank"], r.kind)].append((r.bin, r.n, r.lo, r.hi))
        return out

    vec = array_to_vector("vec")
    sizes = slim.groupBy("holdout_fraction", "rank").agg(
        F.count("*").alias("n"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("n_geo"),
        Summarizer.min(vec).alias("low"), Summarizer.max(vec).alias("high"),
    ).collect()
    groups = [(r.holdout_fraction, r["rank"]) for r in sizes]
    extents = {}
    for g, r in zip(groups, sizes):
        box = float(np.linalg.norm(r.high.toArray() - r.low.toArray()))
        for kind, n, most in (("vec", r.n, box), ("geo", r.n_geo, np.pi * EARTH_RADIUS_KM)):
            if n >= 2:
                extents[(*g, kind)] = (0.0, most * (1 + 1e-9), n * (n - 1) // 2)
    medians = refine_quantile(extents, 0.5, histogram)
    spacing = {}
    for g in groups:
        seq, geo = medians.get((*g, "vec")), medians.get((*g, "geo"))
        spacing[g] = (max(seq or 1.0, 1e-9), None if geo is None else max(geo, 1e-9))
    return spacing
