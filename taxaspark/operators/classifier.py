"""Nearest species centroid under per-query min-max normalised distances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.operators.cells import cell_join
from taxaspark.operators.centroids import fit_centroids
from taxaspark.operators.nearest import LabelSet, floats, full_distances, haversine_matrix, label_count, matrix
from taxaspark.session import fits_broadcast, stage

_CHUNK_CELLS = 1_000_000
_CALL = ("species", "genus", "family", "order")


@dataclass(frozen=True)
class ClassifierModel:
    centroids: DataFrame  # species rank only, sorted labels define the distance vector
    seq_weight: float
    geo_weight: float


def fit(train: DataFrame, seq_weight: float = 0.8, geo_weight: float = 0.2) -> ClassifierModel:
    total = seq_weight + geo_weight
    return ClassifierModel(fit_centroids(train, ("species",)), seq_weight / total, geo_weight / total)


def min_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Row-wise (v - low) / (high - low); a flat or undefined range gives zeros."""
    width = high - low
    flat = ~np.isfinite(width) | (width < 1e-12)
    scaled = (values - low[:, None]) / np.where(flat, 1.0, width)[:, None]
    return np.where(flat[:, None], 0.0, scaled)


def _raw(q, c, q_geo, c_geo):
    seq = full_distances(q, c)
    return seq, haversine_matrix(q_geo[:, 0], q_geo[:, 1], c_geo[:, 0], c_geo[:, 1])


def _extent(values: np.ndarray):
    """Row minimum and maximum over known entries, NaN where none is known."""
    known = ~np.isnan(values)
    low = np.where(known, values, np.inf).min(axis=1, initial=np.inf)
    high = np.where(known, values, -np.inf).max(axis=1, initial=-np.inf)
    none = ~known.any(axis=1)
    return np.where(none, np.nan, low), np.where(none, np.nan, high)


def _combine(seq, geo, extents, weights):
    seq_norm = min_max(seq, *extents[:2])
    geo_norm = min_max(geo, *extents[2:])
    return np.where(np.isnan(geo), seq_norm, weights[0] * seq_norm + weights[1] * geo_norm)


def _strips(batch, labels: LabelSet):
    """(query rows, label span, raw distances) in bounded strips, per fraction."""
    fraction = floats(batch.column("holdout_fraction"))
    vec = matrix(batch.column("vec"))
    geo = np.column_stack([floats(batch.column("lat")), floats(batch.column("lon"))])
    for f in np.unique(fraction):
        lo, hi = labels.spans.get(float(f), {}).get("species", (0, 0))
        if lo == hi:
            continue
        at = np.flatnonzero(fraction == f)
        step = max(1, _CHUNK_CELLS // (hi - lo))
        for start in range(0, len(at), step):
            rows = at[start : start + step]
            yield rows, (lo, hi), _raw(vec[rows], labels.vec[lo:hi], geo[rows], labels.geo[lo:hi])


def predict(model: ClassifierModel, queries: DataFrame, distances: bool = False,
            broadcast_bytes: int | None = None) -> DataFrame:
    """Taxa of the nearest species and its combined distance; with ``distances`` the whole vector."""
    rows, row_bytes = label_count(model.centroids)
    limit = {} if broadcast_bytes is None else {"limit": broadcast_bytes}
    keys = [c for c in queries.columns if c not in ("vec", *_CALL)]
    truth = [F.col(r).alias(f"true_{r}") for r in _CALL if r in queries.columns]
    queries = queries.select(*keys, "vec", *truth)
    if fits_broadcast(rows, row_bytes, **limit):
        return _by_broadcast(model, queries, distances)
    return _by_cells(model, queries, distances, row_bytes)


def _by_broadcast(model, queries, distances):
    shared = queries.sparkSession.sparkContext.broadcast(model.centroids.toArrow())
    weights = (model.seq_weight, model.geo_weight)
    passed = [f for f in queries.schema.fields if f.name != "vec"]
    names = [f.name for f in passed]

    def scan(batches):
        labels = LabelSet(shared.value)
        for batch in batches:
            best = np.full(batch.num_rows, -1)
            dist = np.full(batch.num_rows, np.nan)
            vectors = [None] * batch.num_rows
            for at, (lo, _), (seq, geo) in _strips(batch, labels):
                combined = _combine(seq, geo, (*_extent(seq), *_extent(geo)), weights)
                j = combined.argmin(axis=1)
                best[at], dist[at] = j + lo, combined[np.arange(len(at)), j]
                if distances:
                    for i, row in zip(at, combined):
                        vectors[i] = row
            picked = pa.array(np.maximum(best, 0), mask=best < 0)
            cols = [labels.text[c].take(picked) for c in ("label", "genus", "family", "order")]
            cols.append(pa.array(dist, mask=best < 0))
            extra = [pa.array(vectors, type=pa.list_(pa.float64()))] if distances else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + cols + extra,
                names=[*names, *_CALL, "nearest_distance"] + (["distances"] if distances else []),
            )

    fields = passed + [T.StructField(c, T.StringType()) for c in _CALL]
    fields.append(T.StructField("nearest_distance", T.DoubleType()))
    if distances:
        fields.append(T.StructField("distances", T.ArrayType(T.DoubleType())))
    return queries.mapInArrow(scan, T.StructType(fields))


_EXTENTS = ("seq_lo", "seq_hi", "geo_lo", "geo_hi")


def _by_cells(model, queries, distances, row_bytes):
    """Two rounds over the cells: the normalising ranges first, then the nearest label."""
    weights = (model.seq_weight, model.geo_weight)
    key = ["holdout_fraction", "process_id"]
    queries = stage(queries, "classify")
    slim = queries.select(*key, "lat", "lon", "vec")

    def extents(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            for at, _, (seq, geo) in _strips(left.combine_chunks(), LabelSet(right)):
                found.append((at, *_extent(seq), *_extent(geo)))
        at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
        cols = [left[k].take(pa.array(at)) for k in key]
        for i in range(1, 5):
            v = np.concatenate([f[i] for f in found]) if found else np.zeros(0)
            cols.append(pa.array(v, mask=np.isnan(v)))
        return pa.table(cols, names=[*key, *_EXTENTS])

    schema = "holdout_fraction double, process_id string, " + ", ".join(f"{c} double" for c in _EXTENTS)
    ranges = cell_join(slim, model.centroids, extents, schema, row_bytes).groupBy(*key).agg(
        *[(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in _EXTENTS]
    )

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in (*key, "distance", *_CALL, "labels", "vector")}
        if left.num_rows and right.num_rows:
            labels = LabelSet(right)
            bounds = [floats(left[c]) for c in _EXTENTS]
            for at, (lo, hi), (seq, geo) in _strips(left.combine_chunks(), labels):
                combined = _combine(seq, geo, [b[at] for b in bounds], weights)
                j = combined.argmin(axis=1)
                picked = pa.array(j + lo)
                for k in key:
                    out[k] += left[k].take(pa.array(at)).to_pylist()
                out["distance"] += combined[np.arange(len(at)), j].tolist()
                for c, source in zip(_CALL, ("label", "genus", "family", "order")):
                    out[c] += labels.text[source].take(picked).to_pylist()
                named = labels.text["label"].slice(lo, hi - lo).to_pylist() if distances else None
                out["labels"] += [named] * len(at)
                out["vector"] += list(combined) if distances else [None] * len(at)
        types = [pa.float64(), pa.string(), pa.float64()] + [pa.string()] * 4 + [pa.list_(pa.string()), pa.list_(pa.float64())]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    schema = ("holdout_fraction double, process_id string, distance double, species string, genus string, "
              "family string, `order` string, labels array<string>, vector array<double>")
    cells = cell_join(slim.join(ranges, key), model.centroids, nearest, schema, row_bytes)
    best = F.min(F.struct("distance", *_CALL)).alias("best")
    parts = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("labels", "vector")))).alias("all")
    merged = cells.groupBy(*key).agg(best, *([parts] if distances else []))
    picked = [F.col(f"best.{c}").alias(c) for c in _CALL] + [F.col("best.distance").alias("nearest_distance")]
    if distances:
        picked.append(F.transform("all", lambda x: x["vector"]).alias("distances"))
    kept = [c for c in queries.columns if c not in ("vec", *key)]
    return queries.drop("vec").join(merged.select(*key, *picked), key, "left").select(
        *key, *kept, *_CALL, "nearest_distance", *(["distances"] if distances else [])
    )
