"""Nearest labelled vectors of each query vector, exactly.

A label table below the broadcast bound is compared inside the query scan, with no shuffle.
A larger one goes through the cell join. Both run the same kernel: one matrix product screens
out labels that cannot be among the nearest, with a margin far above its rounding error, and
the few left get direct differences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.functions.geo import EARTH_RADIUS_KM
from taxaspark.operators.cells import cell_join
from taxaspark.session import fits_broadcast

HIT = "struct<rank:string,label:string,distance:double,support:bigint,species:string,genus:string,family:string,order:string>"
LABEL_COLUMNS = ("holdout_fraction", "rank", "label", "support", "species", "genus", "family", "order", "lat", "lon", "vec")
_HIT_TYPE = pa.struct(
    [("rank", pa.string()), ("label", pa.string()), ("distance", pa.float64()), ("support", pa.int64()),
     ("species", pa.string()), ("genus", pa.string()), ("family", pa.string()), ("order", pa.string())]
)
_CHUNK_CELLS = 2_000_000  # entries of one query × label block held by a kernel
_ROWS = 1024  # queries whose hits a worker holds at once


def _slices(batches):
    """Bounded pieces of each Arrow batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            yield whole.slice(at, _ROWS)


@dataclass(frozen=True)
class Metric:
    """How sequence and geographic distance combine; scales are per (fraction, rank)."""

    seq_weight: float = 1.0
    geo_weight: float = 0.0
    scales: dict | None = None  # (fraction, rank) -> (sequence scale, geographic scale or None)

    def at(self, fraction: float, rank: str) -> tuple[float, float | None]:
        return (self.scales or {}).get((fraction, rank), (1.0, None))


def matrix(column) -> np.ndarray:
    """A list<double> column as an (n, d) matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def floats(column) -> np.ndarray:
    """A double column with nulls as NaN."""
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def haversine_matrix(lat1, lon1, lat2, lon2) -> np.ndarray:
    p1, p2 = np.radians(lat1)[:, None], np.radians(lat2)[None, :]
    half_lon = (np.radians(lon2)[None, :] - np.radians(lon1)[:, None]) / 2
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(half_lon) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0)))


def direct_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distance by direct differences."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def picked_distance(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """``direct_distance`` of picked rows, a bounded number of vectors at a time."""
    step = max(1, _CHUNK_CELLS // max(a.shape[1], 1))
    parts = [direct_distance(a[rows[i : i + step]], b[cols[i : i + step]]) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def nearest_indices(q, c, k, q_geo=None, c_geo=None, weights=(1.0, 0.0), scales=(1.0, None), skip=None):
    """(query row, label row, distance) of the ``k`` nearest labels, ordered; ties go to the smaller label row.

    ``skip`` pairs each query row with a label row to leave out (or -1).
    """
    rows, cols, dists = [], [], []
    step = max(1, _CHUNK_CELLS // max(len(c), 1))
    c_norm = (c * c).sum(axis=1)
    with_geo = scales[1] is not None and q_geo is not None and c_geo is not None
    screen = None if with_geo else _Screen.of(q, c)
    for start in range(0, len(q), step):
        block = q[start : start + step]
        own = None if skip is None else skip[start : start + step]
        take = min(k, len(c))
        geo = None
        if with_geo:
            geo = haversine_matrix(q_geo[start : start + step, 0], q_geo[start : start + step, 1], c_geo[:, 0], c_geo[:, 1]) / scales[1]
        found = screen.candidates(block, take, own) if screen else None
        r, j = found if found else _candidates(block, c, c_norm, take, own, geo, weights, scales[0])
        d = picked_distance(block, r, c, j) / scales[0]
        if geo is not None:
            gj = geo[r, j]
            d = np.where(np.isnan(gj), d, weights[0] * d + weights[1] * gj)
        order = np.lexsort((j, d, r))
        r, j, d = r[order], j[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < k
        rows.append(r[keep] + start)
        cols.append(j[keep])
        dists.append(d[keep])
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _candidates(block, c, c_norm, take, own, geo, weights, scale):
    """(row, label row) pairs that can be among a row's ``take`` nearest, screened in double precision."""
    q_norm = (block * block).sum(axis=1)
    squared = q_norm[:, None] + c_norm[None, :] - 2.0 * (block @ c.T)
    slack = 1e-12 * (q_norm[:, None] + c_norm.max())
    low = np.sqrt(np.maximum(squared - slack, 0.0)) / scale
    high = np.sqrt(np.maximum(squared + slack, 0.0)) / scale
    if geo is not None:
        known = ~np.isnan(geo)
        low = np.where(known, weights[0] * low + weights[1] * geo, low)
        high = np.where(known, weights[0] * high + weights[1] * geo, high)
    if own is not None:
        hit = np.flatnonzero(own >= 0)
        low[hit, own[hit]] = np.inf
        high[hit, own[hit]] = np.inf
    bound = np.partition(high, take - 1, axis=1)[:, take - 1]
    return np.nonzero((low <= bound[:, None] * (1 + 1e-12)) & np.isfinite(low))


class _Screen:
    """The same for plain distances, in single precision: one product gives |c|^2/2 - q.c of vectors that are moved to the
    labels' middle and brought to length 1 at most.

    What stays within twice the largest rounding error of a row's ``take`` least values are its candidates.
    """

    def __init__(self, c: np.ndarray, middle: np.ndarray, scale: float):
        self.middle, self.scale = middle, scale
        moved = (c - middle) / -scale
        norm = np.einsum("ij,ij->i", moved, moved)
        self.longest = float(np.sqrt(norm.max()))
        self.right = np.column_stack([moved, norm / 2]).astype(np.float32).T
        self.unit = 4.0 * (c.shape[1] + 8) * 2.0**-24

    @staticmethod
    def of(q: np.ndarray, c: np.ndarray) -> "_Screen | None":
        """None for few pairs, and where lengths are not usual numbers."""
        if len(q) * len(c) < 4096 or not c.shape[1]:
            return None
        middle = c.mean(axis=0)
        scale = float(max(np.abs(q - middle).max(), np.abs(c - middle).max())) * c.shape[1] ** 0.5
        return _Screen(c, middle, scale) if 1e-100 < scale < 1e100 else None

    def candidates(self, block: np.ndarray, take: int, own) -> tuple[np.ndarray, np.ndarray] | None:
        """None where too many are left, as with labels that are all but equal."""
        moved = (block - self.middle) / self.scale
        value = np.column_stack([moved, np.ones(len(block))]).astype(np.float32) @ self.right
        if own is not None:
            hit = np.flatnonzero(own >= 0)
            value[hit, own[hit]] = np.inf
        least = value.min(axis=1) if take == 1 else np.partition(value, take - 1, axis=1)[:, take - 1]
        length = np.sqrt(np.einsum("ij,ij->i", moved, moved))
        bound = least.astype(np.float64) + self.unit * self.longest * (length + self.longest) + 1e-30
        # Rounded up, so that the comparison stays in single precision.
        limit = np.nextafter(bound.astype(np.float32), np.float32(np.inf))
        at = np.flatnonzero(value <= limit[:, None])
        if len(at) > 16 * take * len(block):
            return None
        r, j = np.divmod(at, value.shape[1])
        if own is not None:
            real = j != own[r]
            r, j = r[real], j[real]
        return r, j


class LabelSet:
    """Label rows as arrays, grouped by (fraction, rank) and sorted by label."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("holdout_fraction", "ascending"), ("rank", "ascending"), ("label", "ascending")])
        self.vec = matrix(table["vec"])
        self.geo = np.column_stack([floats(table["lat"]), floats(table["lon"])])
        self.text = {c: table[c].combine_chunks() for c in ("rank", "label", "species", "genus", "family", "order")}
        self.support = table["support"].combine_chunks()
        fractions, ranks = floats(table["holdout_fraction"]), table["rank"].to_pylist()
        self._positions: dict = {}
        self.spans: dict[float, dict[str, tuple[int, int]]] = {}
        for i, (f, r) in enumerate(zip(fractions, ranks)):
            at = self.spans.setdefault(float(f), {})
            at[r] = (at.get(r, (i,))[0], i + 1)

    def hits(self, rows: np.ndarray, distance: np.ndarray) -> pa.StructArray:
        picked = pa.array(rows)
        t = {c: v.take(picked) for c, v in self.text.items()}
        return pa.StructArray.from_arrays(
            [t["rank"], t["label"], pa.array(distance), self.support.take(picked), t["species"], t["genus"], t["family"], t["order"]],
            fields=list(_HIT_TYPE),
        )

    def positions(self, fraction: float, rank: str) -> dict[str, int]:
        """Label -> place within its group."""
        key = (fraction, rank)
        if key not in self._positions:
            lo, hi = self.spans[fraction][rank]
            self._positions[key] = {v: i for i, v in enumerate(self.text["label"].slice(lo, hi - lo).to_pylist())}
        return self._positions[key]


def hits_of_batch(batch, labels: LabelSet, metric: Metric, k_by_rank: dict[str, int], skip_self: bool) -> pa.ListArray:
    """list<hit> per query row: for each rank its k nearest labels in order."""
    fraction = floats(batch.column("holdout_fraction"))
    vec = matrix(batch.column("vec"))
    geo = np.column_stack([floats(batch.column("lat")), floats(batch.column("lon"))])
    ids = batch.column("process_id").to_pylist() if skip_self else None
    found = []
    for f in np.unique(fraction):
        at = np.flatnonzero(fraction == f)
        for place, (rank, k) in enumerate(k_by_rank.items()):
            lo, hi = labels.spans.get(float(f), {}).get(rank, (0, 0))
            if lo == hi:
                continue
            skip = None
            if skip_self:
                own = labels.positions(float(f), rank)
                skip = np.array([own.get(ids[i], -1) for i in at])
            r, j, d = nearest_indices(
                vec[at], labels.vec[lo:hi], k, geo[at], labels.geo[lo:hi],
                (metric.seq_weight, metric.geo_weight), metric.at(float(f), rank), skip,
            )
            found.append((at[r], np.full(len(r), place), np.arange(len(r)), j + lo, d))
    if not found:
        return pa.array([[]] * len(fraction), type=pa.list_(_HIT_TYPE))
    row, place, seq, label, dist = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((seq, place, row))
    offsets = np.searchsorted(row[order], np.arange(len(fraction) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), labels.hits(label[order], dist[order]))


def label_count(labels: DataFrame) -> tuple[int, int]:
    """(rows, bytes of one row) of a label table."""
    r = labels.agg(F.count("*"), F.max(F.size("vec"))).first()
    return r[0], 8 * (r[1] or 0) + 200


@dataclass(frozen=True)
class SharedLabels:
    """A label table measured once, and broadcast if it is small enough; for many searches of the same labels."""

    table: DataFrame
    row_bytes: int
    data: object | None  # broadcast Arrow table


def share_labels(labels: DataFrame, broadcast_bytes: int | None = None) -> SharedLabels:
    table = labels.select(*LABEL_COLUMNS)
    rows, row_bytes = label_count(table)
    limit = {} if broadcast_bytes is None else {"limit": broadcast_bytes}
    small = fits_broadcast(rows, row_bytes, **limit)
    return SharedLabels(table, row_bytes, table.sparkSession.sparkContext.broadcast(table.toArrow()) if small else None)


def nearest_hits(queries: DataFrame, labels: DataFrame | SharedLabels, k_by_rank: dict[str, int], metric: Metric = Metric(),
                 skip_self: bool = False, broadcast_bytes: int | None = None) -> DataFrame:
    """``queries`` (holdout_fraction, process_id, lat, lon, vec, …) with ``hits`` in place of ``vec``."""
    if not isinstance(labels, SharedLabels):
        labels = share_labels(labels, broadcast_bytes)
    passed = [f for f in queries.schema.fields if f.name != "vec"]
    if labels.data is not None:
        return _by_broadcast(queries, labels.data, k_by_rank, metric, skip_self, passed)
    return _by_cells(queries, labels.table, k_by_rank, metric, skip_self, labels.row_bytes)


def _by_broadcast(queries, shared, k_by_rank, metric, skip_self, passed):
    names = [f.name for f in passed]

    def scan(batches):
        label_set = LabelSet(shared.value)
        for batch in _slices(batches):
            hits = hits_of_batch(batch, label_set, metric, k_by_rank, skip_self)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [hits], names=[*names, "hits"])

    out = T.StructType(passed + [T.StructField("hits", T.ArrayType(T.StructType.fromDDL(HIT)))])
    return queries.mapInArrow(scan, out)


def _by_cells(queries, labels, k_by_rank, metric, skip_self, row_bytes):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"holdout_fraction": pa.array([], pa.float64()), "process_id": pa.array([], pa.string()),
                             "part": pa.array([], pa.list_(_HIT_TYPE))})
        hits = hits_of_batch(left.combine_chunks(), LabelSet(right), metric, k_by_rank, skip_self)
        return pa.table({"holdout_fraction": left["holdout_fraction"], "process_id": left["process_id"], "part": hits})

    slim = queries.select("holdout_fraction", "process_id", "lat", "lon", "vec")
    schema = f"holdout_fraction double, process_id string, part array<{HIT}>"
    parts = cell_join(slim, labels, kernel, schema, row_bytes, within="holdout_fraction")
    # One row per (query, column band), each with at most sum(k) hits.
    merged = parts.groupBy("holdout_fraction", "process_id").agg(F.flatten(F.collect_list("part")).alias("part"))

    def best(rank: str, k: int):
        of_rank = F.filter("part", lambda h: h["rank"] == rank)
        keyed = F.transform(of_rank, lambda h: F.struct(h["distance"].alias("d"), h["label"].alias("l"), h.alias("h")))
        return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["h"])

    hits = F.concat(*[best(rank, k) for rank, k in k_by_rank.items()]).cast(f"array<{HIT}>")
    kept = [c for c in queries.columns if c not in ("vec", "holdout_fraction", "process_id")]
    return queries.drop("vec").join(
        merged.select("holdout_fraction", "process_id", hits.alias("hits")), ["holdout_fraction", "process_id"], "left"
    ).select("holdout_fraction", "process_id", *kept, F.coalesce("hits", F.array().cast(f"array<{HIT}>")).alias("hits"))


PROFILE = ("n_labels", "total", "squares", "least", "most")


def _profile_of_batch(batch, labels: LabelSet, metric: Metric, ranks: tuple[str, ...]) -> list[tuple]:
    """(rows, rank, *PROFILE) arrays of a query batch over all labels of each rank; a strip of queries at a time."""
    fraction, vec = floats(batch["holdout_fraction"]), matrix(batch["vec"])
    geo = np.column_stack([floats(batch["lat"]), floats(batch["lon"])])
    found = []
    for f in np.unique(fraction):
        here = np.flatnonzero(fraction == f)
        for rank in ranks:
            lo, hi = labels.spans.get(float(f), {}).get(rank, (0, 0))
            step = max(1, _CHUNK_CELLS // max(hi - lo, 1))
            for at in (here[i : i + step] for i in range(0, len(here) if hi > lo else 0, step)):
                seq_scale, geo_scale = metric.at(float(f), rank)
                d = full_distances(vec[at], labels.vec[lo:hi]) / seq_scale
                if geo_scale is not None:
                    g = haversine_matrix(geo[at, 0], geo[at, 1], labels.geo[lo:hi, 0], labels.geo[lo:hi, 1]) / geo_scale
                    d = np.where(np.isnan(g), d, metric.seq_weight * d + metric.geo_weight * g)
                found.append((at, [rank] * len(at), np.full(len(at), hi - lo), d.sum(axis=1), (d * d).sum(axis=1), d.min(axis=1), d.max(axis=1)))
    return found


def distance_profiles(queries: DataFrame, labels: DataFrame, ranks: tuple[str, ...], metric: Metric = Metric(),
                      broadcast_bytes: int | None = None) -> DataFrame:
    """(holdout_fraction, process_id, rank, n_labels, total, squares, least, most) over a query's distances to all labels.

    Every distance is computed and none is a row: what leaves a task are sums and extremes, which add up over any
    cells, so the result has one row per query and rank however many labels there are. A rank without labels has none.
    """
    key = ["holdout_fraction", "process_id"]
    types = [pa.int64()] + 4 * [pa.float64()]
    schema = "holdout_fraction double, process_id string, rank string, n_labels long, total double, squares double, least double, most double"

    def table_of(batch, found) -> list[pa.Array]:
        at = pa.array(np.concatenate([x[0] for x in found]) if found else np.zeros(0, int), pa.int64())
        rank = pa.array([r for x in found for r in x[1]], pa.string())
        rest = [pa.array(np.concatenate([x[i] for x in found]) if found else [], t) for i, t in enumerate(types, 2)]
        picked = [batch[c].combine_chunks() if isinstance(batch[c], pa.ChunkedArray) else batch[c] for c in key]
        return [*(c.take(at) for c in picked), rank, *rest]

    labels, slim = labels.select(*LABEL_COLUMNS), queries.select(*key, "lat", "lon", "vec")
    rows, row_bytes = label_count(labels)
    names = [*key, "rank", *PROFILE]
    if fits_broadcast(rows, row_bytes, **({} if broadcast_bytes is None else {"limit": broadcast_bytes})):
        shared = queries.sparkSession.sparkContext.broadcast(labels.toArrow())

        def scan(batches):
            label_set = LabelSet(shared.value)
            for batch in _slices(batches):
                yield pa.RecordBatch.from_arrays(table_of(batch, _profile_of_batch(batch, label_set, metric, ranks)), names=names)

        return slim.mapInArrow(scan, schema)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _profile_of_batch(left, LabelSet(right), metric, ranks) if left.num_rows and right.num_rows else []
        return pa.table(table_of(left, found), names=names)

    parts = cell_join(slim, labels, kernel, schema, row_bytes).groupBy(*key, "rank")
    return parts.agg(*[F.sum(c).alias(c) for c in PROFILE[:3]], F.min("least").alias("least"), F.max("most").alias("most"))


def full_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All direct-difference distances, one dimension at a time (no three-way temporary)."""
    total = np.zeros((len(q), len(c)))
    for j in range(c.shape[1]):
        total += (q[:, j, None] - c[None, :, j]) ** 2
    return np.sqrt(total)
