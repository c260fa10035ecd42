"""Nearest rows through an exact metric index: pivot cells cut into rings, pruned by the triangle inequality.

Every row belongs to its nearest pivot and, there, to a ring of rows of similar distance to it. What is known of a
ring - its pivot, the least and the largest distance, its size - is a small table that every worker has. A query first
looks into the rings that promise most; the distance found there leaves, of all others, only rings whose bound is not
above it. Rings lie together in strips: a query's vector is sent once to a strip, with a bit for each ring it asks for,
however many they are. Equal vectors are one row of the index. Where the bounds would leave most pairs to compare, as with vectors
that are all about equally far apart, the callers' plain comparison is used instead; both are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.operators.nearest import _CHUNK_CELLS, full_distances, matrix, nearest_indices, picked_distance
from taxaspark.session import stage, task_count

MAX_PIVOTS = 2048
PIVOT_BYTES = 16 * 1024 * 1024
RING_ROWS = 2048
MAX_RINGS = 1 << 18
STRIP_BYTES = 32 * 1024 * 1024  # of vectors
STRIP_RINGS = 512
VISITS = 1 << 15  # queries a task compares with a strip at once
LEAST_VISITS = 1 << 10  # and so many at least, where there are few
TRIAL = 1 << 13  # queries tried before the index is given up or used
_PROBED = 2048  # queries a worker holds the rings of at once
_SLACK = 1e-9  # far above what rounding does to a distance
_FOUND = "struct<distance:double,label:string,species:string,genus:string,family:string,order:string>"


@dataclass(frozen=True)
class MetricIndex:
    """``rows``: strip, place of the ring in it, label, copies, ranks, vec. What is known of rings is bounded and broadcast."""

    rows: DataFrame
    shared: object  # broadcast {fraction: (pivots, ring, pivot of ring, low, high, size, strip, place)}
    sizes: dict[float, int]
    width: int  # bytes of a strip's bits


def distinct_vectors(labels: DataFrame) -> DataFrame:
    """One row per fraction and vector: its smallest label, that row's ranks, and how many rows have it."""
    first = F.min(F.struct("label", *RANKS))
    # The hash goes first, so that grouping seldom compares vectors element by element.
    keyed = labels.groupBy("holdout_fraction", F.xxhash64("vec").alias("_hash"), "vec").agg(first.alias("first"), F.count("*").alias("copies"))
    return keyed.select("holdout_fraction", "first.*", "copies", "vec")


def _pivot_count(rows: int, dims: int, fractions: int) -> int:
    fits = max(1, PIVOT_BYTES // (8 * max(dims, 1) * max(fractions, 1)))
    return max(1, min(math.isqrt(max(rows - 1, 0)) + 1, MAX_PIVOTS, fits))


def _chosen_pivots(rows: DataFrame, sizes: dict[float, int], dims: int) -> dict[float, np.ndarray]:
    """Rows whose ids hash lowest, so dense places get many; at most MAX_PIVOTS of a fraction."""
    picked = {}
    for fraction, n in sizes.items():
        here = rows.where(F.col("holdout_fraction") == F.lit(fraction)).orderBy(F.xxhash64("label"), "label").limit(_pivot_count(n, dims, len(sizes)))
        picked[fraction] = matrix(here.select("vec").toArrow()["vec"])
    return picked


def _nearest_pivots(vec: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each row's nearest pivot."""
    at = np.zeros(len(vec), dtype=np.int64)
    step = max(1, _CHUNK_CELLS // len(pivots))
    norm = (pivots * pivots).sum(axis=1)
    for i in range(0, len(vec), step):
        at[i : i + step] = (norm - 2.0 * (vec[i : i + step] @ pivots.T)).argmin(axis=1)
    return at, picked_distance(vec, np.arange(len(vec)), pivots, at)


def _strips(known, strip_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(strip, place in it) of rings in order: strips are of one fraction and bounded in rows and rings."""
    strip, place = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
    now, rows, rings, before = -1, 0, 0, None
    for i, (fraction, n) in enumerate(zip(known["holdout_fraction"], known["n"])):
        if fraction != before or rows + n > strip_rows or rings == STRIP_RINGS:
            now, rows, rings, before = now + 1, 0, 0, fraction
        strip[i], place[i] = now, rings
        rows, rings = rows + n, rings + 1
    return strip, place


def build(labels: DataFrame, ring_rows: int = RING_ROWS) -> MetricIndex:
    """Index the ``vec`` of a label table per holdout_fraction; vectors are finite and of one length."""
    spark = labels.sparkSession
    rows = stage(distinct_vectors(labels), "index-vectors")
    counted = rows.groupBy("holdout_fraction").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).collect()
    sizes = {r["holdout_fraction"]: r["n"] for r in counted}
    pivots = spark.sparkContext.broadcast(_chosen_pivots(rows, sizes, max((r["d"] for r in counted), default=1)))
    names = ["holdout_fraction", "label", *RANKS, "copies", "vec"]

    def assign(batches):
        for batch in batches:
            fraction, vec = batch.column(0).to_numpy(), matrix(batch.column(len(names) - 1))
            cell, gap = np.zeros(len(fraction), dtype=np.int64), np.zeros(len(fraction))
            for f in np.unique(fraction):
                here = np.flatnonzero(fraction == f)
                cell[here], gap[here] = _nearest_pivots(vec[here], pivots.value[float(f)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*names, "cell", "gap"])

    schema = "holdout_fraction double, label string, species string, genus string, family string, `order` string, copies long, vec array<double>, cell long, gap double"
    placed = rows.select(*names).mapInArrow(assign, schema)
    total = sum(sizes.values())
    per_ring = max(ring_rows, -(-total // MAX_RINGS))
    ring = F.floor((F.row_number().over(Window.partitionBy("holdout_fraction", "cell").orderBy("gap", "label")) - 1) / per_ring)
    placed = stage(placed.withColumn("part", ring), "index-placed")
    known = placed.groupBy("holdout_fraction", "cell", "part").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("n"))
    known = known.toArrow().to_pandas().sort_values(["holdout_fraction", "cell", "part"], ignore_index=True)
    dims = max((r["d"] for r in counted), default=1)
    known["ring"] = np.arange(len(known))
    known["strip"], known["place"] = _strips(known, STRIP_BYTES // (8 * max(dims, 1)))
    numbers = spark.createDataFrame(
        known[["holdout_fraction", "cell", "part", "strip", "place"]], "holdout_fraction double, cell long, part long, strip long, place long"
    )
    rows = stage(placed.join(F.broadcast(numbers), ["holdout_fraction", "cell", "part"]).select("strip", "place", *names), "index-rows")
    columns = ("ring", "cell", "low", "high", "n", "strip", "place")
    shared = {float(f): (pivots.value[float(f)], *(t[c].to_numpy() for c in columns)) for f, t in known.groupby("holdout_fraction")}
    width = -(-int(known["place"].max() + 1) // 8) if len(known) else 1
    return MetricIndex(rows, spark.sparkContext.broadcast(shared), sizes, width)


def _promising(least: np.ndarray, gap: np.ndarray, size: np.ndarray, need: int) -> np.ndarray:
    """Of each row, the rings with the least bounds, nearer pivots first, that hold ``need`` rows together."""
    take, have = np.zeros(least.shape, dtype=bool), np.zeros(len(least), dtype=np.int64)
    for _ in range(min(need, least.shape[1])):  # no ring is empty
        more = np.flatnonzero(have < need)
        bound = np.where(take[more], np.inf, least[more])
        best = np.where(bound == bound.min(axis=1)[:, None], np.where(take[more], np.inf, gap[more]), np.inf).argmin(axis=1)
        take[more, best] = True
        have[more] += size[best]
    return take


def _visit_lists(rows: int, found: list[tuple], width: int) -> pa.ListArray:
    """list<struct<strip, bits>> of each row from (row, strip, bits) arrays."""
    row = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
    order = np.argsort(row, kind="stable")
    strip = np.concatenate([f[1] for f in found])[order] if found else np.zeros(0, np.int64)
    bits = np.ascontiguousarray(np.concatenate([f[2] for f in found])[order]) if found else np.zeros((0, width), np.uint8)
    places = pa.py_buffer(np.arange(len(row) + 1, dtype=np.int32) * np.int32(width))
    pairs = pa.StructArray.from_arrays([pa.array(strip), pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, places, pa.py_buffer(bits)])], names=["strip", "bits"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(rows + 1)), pa.int32()), pairs)


def _visits(index: MetricIndex, queries: DataFrame, need: int) -> DataFrame:
    """Add visits (strips with bits of their rings), rings (array, of first looks only) and pairs (rows in them) to queries
    with a ``bound``; ``seen`` rings are left out.

    A null bound asks for the most promising rings that hold ``need`` rows together.
    """
    shared, width = index.shared, index.width
    names = ["holdout_fraction", "process_id", "vec", "bound", "seen"]

    def probed(batch):
        fraction, bound = batch.column("holdout_fraction").to_numpy(), batch.column("bound").to_numpy(zero_copy_only=False)
        vec, seen = matrix(batch.column("vec")), batch.column("seen").to_pylist()
        rings, pairs, found = [[] for _ in fraction], np.zeros(len(fraction), dtype=np.int64), []
        for f in np.unique(fraction):
            if float(f) not in shared.value:
                continue
            pivots, ring, cell, low, high, size, strip, _ = shared.value[float(f)]
            here = np.flatnonzero(fraction == f)
            starts = np.flatnonzero(np.diff(strip, prepend=strip[0] - 1))
            step = max(1, _CHUNK_CELLS // max(len(ring), len(pivots)))
            for i in range(0, len(here), step):
                some = here[i : i + step]
                to_pivot = full_distances(vec[some], pivots)
                gap = to_pivot[:, cell]
                least = np.maximum(np.maximum(gap - high, low - gap), np.maximum((gap - to_pivot.min(axis=1)[:, None]) / 2, 0.0))
                first = np.isnan(bound[some])
                take = np.zeros(least.shape, dtype=bool)
                if first.any():
                    take[first] = _promising(least[first], gap[first], size, need)
                    for j in np.flatnonzero(first):
                        rings[some[j]] = ring[take[j]].tolist()
                if not first.all():
                    rest = ~first
                    limit = bound[some][rest][:, None]
                    take[rest] = least[rest] <= limit + _SLACK * (limit + gap[rest] + high)
                    for j in np.flatnonzero(rest):
                        take[j, np.array(seen[some[j]] or [], dtype=np.int64) - ring[0]] = False
                pairs[some] = take @ size
                for a, b in zip(starts, [*starts[1:], len(strip)]):
                    at = np.flatnonzero(take[:, a:b].any(axis=1))
                    bits = np.zeros((len(at), width), dtype=np.uint8)
                    packed = np.packbits(take[at, a:b], axis=1)
                    bits[:, : packed.shape[1]] = packed
                    found.append((some[at], np.full(len(at), strip[a]), bits))
        lists = _visit_lists(len(fraction), found, width)
        return pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(rings, pa.list_(pa.int64())), pa.array(pairs)], names=[*names, "visits", "rings", "pairs"])

    def probe(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _PROBED):
                yield probed(batch.slice(i, _PROBED))

    return queries.select(*names).mapInArrow(
        probe,
        "holdout_fraction double, process_id string, vec array<double>, bound double, seen array<long>, "
        "visits array<struct<strip: long, bits: binary>>, rings array<long>, pairs long",
    )


def _ring_pairs(q: pa.Table, c: pa.Table, skip):
    """(query row, place in ``c``, distance, compared) of the nearest row of each query among the rings its bits name.

    Where they name most of the strip, all of it is compared at once.
    """
    place = c["place"].to_numpy()
    bits = np.frombuffer(b"".join(q["bits"].to_pylist()), dtype=np.uint8).reshape(q.num_rows, -1)
    rings = int(place.max()) + 1
    wanted = np.unpackbits(bits, axis=1)[:, :rings].astype(bool)
    size = np.bincount(place, minlength=rings)
    left, right = matrix(q["vec"]), matrix(c["vec"])
    if (wanted.sum(axis=0) * size).sum() > q.num_rows * c.num_rows / 4:
        row, at, gap = nearest_indices(left, right, 1, skip=skip)
        return row, at, gap, np.full(q.num_rows, c.num_rows, dtype=np.int64)
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(rings + 1))
    inside = np.empty(len(place), dtype=np.int64)  # place of a row in its ring
    inside[order] = np.arange(len(place)) - ends[place[order]]
    parts = []
    for r in np.flatnonzero(wanted.any(axis=0) & (size > 0)):
        who, rows = np.flatnonzero(wanted[:, r]), order[ends[r] : ends[r + 1]]
        own = None if skip is None else np.where((skip[who] >= 0) & (place[skip[who]] == r), inside[skip[who]], -1)
        i, j, d = nearest_indices(left[who], right[rows], 1, skip=own)
        parts.append((who[i], rows[j], d))
    row, at, gap = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    best = np.lexsort((at, gap, row))
    best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
    return row[best], at[best], gap[best], wanted @ size


def _compare(index: MetricIndex, visits: DataFrame, skip_self: bool) -> DataFrame:
    """(holdout_fraction, process_id, found, compared): the nearest row of each query in each strip it visits.

    A strip that very many queries visit is compared with a bounded part of them at a time.
    """
    spark = visits.sparkSession
    each = visits.select("holdout_fraction", "process_id", "vec", F.explode("visits").alias("visit"))
    each = each.select("holdout_fraction", "process_id", "vec", F.col("visit.strip").alias("strip"), F.col("visit.bits").alias("bits"))
    # One row per strip, whose number is bounded.
    counts = {r[0]: r[1] for r in each.groupBy("strip").count().collect()}
    at_once = max(min(LEAST_VISITS, VISITS), min(VISITS, sum(counts.values()) // task_count(spark)))
    parts = spark.createDataFrame([(s, -(-n // at_once)) for s, n in counts.items()], "strip long, parts int")
    left = each.join(F.broadcast(parts), "strip").withColumn("part", _part(F.col("parts"))).drop("parts")
    right = index.rows.join(F.broadcast(parts), "strip").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    names = ["label", *RANKS]

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        if not (q.num_rows and c.num_rows):
            q = q.slice(0, 0)
        c = c.sort_by("label")
        found, at, gap, compared = np.full(q.num_rows, -1), np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)
        if q.num_rows:
            skip = None
            if skip_self:
                own = pc.index_in(q["process_id"].combine_chunks(), value_set=c["label"].combine_chunks())
                skip = pc.fill_null(own, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, at, gap, compared = _ring_pairs(q, c, skip)
            found[row] = np.arange(len(row))
        none = pa.array(found < 0)
        hit = pa.StructArray.from_arrays(
            [pa.array(gap, pa.float64()), *(c[n].combine_chunks().take(pa.array(at, pa.int64())) for n in names)], names=["distance", *names]
        ) if q.num_rows else pa.array([], pa.struct([("distance", pa.float64()), *((n, pa.string()) for n in names)]))
        places = pa.array(np.maximum(found, 0), pa.int64(), mask=none.to_numpy(zero_copy_only=False))
        return pa.table(
            [q["holdout_fraction"], q["process_id"], hit.take(places), pa.array(compared, pa.int64())],
            names=["holdout_fraction", "process_id", "found", "compared"],
        )

    met = left.groupBy("strip", "part").cogroup(right.drop("holdout_fraction").groupBy("strip", "part"))
    return met.applyInArrow(kernel, f"holdout_fraction double, process_id string, found {_FOUND}, compared long")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("process_id"), parts).cast("int")


def nearest(index: MetricIndex, queries: DataFrame, skip_self: bool = False, most_pairs: float | None = 0.5) -> DataFrame | None:
    """(holdout_fraction, process_id, found, compared) for every query (holdout_fraction, process_id, vec).

    found is the nearest row, ties to the smallest label, null where the fraction has no (other) row; compared counts
    the index's rows it was compared with. ``skip_self`` leaves the row of the query's own id out. None is returned,
    before any long work, where the bounds leave more than the share ``most_pairs`` of all pairs to compare.
    """
    if most_pairs is not None and not _prunes(index, queries, skip_self, most_pairs):
        return None
    keys = ["holdout_fraction", "process_id"]
    begun, second = _looks(index, queries, skip_self)
    both = begun.unionByName(_compare(index, second, skip_self))
    found = both.groupBy(*keys).agg(_least().alias("found"), F.sum("compared").alias("compared"))
    return queries.select(*keys).join(found, keys, "left")


def _looks(index: MetricIndex, queries: DataFrame, skip_self: bool) -> tuple[DataFrame, DataFrame]:
    """(what the first look found, the visits that are left)."""
    empty = F.array().cast("array<long>")
    first = queries.select("holdout_fraction", "process_id", "vec", F.lit(None).cast("double").alias("bound"), empty.alias("seen"))
    first = stage(_visits(index, first, 2 if skip_self else 1), "index-first")
    begun = stage(_compare(index, first, skip_self).groupBy("holdout_fraction", "process_id").agg(_least().alias("found"), F.sum("compared").alias("compared")), "index-begun")
    keys = ["holdout_fraction", "process_id"]
    second = first.drop("bound", "seen", "pairs", "visits").withColumnRenamed("rings", "seen").join(begun.select(*keys, F.col("found.distance").alias("bound")), keys)
    # Where even the first rings held no other row, everything is left to look at.
    second = second.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return begun, stage(_visits(index, second, 0), "index-second")


def _prunes(index: MetricIndex, queries: DataFrame, skip_self: bool, most_pairs: float) -> bool:
    """Whether a part of the queries, by the hash of their ids, is left at most the share ``most_pairs`` of all pairs."""
    total = queries.count()
    some = queries.where(F.pmod(F.xxhash64("process_id", F.lit("trial")), F.lit(max(1, total // TRIAL))) == 0)
    _, second = _looks(index, some, skip_self)
    per = {r[0]: (r[1], r[2]) for r in second.groupBy("holdout_fraction").agg(F.sum("pairs"), F.count("*")).collect()}
    every = sum(n * index.sizes.get(f, 0) for f, (_, n) in per.items())
    return sum(pairs for pairs, _ in per.values()) <= most_pairs * every


def _least() -> Column:
    return F.min(F.when(F.col("found.label").isNotNull(), F.col("found")))
