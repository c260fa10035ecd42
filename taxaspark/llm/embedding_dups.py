"""Near-duplicate embeddings by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from taxaspark.llm.rows import cells, components, group_edges, whole_groups
from taxaspark.llm.shingles import mixed
from taxaspark.llm.vectors import common_length, digests, matrix, units, usable
from taxaspark.session import stage

PROJECTIONS = 40
CELL_ROWS = 2048
RECALL = 0.9999
#: About so many vectors of a label are left in a cell of unrelated ones.
CELL_TARGET = 256
# A strip is so many times as wide as the projections of a pair at the limit are apart.
_STRIP = 8
_UNRELATED = 0.42  # how often two unrelated unit vectors of some tens of dimensions share such a strip at 0.98
_CELL = ["grp", "round", "strips", "i", "j"]


def directions(width: int, count: int = PROJECTIONS, seed: int = 7) -> np.ndarray:
    d = np.random.default_rng(seed).standard_normal((width, count))
    return d / np.linalg.norm(d, axis=0)


def window_and_count(width: int, cosine: float, count: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int]:
    """Half width of a query's window, and how many of ``count`` windows must be hit.

    The projections of a pair at ``cosine`` differ by about a normal variable of spread distance / sqrt(width); the
    window is twice that. The count is the largest one that a binomial number of hits reaches with ``recall``.
    """
    spread = math.sqrt(max(0.0, 2 - 2 * cosine)) / math.sqrt(width)
    hit, tail, least = math.erf(2 / math.sqrt(2)), 0.0, count
    while least > 0:
        tail += math.comb(count, least) * hit**least * (1 - hit) ** (count - least)
        if tail >= recall:
            break
        least -= 1
    return 2 * spread + 1e-9, least


def rounds_of_strips(rows: int, recall: float = RECALL) -> tuple[int, int]:
    """(rounds, projections in each): vectors of a label meet in a round if they share a strip of all its projections.

    More vectors take more projections a round, so that a cell stays small, and more rounds, so that a pair at the
    limit still meets in one of them with ``recall``.
    """
    each = max(1, math.ceil(math.log(max(1.0, rows / CELL_TARGET)) / -math.log(_UNRELATED)))
    share = (1 - math.sqrt(2 / math.pi) / _STRIP) ** each
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - share))), each


def strip_keys(unit: np.ndarray, rounds: int, each: int, spread: float) -> np.ndarray:
    """(rows, rounds) of cell keys: strips of random width offset, hashed together."""
    rng = np.random.default_rng(23)
    onto = rng.standard_normal((unit.shape[1], rounds * each))
    onto /= np.linalg.norm(onto, axis=0)
    strips = np.floor((unit @ onto) / (_STRIP * spread) + rng.random(rounds * each)).astype(np.int64).astype(np.uint64)
    key = np.zeros((len(unit), rounds), dtype=np.uint64)
    for j in range(each):
        key = mixed(key + strips[:, j::each] + np.uint64(j + 1))
    return key.view(np.int64)


def linked_in_cell(ids, copies, unit, parts, keys, turn, window, least, cosine, whole):
    """Links of each row, and spanning edges, of one cell of round ``turn``.

    Each projection is sorted, and every row's window is a range of that order; a pair's hits are counted over all
    projections, and pairs with enough of them are compared in full. A pair counts in the first round it meets in.
    """
    projected = unit @ directions(unit.shape[1])
    n, count = len(ids), np.zeros((len(ids), len(ids)), dtype=np.uint8)
    for j in range(projected.shape[1]):
        value = projected[:, j]
        order = np.argsort(value, kind="stable")
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        low = np.searchsorted(value[order], value - window, "left").astype(np.int32)
        high = np.searchsorted(value[order], value + window, "right").astype(np.int32)
        count += (rank[None, :] >= low[:, None]) & (rank[None, :] < high[:, None])
    a, b = np.nonzero(np.triu(count >= least, 1))
    if not whole:
        cross = parts[a] != parts[b]
        a, b = a[cross], b[cross]
    linked = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 50_000):
        x, y = a[at : at + 50_000], b[at : at + 50_000]
        linked[at : at + 50_000] = (unit[x] * unit[y]).sum(axis=1) >= cosine
    a, b = a[linked], b[linked]
    first = (keys[a] == keys[b]).argmax(axis=1) == turn if len(a) else np.zeros(0, dtype=bool)
    a, b = a[first], b[first]
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            edges.append((ids[x], ids[y]))
    return links.astype(np.int64), edges


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(key, n_links, component, kept): vectors with equal labels and cosine similarity of ``cosine`` or more are
    linked; n_links counts a row's direct links, component is the smallest key reachable, kept marks its row.

    Equal vectors of a label are one throughout, and counted by their number. Vectors of a label meet in cells: strips
    of a few projections, in several rounds, as many as the largest label needs (``rounds_of_strips``). In a cell
    window hits over sorted projections decide which pairs are compared (``linked_in_cell``). A large cell is cut
    into parts of bounded size; a cell gives counts and a spanning forest, never its pairs. Links are exact; few at
    the limit of similarity may be missed.

    Null labels, null or zero vectors, and those with null or non-finite components link with nothing; so do
    rows without a key, and vectors of another length than most. Repeated rows are copies of each other.
    An empty table gives no row; other columns are not read.
    """
    spark = df.sparkSession
    good = F.col(label).isNotNull() & F.col(key).isNotNull() & usable(vector)
    good &= F.size(vector) == common_length(df.where(good), vector)
    rows = stage(digests(df.where(good), key, F.col(label), vector), "digests")
    classes = rows.groupBy("digest").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.min("group").alias("grp"))
    vectors = df.where(good).select(F.col(key).alias("id"), F.col(label).cast("string").alias("grp"), F.col(vector).alias("v"))
    classes = stage(classes, "classes")
    whole = vectors.join(classes.select("id", "copies", "grp", "digest"), ["id", "grp"])
    whole = stage(whole.dropDuplicates(["digest"]).select("id", "copies", "grp", "v"), "vectors")
    largest, width = whole.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).agg(F.max("n"), F.max("w")).first()
    everything = df.select(F.col(key).alias(key))
    if not largest:
        return everything.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component"), F.lit(True).alias("kept"))
    window, least = window_and_count(width, cosine)
    rounds, each = rounds_of_strips(largest)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = strip_keys(units(matrix(batch.column(3))), rounds, each, window / 2)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], names=["id", "copies", "grp", "v", "keys"])

    kept = whole.mapInArrow(visit, whole.withColumn("keys", F.array(F.lit(0).cast("long"))).schema)
    met = cells(stage(kept, "keys").select("*", F.posexplode("keys").alias("round", "strips")), _CELL[:3], "id", CELL_ROWS)
    kind = to_arrow_type(whole.schema["id"].dataType)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in whole_groups(batches, _CELL):
            out = []
            edges = group_edges(frame, _CELL)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo < 2:
                    continue
                part = frame.iloc[lo:hi]
                ids = part["id"].tolist()
                links, spanning = linked_in_cell(
                    ids, part["copies"].to_numpy(), units(np.stack(part["v"]).astype(np.float64)), part["part"].to_numpy(), np.stack(part["keys"]),
                    part["round"].iloc[0], window, least, cosine, part["i"].iloc[0] == part["j"].iloc[0],
                )
                out += [(ids[x], int(links[x]), None) for x in np.flatnonzero(links)] + [(x, 0, y) for x, y in spanning]
            a, n, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(n, pa.int64()), pa.array(b, kind)], names=["id", "links", "other"])

    schema = whole.select("id").schema.add("links", "long").add("other", whole.schema["id"].dataType)
    sorted_cells = met.select("id", "copies", "v", "keys", "part", *_CELL).repartition(*_CELL).sortWithinPartitions(*_CELL)
    found = stage(sorted_cells.mapInArrow(compare, schema), "links")
    roots = components(found.where("other is not null").select("id", "other"), "id", "other").withColumnRenamed("node", "id")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.join(links, "id", "left").join(roots, "id", "left")
    told = told.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component"))
    known = rows.join(told, "digest").select(F.col("key").alias(key), "n_links", "component")
    alone = df.where(~good).select(F.col(key).alias(key), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component"))
    return known.unionByName(alone).select(key, "n_links", "component", F.coalesce(F.col(key) == F.col("component"), F.lit(True)).alias("kept"))
