"""Nearest neighbours by a hierarchical k-means tree and best-bin-first traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.vectors import common_length, matrix, units, usable
from taxaspark.session import stage

#: Vectors the tree is fitted on, at most; every vector is put into it.
FIT_ROWS = 20_000
BRANCHES = 8
LEAF_ROWS = 64
#: Sampled queries for which exact neighbours in the sample set the number of leaves to visit.
CALIBRATION_QUERIES = 400
RECALL = 0.98
CELL_VECTORS, CELL_QUERIES = 8192, 4096


@dataclass
class Tree:
    """Node i has a centre and children; a node without children is a leaf and has a number."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    leaves: int

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each row, down the nearest child."""
        at = np.zeros(len(unit), dtype=np.int64)
        while True:
            moved = False
            for node in np.unique(at):
                if len(kids := self.children[node]):
                    rows = np.flatnonzero(at == node)
                    at[rows] = kids[np.argmax(unit[rows] @ self.centres[kids].T - 0.5 * (self.centres[kids] ** 2).sum(axis=1), axis=1)]
                    moved = True
            if not moved:
                return self.leaf[at]

    def visits(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves of one query, nearest centre first, from a queue of all branches passed by."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not len(kids):
                yield int(self.leaf[node])
            else:
                far = ((self.centres[kids] - unit) ** 2).sum(axis=1)
                for d, k in zip(far.tolist(), kids.tolist(), strict=True):
                    heapq.heappush(queue, (d, k))


def _split(unit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cluster of each row after a few rounds of k-means; all one where rows cannot be told apart."""
    centres = unit[rng.choice(len(unit), min(BRANCHES, len(unit)), replace=False)]
    for _ in range(8):
        of = np.argmax(unit @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        centres = np.array([unit[of == k].mean(axis=0) for k in np.unique(of)])
    return np.argmax(unit @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


def grow(unit: np.ndarray, seed: int = 11) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, leaf, leaves, todo = [unit.mean(axis=0)], [np.zeros(0, dtype=np.int64)], [-1], 0, [(0, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        of = _split(unit[rows], rng) if len(rows) > LEAF_ROWS else np.zeros(len(rows), dtype=np.int64)
        found = np.unique(of)
        if len(found) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        kids = []
        for k in found:
            kids.append(len(centres))
            centres.append(unit[rows[of == k]].mean(axis=0))
            children.append(np.zeros(0, dtype=np.int64))
            leaf.append(-1)
            todo.append((kids[-1], rows[of == k]))
        children[node] = np.array(kids)
    return Tree(np.array(centres), children, np.array(leaf), leaves)


def leaves_for_recall(tree: Tree, unit: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Fewest leaves to visit so that sampled queries find ``recall`` of their k nearest in the sample."""
    of = tree.leaf_of(unit)
    queries = np.linspace(0, len(unit) - 1, min(CALIBRATION_QUERIES, len(unit))).astype(np.int64)
    needed = []
    for q in queries:
        score = unit @ unit[q]
        score[q] = -np.inf
        nearest = np.argsort(-score, kind="stable")[: min(k, len(unit) - 1)]
        turn = np.empty(tree.leaves, dtype=np.int64)
        turn[list(tree.visits(unit[q]))] = np.arange(tree.leaves)
        needed += turn[of[nearest]].tolist()
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1 if needed else tree.leaves


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; equal rows give equal values, which a matrix product does not promise."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_in_cell(qid, q, vid, v, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score): each query's k best of the cell, ties to the smaller id."""
    qs, vs, scores = [], [], []
    rough = units(q) @ units(v).T
    rough[qid[:, None] == vid[None, :]] = -np.inf
    for i in range(len(q)):
        row = rough[i]
        floor = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        near = np.flatnonzero((row >= floor - 1e-9) & (row > -np.inf))
        if not len(near):
            continue
        exact = cosines(q[i][None, :], v[near])
        best = np.lexsort((vid[near], -exact))[:k]
        qs.append(np.full(len(best), i))
        vs.append(near[best])
        scores.append(exact[best])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(qs), np.concatenate(vs), np.concatenate(scores)) if qs else (none, none, none.astype(float))


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """(query, rank, key, score): the ``k`` rows of largest cosine found for each row where ``is_query`` holds.

    A tree of clusters is grown on a sample by a hash of the key. Every vector goes down to a leaf; every query walks
    the tree nearest branch first and visits as many leaves as gave sampled queries ``recall`` of their exact
    neighbours, and more as long as those hold no k + 1 vectors. Visits and vectors meet by leaf, a large leaf in
    cells of bounded size; cells give k rows a query. Scores are exact, in doubles; ties go to the smaller key.

    Null or zero vectors, those with null or non-finite components, and those of another length than most take no part, nor do rows without an integer
    key. All copies of a query's row share its key, so none of them is its neighbour. An empty table gives no row;
    other columns are not read.
    """
    spark = df.sparkSession
    one_length = F.size(vector) == common_length(df.where(F.col(key).isNotNull()), vector)
    good = df.where(F.col(key).isNotNull() & usable(vector) & one_length).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    good = stage(good, "vectors")
    schema = "query long, rank int, id long, score double"
    rows = good.count()
    part = good.where(F.abs(F.xxhash64("id")) % 1_000_000 < 1_100_000 * fit_rows / max(1, rows)).orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").toArrow()
    if not part.num_rows:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    sample = units(matrix(part.column("v").combine_chunks()))
    tree = grow(sample)
    visits = leaves_for_recall(tree, sample, k, recall)
    known = spark.sparkContext.broadcast(tree)  # fit_rows / LEAF_ROWS leaves or a few times that

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = known.value.leaf_of(units(matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=["id", "v", "asks", "leaf"])

    placed = stage(good.mapInArrow(place, "id long, v array<double>, asks boolean, leaf int"), "leaves")
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row a leaf

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for unit in units(matrix(batch.column(1))) if batch.num_rows else ():
                path, found = [], 0
                for leaf in known.value.visits(unit):
                    path.append(leaf)
                    found += held.get(leaf, 0)
                    if len(path) >= visits and found > k:
                        break
                out.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["id", "v", "path"])

    asked = placed.where("asks").dropDuplicates(["id"]).select("id", "v").mapInArrow(walk, "id long, v array<double>, path array<int>")
    asked = stage(asked.select("id", "v", F.explode("path").alias("leaf")), "visits")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / CELL_VECTORS).cast("int").alias("parts"))
    sizes = stage(asked.groupBy("leaf").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("turns")).join(sizes, "leaf"), "sizes")
    spread = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "leaf").select("leaf", spread("id", "turns").alias("turn"), every("parts").alias("part"), "id", "v")
    right = placed.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("id", F.col("v")), F.col("parts")).cast("int"))
    right = right.select("leaf", every("turns").alias("turn"), "part", "id", "v")

    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query": [], "id": [], "score": []})
        qid, vid = queries["id"].to_numpy(), vectors["id"].to_numpy()
        i, j, score = best_in_cell(qid, np.stack(queries["v"]), vid, np.stack(vectors["v"]), k)
        return pd.DataFrame({"query": qid[i], "id": vid[j], "score": score})

    cell = ["leaf", "turn", "part"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(best, "query long, id long, score double")
    place_of = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return found.select("query", place_of.alias("rank"), "id", "score").where(F.col("rank") <= k).withColumnRenamed("id", key)
