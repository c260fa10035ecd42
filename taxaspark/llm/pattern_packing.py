"""Pattern packing: repeat counts of few-document patterns by non-negative least squares, the rest by best fit.

Which pieces share a sequence depends on lengths alone, of which there are at most ``capacity``. So the plan is made
from the histogram, a table of bounded size whatever the corpus, and every piece then finds its place from its length
and its rank among the pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.llm.packing import FLUSH_BYTES, encoder
from taxaspark.session import stage

CAPACITY = 4096
# Patterns are made of classes of lengths, each at most a 256th of the capacity wide, so their number is fixed.
CLASSES = 256
_RANK_BITS = 48  # a rank below, the length above


def patterns(classes: int) -> np.ndarray:
    """All ways to fill ``classes`` units with one, two or three classes, as (n, 3) falling rows; 0 is no document."""
    first, second = (g.ravel() for g in np.meshgrid(np.arange(1, classes + 1), np.arange(0, classes + 1), indexing="ij"))
    third = classes - first - second
    good = (first >= second) & (second >= third) & (third >= 0)
    return np.stack([first[good], second[good], third[good]], axis=1)


def nonnegative_least_squares(columns: np.ndarray, target: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 that minimises ``|columns @ x - target|``, by the active-set method of Lawson and Hanson.

    Only the normal equations of the columns in use are solved, at most one for each row of ``target``.
    """
    n = columns.shape[1]
    gram_target = columns.T @ target
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(gram_target).max(initial=0.0)))
    for _ in range(rounds):
        slope = gram_target - columns.T @ (columns[:, used] @ x[used])
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            part = columns[:, at]
            try:
                trial = np.linalg.solve(part.T @ part, gram_target[at])
            except np.linalg.LinAlgError:
                trial = np.linalg.lstsq(part, target, rcond=None)[0]
            if trial.min(initial=1.0) > 0:
                x[:] = 0.0
                x[at] = trial
                break
            falling = trial <= 0
            step = np.min(x[at][falling] / np.maximum(x[at][falling] - trial[falling], 1e-300))
            x[at] += step * (trial - x[at])
            gone = at[(x[at] <= 1e-12) & falling]
            if not len(gone):
                gone = at[[int(np.argmin(np.where(falling, x[at], np.inf)))]]
            x[gone] = 0.0
            used[gone] = False
    return x


class Plan:
    """Runs of pieces of one length → sequences.

    A run says: pieces of ``length`` ranked ``first`` to ``first + n`` lie ``times`` to a sequence, from sequence
    ``base`` on, from ``offset`` there. Open sequences of equal free room are kept as ranges, so the work depends on
    the number of lengths, not of pieces.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.next_id = capacity, 0
        self.left = {length: n for length, n in sorted(histogram.items()) if n > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.rooms: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def place(self, length: int, n: int, times: int, base: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], n, times, base, offset))
        self.taken[length] += n
        self.left[length] -= n

    def keep(self, room: int, base: int, n: int) -> None:
        if room and n:
            if room not in self.open:
                insort(self.rooms, room)
            self.open.setdefault(room, []).append((base, n))

    def new(self, n: int) -> int:
        self.next_id += n
        return self.next_id - n

    def fit_patterns(self) -> None:
        """Whole repeats of the fitted patterns, the most frequent first, as far as there are pieces."""
        width = -(-self.capacity // CLASSES)
        classes = self.capacity // width
        counts = np.zeros(classes + 1)
        for length, n in self.left.items():
            if length <= classes * width:
                counts[-(-length // width)] += n
        made = patterns(classes)
        made = made[((counts[made] > 0) | (made == 0)).all(axis=1)]
        if not len(made):
            return
        # A piece left over costs its tokens: rows are weighted by length.
        weight = np.arange(classes + 1, dtype=float) / classes
        columns = np.zeros((classes + 1, len(made)))
        for j in range(3):
            np.add.at(columns, (made[:, j], np.arange(len(made))), weight[made[:, j]])
        repeats = nonnegative_least_squares(columns[1:], (counts * weight)[1:])
        here = sorted(self.left)
        for at in np.argsort(-repeats, kind="stable"):
            n = int(repeats[at] + 0.5)
            if n <= 0:
                break
            self._repeat([int(c) for c in made[at] if c], n, width, here)

    def _repeat(self, kinds: list[int], need: int, width: int, here: list[int]) -> None:
        """Up to ``need`` sequences of a pattern: from each class its longest length, and last the longest that still
        fits and is not below its class. ``here`` holds, sorted, the lengths there are pieces of.

        Every turn uses up a length or ends the pattern, so turns do not grow with the pieces.
        """
        while need:
            picked: dict[int, int] = {}
            room = self.capacity
            for j, c in enumerate(kinds):
                top = min(room, c * width) if j < len(kinds) - 1 else room
                at = bisect_right(here, top) - 1
                while at >= 0 and self.left[here[at]] <= picked.get(here[at], 0):
                    at -= 1
                if at < 0 or here[at] <= (c - 1) * width:
                    return
                picked[here[at]] = picked.get(here[at], 0) + 1
                room -= here[at]
            n = min(need, *(self.left[length] // k for length, k in picked.items()))
            base, offset = self.new(n), 0
            for length, k in picked.items():
                self.place(length, n * k, k, base, offset)
                offset += k * length
                if not self.left[length]:
                    here.remove(length)
            self.keep(room, base, n)
            need -= n

    def best_fit(self) -> None:
        """Longest lengths first, each into the least room it fits in; new sequences where it fits nowhere."""
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    times = self.capacity // length
                    n = max(1, self.left[length] // times)
                    times = min(times, self.left[length])
                    base = self.new(n)
                    self.place(length, n * times, times, base, 0)
                    self.keep(self.capacity - times * length, base, n)
                    continue
                room = self.rooms[at]
                base, n = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[at]
                times = min(room // length, self.left[length])
                use = min(n, self.left[length] // times)
                self.place(length, use * times, times, base, self.capacity - room)
                self.keep(room - times * length, base, use)
                self.keep(room, base + use, n - use)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Lengths and their counts → where every piece goes; all lengths must be from 1 to ``capacity``."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("a length is outside 1 to capacity")
    made = Plan(histogram, capacity)
    made.fit_patterns()
    made.best_fit()
    return made


def cut_pieces(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int, key: str, text: str) -> DataFrame:
    """Encode whole texts and cut those longer than ``capacity``: key, piece, start, length, ids, part, nth.

    nth counts the pieces of equal length in the task ``part``. The two only mean something in a written table.
    """
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "length")]
        + [T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("nth", T.LongType())]
    )
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_json), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            kind, out, held = batch.column(0).type, [], 0
            types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())

            def flush(out, types=types):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

            for ident, value in zip(batch.column(0), batch.column(1), strict=True):
                ids, ident = encode(value.as_py() or "") + end, ident.as_py()
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    length = len(cut) // 4
                    out.append((ident, piece, at // 4, length, cut, part, int(seen[length])))
                    seen[length] += 1
                    held += len(cut) + 64
                    if held >= FLUSH_BYTES:
                        yield flush(out)
                        out, held = [], 0
            if out:
                yield flush(out)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _placed(made: Plan, length: Column, rank: Column) -> Column:
    """Struct of sequence_id and offset of the piece of ``length`` that has ``rank`` among its equals."""
    runs = np.array(made.runs, dtype=np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    starts = (runs[:, 0] << _RANK_BITS) + runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, (lengths.to_numpy() << _RANK_BITS) + ranks.to_numpy(), side="right") - 1
        _, first, _, times, base, offset = runs[at].T
        nth = ranks.to_numpy() - first
        return pd.DataFrame({"sequence_id": base + nth // times, "offset": offset + nth % times * lengths.to_numpy()})

    return place(length, rank)


def pack(docs: DataFrame, tokenizer_json: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole texts into few sequences of at most ``capacity`` tokens; one row per piece.

    Columns: ``key``, piece (from 0), start, length, ids (little-endian unsigned 32-bit, the end id last in a
    document), sequence_id, offset. Only documents of more than ``capacity`` ids are cut.

    The pieces are encoded once and written to shared scratch. Their histogram (at most ``capacity`` counts) goes to
    the driver, which fits repeat counts of patterns of one to three documents to it, rounds them, and puts what is
    left by best fit into the room left. A piece's rank among its equals is its place in its task plus the earlier
    tasks' pieces of that length, so no length, however frequent, gathers in one place.

    A null or empty text gives the end id alone; a null key is kept; equal rows are packed one by one and ties take
    the order of the written table; an empty table gives no row. Other columns are not read, so their names cannot clash.
    """
    pieces = stage(cut_pieces(docs, tokenizer_json, end_id, capacity, key, text), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = stage(counts.withColumn("before", F.coalesce(before, F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity)
    bases = counts.select(F.col("part").alias("__part"), F.col("length").alias("__length"), "before")
    ranked = pieces.join(bases, (F.col("part") == F.col("__part")) & (F.col("length") == F.col("__length")))
    ranked = ranked.withColumn("place", _placed(made, F.col("length"), F.col("before") + F.col("nth")))
    return ranked.select(key, "piece", "start", "length", "ids", "place.sequence_id", "place.offset")
