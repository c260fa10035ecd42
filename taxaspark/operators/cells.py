"""Every row of one table against every row of another, in bounded cells.

Fragment-and-replicate ("1-Bucket-Theta", Okcan & Riedewald, SIGMOD 2011): rows get a random
row band or column band, each cell of the band grid sees one fragment of either side, and the
kernel returns a reduced result per cell. No pair is ever a row, no key decides where a row goes,
and a cell holds about ``cell_rows`` rows of either side whatever the data looks like.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.session import stage

CELL_BYTES = 16 * 1024 * 1024
MIN_CELL_ROWS = 64


def _bands(rows: int, other: int, row_bytes: int, tasks: float) -> int:
    by_memory = max(CELL_BYTES // max(row_bytes, 1), MIN_CELL_ROWS)
    by_tasks = math.sqrt(max(rows * other, 1) / max(tasks, 1))  # enough cells to keep every core busy
    return max(1, math.ceil(rows / max(MIN_CELL_ROWS, min(by_memory, by_tasks))))


def _band(n: Column) -> Column:
    # Staged input keeps its row order, so the number, and with it the band, survives a retry.
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), n).cast("int")


def cell_join(left: DataFrame, right: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table],
              schema: str, row_bytes: int, within: str | None = None) -> DataFrame:
    """Run ``kernel`` on every cell of the left × right grid and return all its rows.

    Where only rows of equal ``within``, a column with a few values, have anything to do with each other, each value
    has a grid of its own, and no row is sent to another's.
    """
    left, right = stage(left, "cells-left"), stage(right, "cells-right")
    tasks = 2 * left.sparkSession.sparkContext.defaultParallelism
    if within is None:
        grids = {None: (left.count(), right.count())}
    else:
        sizes = [{r[0]: r[1] for r in side.groupBy(within).count().collect()} for side in (left, right)]
        grids = {v: (n, sizes[1][v]) for v, n in sizes[0].items() if v in sizes[1]}
    cells = sum(n * m for n, m in grids.values())
    bands = {v: (_bands(n, m, row_bytes, tasks * n * m / max(cells, 1)), _bands(m, n, row_bytes, tasks * n * m / max(cells, 1))) for v, (n, m) in grids.items()}
    lhs = left.withColumn("_rows", _per_value(within, bands, 0)).withColumn("_cols", _per_value(within, bands, 1)).where("_rows IS NOT NULL")
    lhs = lhs.withColumn("_row", _band(F.col("_rows"))).withColumn("_col", F.explode(_numbers(F.col("_cols"))))
    rhs = right.withColumn("_rows", _per_value(within, bands, 0)).withColumn("_cols", _per_value(within, bands, 1)).where("_rows IS NOT NULL")
    rhs = rhs.withColumn("_col", _band(F.col("_cols"))).withColumn("_row", F.explode(_numbers(F.col("_rows"))))
    keys = [*([within] if within else []), "_row", "_col"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        extra = ["_row", "_col", "_rows", "_cols"]
        return kernel(a.drop_columns(extra), b.drop_columns(extra))

    return lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInArrow(run, schema)


def _per_value(within: str | None, bands: dict, side: int) -> Column:
    """The number of bands as a column: one branch per value."""
    if within is None:
        return F.lit(bands[None][side])
    out = F.lit(None).cast("int")
    for value, counts in bands.items():
        out = F.when(F.col(within) == F.lit(value), F.lit(counts[side])).otherwise(out)
    return out


def _numbers(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)
