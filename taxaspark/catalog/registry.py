"""Query registry and the intermediate tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F

from taxaspark.catalog.sql import statement
from taxaspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SHARED: dict[tuple, object] = {}


def query(name: str, sql: str | None = None, **extra: str):
    """Register a query; ``sql`` is its DuckDB twin, ``extra`` further named pieces of it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = statement(sql, extra)
        return fn

    return register


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Build once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget_shared() -> None:
    """Drop the shared intermediates, so that a timing includes building them."""
    _SHARED.clear()


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"query-{name}")


def r6(column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; adding zero turns -0.0 into 0.0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def r9(column) -> Column:
    """For ratios of small counts, whose sixth digit may be an exact half."""
    return r6(column, 9)


def vec_key(column) -> Column:
    """A vector as text, to six digits."""
    return F.array_join(F.transform(column, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")
