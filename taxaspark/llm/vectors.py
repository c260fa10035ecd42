"""Embeddings as rows of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """Not null, some component not zero, and each of them there and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The length most usable vectors of a table have, the smaller of two as frequent; 0 without any."""
    sizes = df.where(usable(vector)).groupBy(F.size(vector).alias("size")).count()
    first = sizes.orderBy(F.col("count").desc(), "size").first()
    return first["size"] if first else 0


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length → 2-d doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def units(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1, first by the largest component so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def digests(df: DataFrame, key: str, group: Column, vector: str) -> DataFrame:
    """(key, group as text, digest of group and vector), for usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [xxhash.xxh3_128_digest((g + "|").encode() + (np.asarray(v, dtype=np.float64) + 0.0).tobytes()) for g, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["key", "group", "digest"])

    narrow = df.select(F.col(key).alias("key"), group.cast("string").alias("group"), F.col(vector).alias("v"))
    return narrow.mapInArrow(run, narrow.select("key", "group").schema.add("digest", "binary"))
