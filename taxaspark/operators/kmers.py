"""k-mer windows, frequencies and the k-mer + PCA encoder."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.session import stage


def kmer_alphabet(k: int) -> list[str]:
    return ["".join(p) for p in itertools.product("ACGT", repeat=k)]


def kmer_tokens(df: DataFrame, k: int, keep: list[str], seq: str = "sequence") -> DataFrame:
    """One row per overlapping window made of ACGT only; none when the sequence is shorter than ``k``."""
    fields = [df.schema[c] for c in keep]

    def scan(batches):
        for batch in _slices(batches):
            text, letter, row = joined_letters(batch.column("_seq"))
            at = valid_windows(letter, k)
            spelled = np.lib.stride_tricks.sliding_window_view(text, k)[at] if len(at) else np.zeros((0, k), np.uint8)
            offsets = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(k))
            words = pa.StringArray.from_buffers(len(at), offsets, pa.py_buffer(np.ascontiguousarray(spelled)))
            picked = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(picked) for c in keep] + [words], names=[*keep, "kmer"])

    out = T.StructType(fields + [T.StructField("kmer", T.StringType())])
    return df.select(*keep, F.upper(F.col(seq)).alias("_seq")).mapInArrow(scan, out)


def kmer_frequencies(df: DataFrame, k: int, keys: list[str], seq: str = "sequence") -> DataFrame:
    """Relative frequency per (row, k-mer) over valid windows, long and sparse.

    A row's windows are counted inside its Arrow batch, so nothing is exploded or shuffled.
    """
    rows = df.select(*keys, F.col(seq).alias("_seq"))
    fields = [df.schema[c] for c in keys]
    letters = np.array(list("ACGT"))

    def scan(batches):
        for batch in _slices(batches):
            row, code, n = kmer_counts(batch.column("_seq"), k)
            spelled = ["".join(w) for w in letters[(code[:, None] // 4 ** np.arange(k - 1, -1, -1)) % 4]]
            total = np.bincount(row, weights=n, minlength=batch.num_rows)
            picked = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(picked) for c in keys] + [pa.array(spelled, pa.string()), pa.array(n / total[row])],
                names=[*keys, "kmer", "freq"],
            )

    out = fields + [T.StructField("kmer", T.StringType()), T.StructField("freq", T.DoubleType())]
    return rows.mapInArrow(scan, T.StructType(out))


_ROWS = 1024  # rows encoded at a time

_CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def _slices(batches):
    """Bounded pieces of each Arrow batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            yield whole.slice(at, _ROWS)


def joined_letters(sequences: pa.Array):
    """(bytes, base codes, row number) of a batch as one string with a stop byte after each sequence.

    A window that crosses a row end then holds a foreign letter like any other invalid one.
    """
    texts = sequences.to_pylist()
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
    text = np.frombuffer(("\x00".join(t or "" for t in texts) + "\x00").encode("ascii", "replace"), np.uint8)
    return text, _CODE[text], np.repeat(np.arange(len(texts)), lengths + 1)


def valid_windows(letter: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows without a foreign letter."""
    bad = np.concatenate([[0], np.cumsum(letter == 4)])
    return np.flatnonzero(bad[k:] == bad[:-k]) if len(letter) >= k else np.zeros(0, np.int64)


def window_codes(letter: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Windows as base-4 numbers, exact for k up to 31."""
    code = np.zeros(len(at), np.int64)
    for i in range(k):
        code = code * 4 + letter[at + i]
    return code


def kmer_counts(sequences: pa.Array, k: int):
    """(row, k-mer code, count) of a batch, codes in lexicographic ACGT order."""
    _, letter, row = joined_letters(sequences)
    at = valid_windows(letter, k)
    width = 4**k
    key = row[at] * width + window_codes(letter, at, k)
    if len(sequences) * width <= 1 << 22:
        n = np.bincount(key, minlength=len(sequences) * width)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        found, n = np.unique(key, return_counts=True)
    return found // width, found % width, n


def frequency_matrix(sequences: pa.Array, k: int) -> np.ndarray:
    """(n, 4^k) relative frequencies; a row without a valid window is zero."""
    out = np.zeros((len(sequences), 4**k))
    row, code, n = kmer_counts(sequences, k)
    total = np.bincount(row, weights=n, minlength=len(out))
    out[row, code] = n / total[row]
    return out


def list_column(values: np.ndarray) -> pa.ListArray:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(values.reshape(-1)))


def _with_vector(df: DataFrame, seq: str, out: str, encode) -> DataFrame:
    """Append ``encode(sequences) -> matrix`` as an array column; the sequence column stays."""
    fields = df.schema.fields
    names = [f.name for f in fields]

    def scan(batches):
        for batch in _slices(batches):
            vec = list_column(encode(batch.column(seq)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [vec], names=[*names, out])

    return df.mapInArrow(scan, T.StructType(fields + [T.StructField(out, T.ArrayType(T.DoubleType()))]))


def kmer_vectors(df: DataFrame, k: int, seq: str = "sequence", out: str = "vec") -> DataFrame:
    """Dense 4^k frequency vector per row; zeros when no window is valid."""
    return _with_vector(df, seq, out, lambda s: frequency_matrix(s, k))


def dense_from_long(freqs: DataFrame, k: int, keys: list[str], out: str = "vec") -> DataFrame:
    """Dense vector from long frequencies, in SQL operators (rows without a valid window are absent)."""
    table = freqs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "freq"))).alias("m"))
    names = F.array(*[F.lit(x) for x in kmer_alphabet(k)])
    return table.select(*keys, F.transform(names, lambda x: F.coalesce(F.col("m")[x], F.lit(0.0))).alias(out))


@dataclass(frozen=True)
class KmerPcaModel:
    """Mean and components of centred k-mer frequencies (at most 4^k × 4^k numbers)."""

    k: int
    mean: np.ndarray
    components: np.ndarray  # (4^k, n_components)

    @property
    def dimensions(self) -> int:
        return self.components.shape[1]

    def transform(self, df: DataFrame, seq: str = "sequence", out: str = "vec") -> DataFrame:
        k, mean, components = self.k, self.mean, self.components

        def encode(column: pa.Array) -> np.ndarray:
            # Not a BLAS product: a row's sum must not depend on its place in the batch, or copies stop being ties.
            return np.einsum("ij,jk->ik", frequency_matrix(column, k) - mean, components)

        return _with_vector(df, seq, out, encode)


def fit_kmer_pca(train: DataFrame, k: int = 4, n_components: int = 50, seq: str = "sequence") -> KmerPcaModel:
    """Principal components of the training rows' frequencies; keeps min(n_components, rows, 4^k)."""
    freq = stage(kmer_vectors(train.select(seq), k, seq).select("vec"), "kmer-frequencies")
    vectors = freq.select(array_to_vector("vec").alias("features"))
    summary = vectors.agg(Summarizer.mean(F.col("features")).alias("mean"), F.count("*").alias("n")).first()
    keep = min(n_components, summary["n"], 4**k)
    if keep < 1:
        raise ValueError("cannot fit the encoder without rows")
    model = PCA(k=keep, inputCol="features", outputCol="pca").fit(vectors)
    return KmerPcaModel(k, summary["mean"].toArray(), model.pc.toArray())
