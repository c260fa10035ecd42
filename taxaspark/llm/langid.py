"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled rows that the weights are fitted on, per language at most (about a fifth of them sets the temperature).
FIT_ROWS = 4000
MAX_LANGUAGES = 1000
SHARDS = 8
PASSES = 3

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


_LETTERS: list[np.ndarray] = []


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, count) of a whole text's character 1- to 3-grams; anything but letters counts as a blank, and runs of
    blanks as one. None if there is no letter."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTERS[0][codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.concatenate(([True], letter[:-1]))].astype(np.uint64)
    parts = []
    for order in ORDERS:
        if len(codes) >= order:
            value = codes[: len(codes) - order + 1].copy()
            for i in range(1, order):
                value = (value << np.uint64(21)) + codes[i : len(codes) - order + 1 + i]
            parts.append(((value * np.uint64(2 * order + 1) * _MIX) >> np.uint64(49)).astype(np.int64))
    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def tf_idf(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    found, n = counts
    x = np.log1p(n) * idf[found]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


class Ftrl:
    """Follow the regularised leader, proximal form, with elastic net; one weight per bucket and language."""

    def __init__(self, languages: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4):
        self.z, self.n = np.zeros((BUCKETS, languages)), np.zeros((BUCKETS, languages))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, found: np.ndarray, x: np.ndarray, language: int) -> None:
        w = self.weights(found)
        error = softmax(x @ w)
        error[language] -= 1.0
        g = x[:, None] * error
        n = self.n[found]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[found] += g - sigma * w
        self.n[found] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, text: str | None) -> np.ndarray | None:
        counts = gram_counts(text) if text else None
        return None if counts is None or not self.languages else tf_idf(counts, self.idf) @ self.weights[counts[0]]


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows with a letter, and how many of them hold each bucket; a task adds up its rows before anything moves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.iloc[:, 0]:
                if text and (counts := gram_counts(text)):
                    held[counts[0]] += 1
                    held[-1] += 1
        found = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": found, "df": held[found]})

    got = texts.mapInPandas(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    df[got["bucket"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    return int(df[-1]), df[:-1]


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the rows where ``train`` holds and ``lang`` is not null.

    Document frequencies come from all of them. The weights come from a sample of about ``fit_rows`` rows per language
    by a hash of the key: shards of it are learned side by side and their weights averaged. A fifth of the sample
    is kept out of that, and the temperature minimises its loss. Without any such row the model knows no language.
    """
    rows = docs.where(train & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("y"), F.col(text).alias("x"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    n, df = document_frequencies(rows.select("x"))
    idf = np.log((1 + n) / (1 + df)) + 1
    spread = F.abs(F.xxhash64("k", F.lit("fit"))) % 1_000_000
    rate = F.create_map(*[F.lit(v) for y in languages for v in (y, fit_rows / sizes[y] * 1e6)])
    of = F.create_map(*[F.lit(v) for i, y in enumerate(languages) for v in (y, i)])
    sample = rows.where(spread < rate[F.col("y")]).select(of[F.col("y")].alias("y"), "x", (F.abs(F.xxhash64("k", F.lit("part"))) % (SHARDS * 5)).alias("part"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(len(languages))
        seen = [(y, c) for y, t in zip(part["y"], part["x"], strict=True) if t and (c := gram_counts(t))]
        seen = [(y, c[0], tf_idf(c, idf)) for y, c in seen]
        order = np.random.default_rng(0)
        for _ in range(PASSES):
            for i in order.permutation(len(seen)):
                model.learn(seen[i][1], seen[i][2], seen[i][0])
        return pd.DataFrame({"rows": [len(seen)], "w": [model.weights().astype("<f4").tobytes()]})

    learned = sample.where(f"part >= {SHARDS}").withColumn("shard", F.col("part") % SHARDS).groupBy("shard").applyInPandas(learn, "rows long, w binary").collect()
    weights, total = np.zeros((BUCKETS, len(languages))), max(1, sum(r["rows"] for r in learned))
    for r in sorted(learned, key=lambda r: (r["rows"], bytes(r["w"]))):
        weights += np.frombuffer(r["w"], "<f4").reshape(weights.shape) * (r["rows"] / total)
    model = Model(languages, idf, weights, 1.0)
    return Model(languages, idf, weights, temperature(sample.where(f"part < {SHARDS}"), model))


def temperature(sample: DataFrame, model: Model) -> float:
    """By which logits are divided so that the loss of rows not learned from is least."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(y, z.tolist()) for y, t in zip(batch["y"], batch["x"], strict=True) if (z := model.logits(t)) is not None]
            yield pd.DataFrame(made, columns=["y", "z"])

    got = sample.select("y", "x").mapInPandas(score, "y int, z array<double>").collect()
    if not got:
        return 1.0
    z, y = np.array([r["z"] for r in got]), np.array([r["y"] for r in got])

    def loss(log_t: float) -> float:
        p = softmax(z / np.exp(log_t))[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-300)).mean() + 1e-4 * log_t * log_t

    grid = np.linspace(-4, 3, 141)
    return float(np.exp(grid[int(np.argmin([loss(t) for t in grid]))]))


def predict(model: Model, text: str | Column) -> Column:
    """struct<lang, score> of a whole text: the likeliest language, the first by name of equal ones, and its calibrated
    probability. A null text, one without a letter, or a model that knows no language gives ``und`` and 0."""

    @F.pandas_udf("struct<lang:string,score:double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for t in part:
                z = model.logits(t)
                if z is None:
                    out.append((UNKNOWN, 0.0))
                else:
                    p = softmax(z / model.temperature)
                    best = int(p.argmax())
                    out.append((model.languages[best], float(p[best])))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return run(F.col(text) if isinstance(text, str) else text)
