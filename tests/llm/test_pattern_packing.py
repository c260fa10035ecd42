import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from taxaspark.llm import pattern_packing as pp

TOKENIZER = Tokenizer.from_str(corpus_pipeline.tokenizer_json())


def ids_of(text):
    return np.asarray([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()


def test_patterns_are_all_ways_to_fill():
    want = {tuple(sorted(c, reverse=True)) for c in itertools.product(range(13), repeat=3) if sum(c) == 12}
    assert Counter(map(tuple, pp.patterns(12).tolist())) == Counter(want)


def test_least_squares_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((12, 40)), rng.random(12) * 5
        x = pp.nonnegative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def checked(histogram, capacity):
    """The plan read piece by piece: every piece once, every sequence gapless and within capacity."""
    made = pp.plan(dict(histogram), capacity)
    seen, sequences = Counter(), defaultdict(list)
    for length, first, n, times, base, offset in made.runs:
        for i in range(n):
            seen[length, first + i] += 1
            sequences[base + i // times].append((offset + i % times * length, length))
    assert seen == Counter({(length, r): 1 for length, n in histogram.items() for r in range(n)})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(sequences) == set(range(made.next_id))
    return made.next_id


def test_plans_of_random_histograms():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([1, 2, 7, 64, 100, 300, 1000])
        many = Counter(rng.choices(range(1, capacity + 1), k=rng.randint(1, 500)))
        few = Counter({rng.randint(1, capacity): rng.randint(1, 3000) for _ in range(rng.randint(1, 5))})
        checked(rng.choice([many, few]), capacity)
    assert checked({}, 10) == 0
    for bad in ({0: 1}, {11: 1}):
        with pytest.raises(ValueError):
            pp.plan(bad, 10)


def test_few_sequences():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6.5, 1.1, 20000).astype(int) + 1, 4096)
    histogram = Counter(lengths.tolist())
    least = -(-int(lengths.sum()) // 4096)
    assert checked(histogram, 4096) <= 1.005 * least + 2


def test_the_plan_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(1)
    histogram = Counter(rng.integers(1, 501, 5000).tolist())
    small, large = pp.plan(dict(histogram), 500), pp.plan({k: 10**6 * n for k, n in histogram.items()}, 500)
    assert len(large.runs) < 3 * len(small.runs)


@pytest.mark.parametrize("partitions", [1, 5])
def test_every_id_lies_in_one_piece(spark, partitions):
    rng = random.Random(1)
    words = ["alpha", "Beta,", "gämma!", "x" * 40, "12.5", "ok."]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 7, 90, 900])))) for i in range(80)]
    rows += [(100, None), (None, "null key"), (101, "word " * 9000), (102, "word " * 4095), (103, "same text")] + [(104, "same row")] * 3
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    docs = docs.select(*[F.lit(1).alias(c) for c in ("piece", "ids", "part", "nth", "before", "place", "length")], "*").repartition(partitions)
    pieces = pp.pack(docs, corpus_pipeline.tokenizer_json()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert p["length"] * 4 == len(p["ids"])
    assert set(by_doc) == {k for k, _ in rows}
    for k, text in rows:
        if k == 104:
            assert [bytes(p["ids"]) for p in by_doc[k]] == [ids_of(text)] * 3
            continue
        parts = sorted(by_doc[k], key=lambda p: p["piece"])
        assert b"".join(bytes(p["ids"]) for p in parts) == ids_of(text)
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert [p["start"] for p in parts] == [4096 * i for i in range(len(parts))]
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    least = -(-sum(p["length"] for p in pieces) // 4096)
    assert len(by_sequence) <= least + 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert pp.pack(docs, corpus_pipeline.tokenizer_json()).count() == 0
