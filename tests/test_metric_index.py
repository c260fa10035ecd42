import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.operators import metric_index, nearest_neighbor
from taxaspark.operators.nearest import direct_distance

SCHEMA = "holdout_fraction double, process_id string, vec array<double>, " + ", ".join(f"`{r}` string" for r in RANKS)


def clustered(rng, n, clusters=40, dims=6, spread=0.05):
    return rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] * 5 + rng.normal(size=(n, dims)) * spread


def frame(spark, vec, fraction=0.5, prefix="t"):
    rows = [(fraction, f"{prefix}{i:06d}", v.tolist(), *(f"{r}{i % 7}" for r in RANKS)) for i, v in enumerate(vec)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute(queries, rows, skip=False):
    """(place, distance) of the nearest row, the first among equals."""
    out = []
    for i, q in enumerate(queries):
        d = direct_distance(np.repeat(q[None], len(rows), axis=0), rows)
        if skip:
            d[i] = np.inf
        out.append((int(d.argmin()), float(d.min())))
    return out


def found(result):
    return {r["process_id"]: (r["found"] and (r["found"]["label"], r["found"]["distance"]), r["compared"]) for r in result.collect()}


@pytest.mark.parametrize("visits", [metric_index.VISITS, 7])
def test_nearest_is_the_nearest(spark, monkeypatch, visits):
    """Copies, ties and a dense third included; rings of five rows, and with 7 rings are compared part by part."""
    monkeypatch.setattr(metric_index, "VISITS", visits)
    rng = np.random.default_rng(3)
    rows = np.concatenate([clustered(rng, 300), np.tile(rng.normal(size=6), (60, 1)), rng.normal(size=(1, 6)) + rng.normal(size=(150, 6)) * 1e-3, [[0.0] * 6, [2.0, 0, 0, 0, 0, 0]]])
    queries = np.concatenate([clustered(rng, 60), rows[::9], [[1.0, 0, 0, 0, 0, 0]], np.full((1, 6), 1e6)])
    index = metric_index.build(nearest_neighbor.row_labels(frame(spark, rows)), ring_rows=5)
    got = found(metric_index.nearest(index, frame(spark, queries, prefix="q"), most_pairs=None))
    want = brute(queries, rows)
    assert {p: v[0] for p, v in got.items()} == {f"q{i:06d}": (f"t{at:06d}", d) for i, (at, d) in enumerate(want)}


def test_scale_and_calls_are_those_of_the_plain_comparison(spark):
    rng = np.random.default_rng(5)
    parts = [np.concatenate([clustered(rng, 150), np.tile(rng.normal(size=6), (40, 1))]), clustered(rng, 90), np.ones((1, 6)), np.ones((3, 6))]
    train = queries = None
    for i, vec in enumerate(parts):
        t, q = frame(spark, vec, i / 4), frame(spark, vec[::3] + 0.01, i / 4, "q")
        train, queries = (t, q) if train is None else (train.unionByName(t), queries.unionByName(q))
    queries = queries.unionByName(frame(spark, parts[0][:2], 9.0, "q"))  # a fraction without training rows
    models = [nearest_neighbor.fit(train, by_index=way, most_pairs=None) for way in (False, True)]
    assert models[1].index and models[0].scales == pytest.approx(models[1].scales)
    for i, vec in enumerate(parts):
        want = float(np.median([d for _, d in brute(vec, vec, skip=True)])) if len(vec) > 1 else 1.0
        assert models[1].scales[i / 4] == pytest.approx(want if want > 1e-12 else 1.0)
    columns = ["holdout_fraction", "process_id", *RANKS, "nearest_id", "nearest_distance", "confidence"]
    queries = queries.drop(*RANKS).withColumn("split", F.lit("test"))
    calls = [sorted(map(str, nearest_neighbor.predict(m, queries, most_pairs=None).select(*columns).collect())) for m in models]
    assert calls[0] == calls[1] and len(calls[0]) == queries.count()


def test_compared_pairs_grow_slower_than_all_pairs(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(200, 6)) * 5
    share = []
    for n in (1500, 6000):
        rows = centres[rng.integers(0, 200, n)] + rng.normal(size=(n, 6)) * 0.05
        index = metric_index.build(nearest_neighbor.row_labels(frame(spark, rows)), ring_rows=16)
        one = index.rows.select("holdout_fraction", F.col("label").alias("process_id"), "vec")
        compared = metric_index.nearest(index, one, skip_self=True).agg(F.sum("compared")).first()[0]
        share.append(compared / n**2)
    assert share[1] < 0.05 and share[1] < 0.6 * share[0], share


def test_gives_up_where_nothing_is_pruned(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(300, 200))
    train = frame(spark, rows / np.linalg.norm(rows, axis=1)[:, None])
    index = metric_index.build(nearest_neighbor.row_labels(train), ring_rows=4)
    assert metric_index.nearest(index, train.select("holdout_fraction", "process_id", "vec"), skip_self=True, most_pairs=0.5) is None
    model = nearest_neighbor.fit(train, by_index=True)
    assert model.index is None and model.scales[0.5] > 0


def test_a_vector_is_sent_once_to_a_strip(spark, monkeypatch):
    """All of 75 rings or more are asked for by every query, which is sent to four strips or so with a bit for each ring."""
    monkeypatch.setattr(metric_index, "STRIP_BYTES", 80 * 8 * 8)
    monkeypatch.setattr(metric_index, "LEAST_VISITS", 64)
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(300, 8))
    index = metric_index.build(nearest_neighbor.row_labels(frame(spark, rows)), ring_rows=4)
    one = index.rows.select("holdout_fraction", F.col("label").alias("process_id"), "vec")
    every = one.select("*", F.lit(float("inf")).alias("bound"), F.array().cast("array<long>").alias("seen"))
    seen = metric_index._visits(index, every, 0).select(F.size("visits").alias("n"), "pairs").collect()
    strips = index.rows.groupBy("strip").agg(F.count("*").alias("n"), F.count_distinct("place").alias("rings")).collect()
    assert {r["n"] for r in seen} == {len(strips)} and {r["pairs"] for r in seen} == {300}
    assert 4 <= len(strips) <= 6 and max(r["n"] for r in strips) <= 80 and sum(r["rings"] for r in strips) >= 75
    got = found(metric_index.nearest(index, one, skip_self=True, most_pairs=None))
    assert {p: v[0] for p, v in got.items()} == {f"t{i:06d}": (f"t{at:06d}", d) for i, (at, d) in enumerate(brute(rows, rows, skip=True))}


def test_no_rows(spark):
    empty = frame(spark, np.ones((1, 3))).where("false")
    index = metric_index.build(nearest_neighbor.row_labels(empty))
    got = found(metric_index.nearest(index, frame(spark, np.ones((2, 3)))))
    assert got == {"t000000": (None, None), "t000001": (None, None)}
