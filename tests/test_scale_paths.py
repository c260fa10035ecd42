"""The paths that only large inputs take, forced on small ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark import RANKS
from helpers import BruteCascade, random_specimens, vector_rows
from taxaspark.operators import cells, centroids, classifier, fallback, naive_bayes, nearest, nearest_neighbor, quantiles
from taxaspark.operators.nearest import distance_profiles, nearest_hits

KEY = ["holdout_fraction", "process_id"]


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(cells, "MIN_CELL_ROWS", 5)


@pytest.fixture(scope="module")
def rows(spark):
    return random_specimens(200, labels=10, seed=8)


def part(spark, rows, *splits):
    return vector_rows(spark, [r for r in rows if r[0] in splits]).cache()


def test_cells_meet_every_pair_once(spark):
    left = spark.range(57).select(F.col("id").alias("a"))
    right = spark.range(41).select(F.col("id").alias("b"))

    def pairs(x, y):
        import pyarrow as pa

        a, b = x["a"].to_numpy(), y["b"].to_numpy()
        return pa.table({"a": np.repeat(a, len(b)), "b": np.tile(b, len(a))})

    out = cells.cell_join(left, right, pairs, "a bigint, b bigint", 8).collect()
    assert len(out) == 57 * 41 == len({(r.a, r.b) for r in out})


def test_nearest_by_cells_equals_broadcast(spark, rows):
    train, queries = part(spark, rows, "train"), part(spark, rows, "val", "test")
    model = fallback.fit(train)
    k = {"species": 3, "genus": 2, "family": 1, "order": 1}
    small = nearest_hits(queries, model.centroids, k, model.metric)
    large = nearest_hits(queries, model.centroids, k, model.metric, broadcast_bytes=0)
    a = {r.process_id: [(h.rank, h.label, round(h.distance, 9)) for h in r.hits] for r in small.collect()}
    b = {r.process_id: [(h.rank, h.label, round(h.distance, 9)) for h in r.hits] for r in large.collect()}
    assert a == b and len(a) == queries.count()
    assert set(small.columns) == set(large.columns)


def test_distance_profiles_add_up_all_labels(spark, rows):
    train, queries = part(spark, rows, "train"), part(spark, rows, "val", "test")
    model = fallback.fit(train)
    labels = model.centroids.count()
    every = {}
    for r in nearest_hits(queries, model.centroids, {r: labels for r in RANKS}, model.metric).collect():
        for h in r.hits:
            every.setdefault((r.process_id, h["rank"]), []).append(h.distance)
    want = {k: (len(d), sum(d), sum(x * x for x in d), min(d), max(d)) for k, d in every.items()}
    for limit in (None, 0):
        out = distance_profiles(queries, model.centroids, RANKS, model.metric, broadcast_bytes=limit)
        got = {(r.process_id, r["rank"]): (r.n_labels, r.total, r.squares, r.least, r.most) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_spacing_by_cells_equals_broadcast(spark, rows):
    c = centroids.fit_centroids(part(spark, rows, "train"))
    small, large = centroids.centroid_spacing(c), centroids.centroid_spacing(c, broadcast_bytes=0)
    assert small.keys() == large.keys()
    assert all(large[k] == pytest.approx(small[k]) for k in small)
    brute = BruteCascade([r for r in rows if r[0] == "train"])
    for rank, (_, seq, geo) in brute.ranks.items():
        assert small[(0.5, rank)] == pytest.approx((seq, geo))


def test_classifier_by_cells_equals_broadcast(spark, rows):
    model = classifier.fit(part(spark, rows, "train"))
    queries = part(spark, rows, "val", "test")
    a = {r.process_id: r for r in classifier.predict(model, queries, distances=True).collect()}
    b = {r.process_id: r for r in classifier.predict(model, queries, distances=True, broadcast_bytes=0).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert (a[i].species, a[i].order) == (b[i].species, b[i].order)
        assert b[i].nearest_distance == pytest.approx(a[i].nearest_distance)
        assert b[i].distances == pytest.approx(a[i].distances)


def test_bayes_by_cells_equals_broadcast(spark, rows):
    positive = [(s, i, t, la, lo, np.abs(v) / np.abs(v).sum()) for s, i, t, la, lo, v in rows]
    model = naive_bayes.fit(part(spark, positive, "train"))
    queries = part(spark, positive, "val", "test")
    a = {r.process_id: r for r in naive_bayes.predict(model, queries).collect()}
    b = {r.process_id: r for r in naive_bayes.predict(model, queries, broadcast_bytes=0).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert a[i].species == b[i].species and a[i].nearest == b[i].nearest
        assert b[i].confidence == pytest.approx(a[i].confidence)


def test_neighbours_by_cells_equal_broadcast(spark, rows):
    train, queries = part(spark, rows, "train"), part(spark, rows, "val", "test")
    a, b = nearest_neighbor.fit(train), nearest_neighbor.fit(train, broadcast_bytes=0)
    assert a.scales == pytest.approx(b.scales)
    x = {r.process_id: (r.nearest_id, r.nearest_distance) for r in nearest_neighbor.predict(a, queries).collect()}
    y = {r.process_id: (r.nearest_id, r.nearest_distance) for r in nearest_neighbor.predict(b, queries, broadcast_bytes=0).collect()}
    assert x == y


def test_copies_of_a_third_of_the_rows(spark):
    """A third of all rows is one specimen under many ids: nothing is lost and ties stay ordered."""
    rows = random_specimens(90, labels=4, seed=2)
    hot = [("train", f"H{i:03d}", rows[0][2], 1.0, 2.0, rows[0][5]) for i in range(45)]
    train = vector_rows(spark, [r for r in rows if r[0] == "train"] + hot)
    queries = vector_rows(spark, [("test", f"q{i:03d}", rows[0][2], 1.0, 2.0, rows[0][5]) for i in range(45)])
    for limit in (None, 0):
        model = nearest_neighbor.fit(train, broadcast_bytes=limit)
        out = nearest_neighbor.predict(model, queries, broadcast_bytes=limit).collect()
        assert len(out) == 45 and {r.nearest_id for r in out} == {"H000"}


@pytest.mark.parametrize("prob", [0.0, 0.1, 0.5, 0.9, 0.97, 1.0])
@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_quantiles_by_refinement_equal_numpy(spark, monkeypatch, prob, kind):
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 0)
    rng = np.random.default_rng(7)
    draw = {
        "normal": lambda n: rng.normal(size=n),
        "ties": lambda n: rng.integers(0, 4, size=n).astype(float),
        "heavy": lambda n: np.exp(rng.normal(size=n) * 12),
    }[kind]
    groups = {"a": draw(501), "b": draw(1000), "c": draw(1), "d": np.full(9, 2.5)}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double").cache()
    got = {r.g: r["quantile"] for r in quantiles.exact_quantile(df, ["g"], "v", prob).collect()}
    assert got == pytest.approx({g: np.percentile(v, 100 * prob) for g, v in groups.items()}, rel=1e-12)


def test_results_do_not_depend_on_partitions(spark, rows):
    train, val, queries = part(spark, rows, "train"), part(spark, rows, "val"), part(spark, rows, "test")

    def run(n):
        model = fallback.calibrate(fallback.fit(train.repartition(n)), val.repartition(n))
        out = fallback.predict(model, queries.repartition(n)).collect()
        return {r.process_id: (r.predicted_rank, r.species, r.order, {k: round(v, 9) for k, v in r.confidence.items()}) for r in out}

    assert run(1) == run(4) == run(16)


def test_rows_meet_only_those_of_their_own_value(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_BYTES", 0)
    left = spark.range(300).select((F.col("id") % 3).cast("double").alias("v"), F.col("id").alias("a"))
    right = spark.range(200).select((F.col("id") % 4).cast("double").alias("v"), F.col("id").alias("b"))

    def pairs(a, b):
        assert len(set(a["v"].to_pylist() + b["v"].to_pylist())) <= 1
        both = [(x, y) for x in a["a"].to_pylist() for y in b["b"].to_pylist()]
        return pa.table({"a": pa.array([x for x, _ in both], pa.int64()), "b": pa.array([y for _, y in both], pa.int64())})

    got = cells.cell_join(left, right, pairs, "a bigint, b bigint", 8, within="v").collect()
    assert sorted(map(tuple, got)) == [(x, y) for x in range(300) for y in range(200) if x % 3 == y % 4]


def test_single_precision_leaves_few_pairs_and_loses_none():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(900, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    tables = [unit, unit * 1e-30, unit * 1e30, unit + 1e5, np.concatenate([unit, unit[:300]]), np.concatenate([unit, [[1e9] * 64]]), np.ones((900, 3)), np.zeros((900, 3))]
    for c in tables:
        q, own = c[:200], np.arange(200)
        every = np.sqrt(((q[:, None, :] - c[None]) ** 2).sum(axis=2))
        every[own, own] = np.inf
        for k in (1, 4):
            row, at, d = nearest.nearest_indices(q, c, k, skip=own)
            want = np.argsort(every, axis=1, kind="stable")[:, :k]
            assert (row == np.repeat(own, k)).all() and (at == want.ravel()).all() and (d == np.take_along_axis(every, want, 1).ravel()).all()
    row, _ = nearest._Screen.of(unit, unit).candidates(unit, 1, np.arange(900))
    assert len(row) < 1.1 * 900


def test_hits_of_few_rows_are_held_at_once(spark, rows, monkeypatch):
    whole = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["a"])
    parts = list(nearest._slices([whole, whole.slice(0, 0), whole.slice(0, 3)]))
    assert [p.num_rows for p in parts] == [1024, 1024, 452, 3] and parts[1].column(0)[0].as_py() == 1024
    seen = []
    monkeypatch.setattr(nearest, "hits_of_batch", lambda batch, *_: seen.append(batch.num_rows) or pa.array([[]] * batch.num_rows, pa.list_(nearest._HIT_TYPE)))
    train = part(spark, rows, "train")
    labels = nearest.share_labels(nearest_neighbor.row_labels(train))

    class Frame:
        def mapInArrow(self, scan, schema):
            return list(scan([whole]))

    nearest._by_broadcast(Frame(), labels.data, {"row": 1}, nearest.Metric(), False, [T.StructField("a", T.LongType())])
    assert seen == [1024, 1024, 452]
