import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import RANKS, BruteCascade, haversine, random_specimens, vector_rows
from taxaspark.functions.geo import haversine_km
from taxaspark.operators import centroids, classifier, fallback
from taxaspark.operators.calibration import ConfidenceMap
from taxaspark.operators.classifier import min_max

SEQUENCE_ONLY = {"seq_weight": 1.0, "geo_weight": 0.0}


def of(rows, split):
    return [r for r in rows if r[0] == split]


def fitted(spark, rows, **options):
    model = fallback.fit(vector_rows(spark, of(rows, "train")), fallback.FallbackSettings(**options))
    return fallback.calibrate(model, vector_rows(spark, of(rows, "val")))


def ask(spark, model, rows):
    return {p.process_id: p for p in fallback.predict(model, vector_rows(spark, rows)).collect()}


def at(vectors, split="test"):
    return [(split, f"at{i}", (None,) * 4, None, None, v) for i, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def specimens():
    return random_specimens(160, labels=7, dims=5, seed=21)


@pytest.fixture(scope="module")
def plain(spark, specimens):
    """No geography, no support prior: the raw score is visible."""
    return fitted(spark, specimens, sample_count_prior=0.0, **SEQUENCE_ONLY)


def test_a_label_met_exactly_is_certain(spark, specimens, plain):
    brute = BruteCascade(of(specimens, "train"), (1.0, 0.0), prior=0.0)
    table = brute.ranks["species"][0]
    got = ask(spark, plain, at([centre for _, centre, _, _, _ in table]))
    for i, (label, _, _, n, first) in enumerate(table):
        p = got[f"at{i}"]
        assert p.predicted_rank == "species" and not p.is_novel and p.nearest["species"] == label
        assert tuple(p[r] for r in RANKS) == first
        assert p.confidence["species"] == pytest.approx(1.0, abs=1e-9) and p.support["species"] == n


def test_queries_out_of_reach_name_nothing_but_list_relatives(spark, specimens, plain):
    rng = np.random.default_rng(8)
    away = [(v / np.linalg.norm(v) * 10.0**k).tolist() for k, v in zip((3, 4, 7), rng.normal(size=(3, 5)), strict=True)]
    brute = BruteCascade(of(specimens, "train"), (1.0, 0.0))
    got = ask(spark, plain, at(away))
    for i, v in enumerate(away):
        p, order = got[f"at{i}"], {r: brute.distances(r, np.array(v), None, None) for r in RANKS}
        assert p.is_novel and p.predicted_rank is None and {p[r] for r in RANKS} == {None}
        assert set(p.confidence) == set(p.distance) == set(p.support) == set(RANKS) and set(p.confidence.values()) == {0.0}
        for hits, rank in ((p.nearest_species, "species"), (p.nearest_genera, "genus")):
            want = order[rank][: len(hits)]
            assert [h.label for h in hits] == [w[1] for w in want]
            assert [h.distance for h in hits] == pytest.approx([w[0] for w in want], rel=1e-9)
            assert [h.support for h in hits] == [w[2] for w in want]
        assert p.closest_relative_species == p.nearest_species[0].label
        assert all(h.species is None and (h.family, h.order) == h_up for h, h_up in zip(p.nearest_genera, [w[3][2:] for w in order["genus"]], strict=False))


@pytest.mark.parametrize("prior", [1.5, 9.0])
def test_prior_scales_confidence_by_support(spark, specimens, plain, prior):
    queries = of(specimens, "test")
    raw, scaled = ask(spark, plain, queries), ask(spark, fitted(spark, specimens, sample_count_prior=prior, **SEQUENCE_ONLY), queries)
    for key, p in raw.items():
        assert all(0.0 <= v <= 1.0 for v in p.confidence.values())
        for r in RANKS:
            n = p.support[r]
            assert scaled[key].confidence[r] == pytest.approx(p.confidence[r] * n / (n + prior))
        assert scaled[key].predicted_rank == p.predicted_rank


def test_maps_change_confidence_but_no_decision(spark, specimens, plain):
    queries = of(specimens, "test")
    mapped = ask(spark, plain.with_calibrators({r: ConfidenceMap("isotonic", constant=0.61) for r in RANKS[:2]}), queries)
    for key, p in ask(spark, plain, queries).items():
        assert mapped[key].predicted_rank == p.predicted_rank
        assert [mapped[key].confidence[r] for r in RANKS[:2]] == pytest.approx([0.61, 0.61])
        assert [mapped[key].confidence[r] for r in RANKS[2:]] == pytest.approx([p.confidence[r] for r in RANKS[2:]])


def test_settings_out_of_range_and_missing_thresholds_raise(spark, specimens):
    for bad in ({"n_nearest_relatives": -3}, {"sample_count_prior": -0.01}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            fallback.FallbackSettings(**bad)
    uncalibrated = fallback.fit(vector_rows(spark, of(specimens, "train")[:5]))
    with pytest.raises(RuntimeError):
        fallback.predict(uncalibrated, vector_rows(spark, []))


def test_cascade_equals_brute_force_with_geography(spark):
    rows = random_specimens(240, labels=9, seed=4)
    # unlocated labels, so that the geographic term is off for some of them
    rows = [(s, i, t, None, None, v) if t[0] in ("s1", "s2") else (s, i, t, la, lo, v) for s, i, t, la, lo, v in rows]
    train, val, test = ([r for r in rows if r[0] == k] for k in ("train", "val", "test"))
    brute = BruteCascade(train).calibrate(val)
    model = fallback.calibrate(fallback.fit(vector_rows(spark, train)), vector_rows(spark, val))
    for rank in RANKS:
        assert model.thresholds[(0.5, rank)] == pytest.approx(brute.cut[rank])
        assert model.spacing[(0.5, rank)] == pytest.approx(brute.ranks[rank][1:])
    got = {p.process_id: p for p in fallback.predict(model, vector_rows(spark, val + test)).collect()}
    for row in val + test:
        committed, taxa, confidence, nearest = brute.predict(row)
        p = got[row[1]]
        assert p.predicted_rank == committed and p.is_novel == (committed != "species")
        assert {r: p[r] for r in RANKS} == taxa
        assert p.nearest == nearest
        assert p.confidence == pytest.approx(confidence, abs=1e-9)


def test_spacing_of_labels_in_one_place(spark):
    rows = [("train", f"x{i}", (f"s{i}", f"g{i}", "f", "o"), 12.5, -7.25, (4.0, -1.0, 2.5)) for i in range(3)]
    spacing = centroids.centroid_spacing(centroids.fit_centroids(vector_rows(spark, rows)))
    assert spacing[(0.5, "species")] == (1.0, pytest.approx(1e-9))  # zero medians
    assert spacing[(0.5, "family")] == (1.0, None)  # a single label has no pair


# --- base classifier -----------------------------------------------------------------------------


def brute_species(train, row, seq_weight, geo_weight):
    """Nearest species by min-max scaled distances, from the definition."""
    labels = sorted({r[2][0] for r in train})
    mine = {s: [r for r in train if r[2][0] == s] for s in labels}
    scale = lambda d: (d - d.min()) / (d.max() - d.min()) if d.max() > d.min() else d * 0
    combined = scale(np.array([np.linalg.norm(np.mean([r[5] for r in mine[s]], axis=0) - row[5]) for s in labels]))
    if row[3] is not None:
        km = np.array([haversine(row[3], row[4], *np.mean([(r[3], r[4]) for r in mine[s]], axis=0)) for s in labels])
        combined = seq_weight * combined + geo_weight * scale(km)
    return labels[int(combined.argmin())], combined


@pytest.mark.parametrize("weights", [(1.0, 0.0), (0.55, 0.45), (0.1, 0.9)])
def test_classifier_equals_its_definition(spark, weights):
    train = of(random_specimens(120, labels=6, dims=4, seed=31, located=1.0), "train")
    queries = of(random_specimens(80, labels=6, dims=4, seed=32, located=0.6), "test")
    model = classifier.fit(vector_rows(spark, train), *weights)
    taxa = {r[2][0]: r[2] for r in train}
    got = {p.process_id: p for p in classifier.predict(model, vector_rows(spark, queries), distances=True).collect()}
    for row in queries:
        species, combined = brute_species(train, row, *weights)
        p = got[row[1]]
        assert tuple(p[r] for r in RANKS) == taxa[species]
        assert len(p.distances) == len(combined)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-1000, 1000).map(float), min_size=1, max_size=8))
def test_min_max_lies_in_the_unit_interval(values):
    v = np.array([values])
    scaled = min_max(v, v.min(axis=1), v.max(axis=1))
    assert ((scaled >= 0) & (scaled <= 1)).all()
    assert scaled.any() == (len(set(values)) > 1)


def test_weights_are_shares(spark):
    rows = vector_rows(spark, of(random_specimens(16, seed=2, located=1.0), "train"))
    model = classifier.fit(rows, 3.0, 9.0)
    assert (model.seq_weight, model.geo_weight) == pytest.approx((0.25, 0.75))


def test_haversine_equals_the_scalar_formula(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, (a, b, c, d))) for a, b, c, d in zip(rng.uniform(-90, 90, 40), rng.uniform(-180, 180, 40), rng.uniform(-90, 90, 40), rng.uniform(-180, 180, 40), strict=True)]
    rows += [(r[0], r[1], r[0], r[1]) for r in rows[:3]]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    km = [r[0] for r in df.select(haversine_km(*[F.col(c) for c in "abcd"])).collect()]
    assert km == pytest.approx([haversine(*r) for r in rows], abs=1e-6)
