import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark.operators import isotonic


def curve(x, y):
    """Sorted different scores and their fit, by the max-min formula."""
    at = np.unique(x)
    w = np.array([(x == v).sum() for v in at])
    total = np.array([y[x == v].sum() for v in at])
    low = np.concatenate([[0], np.cumsum(w)])
    sums = np.concatenate([[0], np.cumsum(total)])
    mean = lambda a, b: (sums[b + 1] - sums[a]) / (low[b + 1] - low[a])
    n = len(at)
    return at, np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def frame(spark, groups):
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "g string, confidence double, correct double").repartition(6)


@pytest.mark.parametrize("fan_in", [16, 2])
def test_curves_of_many_groups(spark, monkeypatch, fan_in):
    """With a fan-in of two, blocks go through several rounds."""
    monkeypatch.setattr(isotonic, "FAN_IN", fan_in)
    rng = np.random.default_rng(3)
    groups = {}
    for g, n in (("rising", 150), ("falling", 120), ("flat", 40), ("one", 1), ("ties", 200), (None, 60)):
        x = np.round(rng.uniform(0, 1, n), 1 if g == "ties" else 4)
        chance = {"falling": 1 - x, "flat": np.zeros(n)}.get(g, x)
        groups[g] = (x, (rng.uniform(0, 1, n) < chance).astype(float))
    rows = frame(spark, groups)
    curves = isotonic.fit_curves(isotonic.pooled_scores(rows, ["g"]), ["g"])
    asked = np.concatenate([np.linspace(-0.2, 1.2, 57), *(x for x, _ in groups.values())])
    probe = spark.createDataFrame([(g, float(a)) for g in [*groups, "unknown"] for a in asked], "g string, confidence double")
    got = {}
    for r in isotonic.apply_curves(probe.withColumn("x", F.col("confidence")), curves, ["g"]).collect():
        got[r.g, r.x] = r.confidence
    for g, (x, y) in groups.items():
        at, fit = curve(x, y)
        assert [got[g, float(a)] for a in asked] == pytest.approx(np.interp(asked, at, fit).tolist())
    assert all(v is None for (g, _), v in got.items() if g == "unknown")


def test_leaving_folds_out_is_fitting_the_others(spark):
    rng = np.random.default_rng(4)
    rows = [(f, g, float(x), float(rng.uniform() < x)) for f in (0.3, 0.5, 0.7) for g in "ab" for x in np.round(rng.uniform(0, 1, 60), 2)]
    df = spark.createDataFrame(rows, "holdout_fraction double, g string, confidence double, correct double").withColumn("x", F.col("confidence"))
    out = isotonic.leave_one_out(df, ["g"]).collect()
    assert len(out) == len(rows)
    for r in out:
        others = np.array([(x, y) for f, g, x, y in rows if g == r.g and f != r.holdout_fraction])
        assert r.confidence == pytest.approx(float(np.interp(r.x, *curve(others[:, 0], others[:, 1]))))
    one = df.where("holdout_fraction = 0.3")
    got = sorted(map(str, isotonic.leave_one_out(one, ["g"]).collect()))
    assert got == sorted(map(str, isotonic.recalibrated(one, ["g"]).collect()))


def test_missing_scores_and_no_rows(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 0.5, None), ("a", 0.4, 1.0)], "g string, confidence double, correct double")
    got = [r.confidence for r in isotonic.recalibrated(df, ["g"]).orderBy("confidence").collect()]
    assert got == [None, 1.0, 1.0]
    assert isotonic.recalibrated(df.limit(0), ["g"]).count() == 0
