"""Small tables and brute-force twins used by several tests."""

import math
import random

import numpy as np

RANKS = ("species", "genus", "family", "order")
VECTOR_ROW = "holdout_fraction double, split string, process_id string, species string, genus string, family string, `order` string, lat double, lon double, vec array<double>"


def vector_rows(spark, rows):
    """rows: (split, id, taxonomy 4-tuple, lat, lon, vec)."""
    data = [(0.5, s, i, *t, lat, lon, [float(x) for x in v]) for s, i, t, lat, lon, v in rows]
    return spark.createDataFrame(data, VECTOR_ROW)


def random_sequence(seed, length=150):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(length))


def random_specimens(n, labels=8, dims=6, seed=0, located=0.8):
    """(split, id, taxonomy, lat, lon, vec) with nested taxonomy; every split is used."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) * 3
    out = []
    for i in range(n):
        k = int(rng.integers(labels))
        lat, lon = (float(rng.uniform(-80, 80)), float(rng.uniform(-170, 170))) if rng.random() < located else (None, None)
        split = ("train", "train", "val", "test")[i % 4]
        taxonomy = (f"s{k}", f"g{k // 2}", f"f{k // 4}", "o0")
        out.append((split, f"P{i:04d}", taxonomy, lat, lon, centres[k] + rng.normal(size=dims)))
    return out


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, max(0.0, a))))


class BruteCascade:
    """The cascade, one row at a time, from its definition."""

    def __init__(self, train, weights=(0.8, 0.2), percentile=90.0, prior=5.0):
        self.weights, self.percentile, self.prior = weights, percentile, prior
        self.ranks = {}
        for level, rank in enumerate(RANKS):
            labels = sorted({r[2][level] for r in train})
            table = []
            for label in labels:
                mine = sorted((r for r in train if r[2][level] == label), key=lambda r: r[1])
                located = [(r[3], r[4]) for r in mine if r[3] is not None and r[4] is not None]
                geo = tuple(np.mean(located, axis=0)) if located else None
                table.append((label, np.mean([r[5] for r in mine], axis=0), geo, len(mine), mine[0][2]))
            pairs = [(a, b) for i, a in enumerate(table) for b in table[i + 1 :]]
            seq = float(np.median([np.linalg.norm(a[1] - b[1]) for a, b in pairs])) if pairs else None
            km = [haversine(*a[2], *b[2]) for a, b in pairs if a[2] and b[2]]
            self.ranks[rank] = (table, max(seq or 1.0, 1e-9), max(float(np.median(km)), 1e-9) if km else None)

    def distances(self, rank, vec, lat, lon):
        table, seq_scale, geo_scale = self.ranks[rank]
        out = []
        for label, centre, geo, n, first in table:
            d = float(np.linalg.norm(centre - vec)) / seq_scale
            if lat is not None and lon is not None and geo is not None and geo_scale is not None:
                d = self.weights[0] * d + self.weights[1] * haversine(lat, lon, *geo) / geo_scale
            out.append((d, label, n, first))
        return sorted(out, key=lambda x: (x[0], x[1]))

    def calibrate(self, val):
        self.cut = {
            rank: float(np.percentile([self.distances(rank, r[5], r[3], r[4])[0][0] for r in val], self.percentile)) if val else 0.0
            for rank in RANKS
        }
        return self

    def predict(self, row):
        near = {rank: self.distances(rank, row[5], row[3], row[4])[0] for rank in RANKS}
        committed = next((r for r in RANKS if near[r][0] <= self.cut[r]), None)
        taxa = dict.fromkeys(RANKS)
        if committed:
            for level in range(RANKS.index(committed), 4):
                taxa[RANKS[level]] = near[committed][3][level]
        confidence = {}
        for r in RANKS:
            d, t, n = near[r][0], self.cut[r], near[r][2]
            raw = (1.0 if d <= 1e-12 else 0.0) if t <= 1e-12 else min(1.0, max(0.0, 1 - d / t))
            confidence[r] = raw * n / (n + self.prior)
        return committed, taxa, confidence, {r: near[r][1] for r in RANKS}
