import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark.llm import ngram_join
from taxaspark.llm.ngram_join import Bands
from taxaspark.llm.shingles import shingles


def shingle_set(text, words):
    parts = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)} if len(parts) >= words else ({tuple(parts)} if parts else set())


def brute(rows, words, num, den):
    sets = [shingle_set(t, words) for _, t in rows]
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                of[root(i)] = root(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    return {i: (len(sets[i]), min((k for k in groups[root(i)] if k is not None), default=None)) for i in range(len(rows))}


def near_copies(seed, bases=12, copies=12):
    """Copies of copies with ever more edits: chains whose ends are not alike."""
    rng, rows = random.Random(seed), []
    for _ in range(bases):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 20, 60, 200, 500]))]
        for _ in range(copies):
            words = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(["New", "OTHER", "x"]) + str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize(("words", "num", "den", "seed"), [(3, 9, 10, 1), (5, 8, 10, 2)])
def test_equals_all_pairs(spark, words, num, den, seed):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "two words"), (906, "Two  words"), (None, "one"), (903, "One"), (None, "alone here"), (907, "long word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("rid", F.lit("x")).withColumn("n", F.lit("y")).withColumn("key", F.lit(0)).repartition(5)
    got = sorted(tuple(map(str, r)) for r in ngram_join.linked_groups(docs, words=words, num=num, den=den).collect())
    want = brute(rows, words, num, den)
    assert got == sorted((str(rows[i][0]), str(n), str(g if n else rows[i][0])) for i, (n, g) in want.items())


def test_large_buckets_in_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 7)
    rows = near_copies(4, bases=2, copies=60)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["group"] for r in ngram_join.linked_groups(docs, words=3, num=9, den=10).collect()}
    assert got == {rows[i][0]: g for i, (_, g) in brute(rows, 3, 9, 10).items()}


def test_open_pairs_need_only_folds(spark):
    rng, bands = np.random.default_rng(7), Bands(8, 10)
    base, rows = np.unique(rng.integers(0, 1 << 63, 1500).astype(np.uint64)), []
    for rid in range(40):  # the even ones are near each other, the odd ones near nothing
        own = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
        found = np.unique(np.concatenate((base[rng.permutation(len(base))[100:]], own[:50])) if rid % 2 == 0 else own)
        band = bands.of(len(found))[0]
        rows.append((rid, len(found), band, ngram_join.folded(bands.sketch(found, band)).view(np.int64).tolist()))
    assert len({r[2] for r in rows}) == 1 and any(x < 0 for r in rows for x in r[3])
    sketches = spark.createDataFrame(rows, "rid long, n long, band int, fold array<long>")
    open_rows = spark.createDataFrame([(rows[0][2] + 256 * k, r[0], r[0]) for r in rows for k in (1, 2)], "bucket long, rid long, label long")
    got = {tuple(r) for r in ngram_join.open_pairs(open_rows, sketches, bands).collect()}
    assert got == {(i, j) for j in range(0, 40, 2) for i in range(0, j, 2)}


def test_folds_grow_with_the_sketch():
    rng = np.random.default_rng(8)
    for num, den in ((9, 10), (8, 10)):
        bands = Bands(num, den)
        for n in (40, 400, 4000, 20000):
            a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
            x, y = (ngram_join.folded(bands.sketch(s, bands.of(n)[0])) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() > bands.differ(2 * n) and len(x) <= max(8, n // 20)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (8, 10)):
        bands = Bands(num, den)
        for _ in range(400):
            n = int(rng.integers(bands.least, 800))
            whole = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            a = np.sort(rng.permutation(whole)[:n])
            most = max(k for k in range(n + 1) if den * (n - k) >= num * (n + k) or k == 0)
            k = int(rng.integers(0, most + 1))
            b = np.sort(np.concatenate((rng.permutation(a)[k:], np.setdiff1d(whole, a)[:k])))
            if den * len(np.intersect1d(a, b)) < num * len(np.union1d(a, b)):
                continue
            keys = [set().union(*(ngram_join.keys(bands.sketch(s, band), band, bands.spare(band)).tolist() for band in bands.of(len(s)))) for s in (a, b)]
            assert keys[0] & keys[1]
            for band in set(bands.of(len(a))) & set(bands.of(len(b))):
                x, y = bands.sketch(a, band), bands.sketch(b, band)
                assert ngram_join.parity(x ^ y).sum() <= len(np.setxor1d(a, b))
                assert np.bitwise_count(ngram_join.folded(x) ^ ngram_join.folded(y)).sum() <= len(np.setxor1d(a, b))


def test_sql_and_numpy_count_the_same_bits(spark):
    rng = np.random.default_rng(5)
    x, y = (rng.integers(0, 1 << 32, 40).astype(np.uint32) for _ in range(2))
    row = spark.createDataFrame([(x.view(np.int64).tolist(), y.view(np.int64).tolist())], "a array<long>, b array<long>")
    got = row.select(ngram_join._flips("a", "b", ngram_join._BLOCK_FIELDS), ngram_join._flips("a", "b", ngram_join._FOLD_FIELDS)).first()
    assert tuple(got) == (ngram_join.parity(x ^ y).sum(), np.bitwise_count(x ^ y).sum())


def test_shingles_end_at_ascii_space_only():
    assert len(shingles("a\x0bb\x0cc d e", 3)) == 2
    assert (shingles("ÀB c d", 3) == shingles("Àb C D", 3)).all()
    assert len(shingles("a b", 3)) == 1 and len(shingles(None, 3)) == 0


def test_keep_one(spark):
    rows = [*near_copies(6, bases=3), (500, None), (500, None), (501, ""), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("doc", F.lit(1)).withColumn("turn", F.lit(2)).withColumn("k", F.lit(3))
    kept = ngram_join.keep_one(docs, words=5, num=8, den=10)
    assert kept.columns == docs.columns
    want = brute(rows, 5, 8, 10)
    names = {str(g if n else rows[i][0]) for i, (n, g) in want.items()}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(names)
    assert ngram_join.linked_groups(docs.limit(0)).count() == 0


def test_kept_rows_do_not_depend_on_partitions(spark):
    rows = [(1, "a b c d e f g h", s) for s in "xyz"] + [(2, "a b c d e f g h", "w"), (3, "other text is here for you to read", "v")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    told = {tuple(sorted(map(str, ngram_join.keep_one(docs.repartition(n)).collect()))) for n in (1, 3, 7)}
    assert len(told) == 1 and len(next(iter(told))) == 2


def test_a_set_keeps_as_many_keys_as_it_needs():
    """One more than it and its largest partner may differ in, however many blocks have as few bits; linked sets still share one."""
    rng = np.random.default_rng(9)
    for num, den in ((9, 10), (8, 10)):
        bands = Bands(num, den)
        for _ in range(300):
            n = int(rng.integers(bands.least, 1200))
            whole = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            a = np.sort(rng.permutation(whole)[:n])
            more = int(rng.integers(0, n * (den - num) // num + 1))  # the largest partner has n * den / num
            b = np.sort(np.concatenate((a, np.setdiff1d(whole, a)[:more])))
            kept = []
            for s in (a, b):
                found = {}
                for band in bands.of(len(s)):
                    found[band] = ngram_join.keys(bands.sketch(s, band), band, bands.spare(band, len(s)))
                    most = min(bands.edge(band + 1) - 1, len(s) * den // num)
                    assert len(found[band]) == bands.differ(len(s) + most) + 1 <= len(ngram_join.keys(bands.sketch(s, band), band, bands.spare(band)))
                kept.append(set().union(*(k.tolist() for k in found.values())))
            assert kept[0] & kept[1]


def test_whole_sketches_are_fetched_for_near_pairs_only(spark, monkeypatch):
    held = {}
    real = ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name, **k: held.setdefault(name, []).append((df.columns, df.count())) or real(df, name, **k))
    rows = near_copies(10, bases=6, copies=6)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r["doc_id"]: r["group"] for r in ngram_join.linked_groups(docs, words=3, num=9, den=10).collect()} == {rows[i][0]: g for i, (_, g) in brute(rows, 3, 9, 10).items()}
    assert all("words" not in columns for columns, _ in held["sketches"])
    assert held["words"][0][1] <= held["sketches"][0][1]


def test_rows_go_in_slices_in_proportion_to_the_sets(spark, monkeypatch):
    """Pairs and bucket rows are joined with folds a slice at a time, and the groups are the same."""
    written = []
    real = ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name, **k: written.append(name) or real(df, name, **k))
    monkeypatch.setattr(ngram_join, "_SLICE_ROWS", 40)
    monkeypatch.setattr(ngram_join, "_ROWS_A_SKETCH", 0)
    rows = near_copies(11, bases=3, copies=16)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["group"] for r in ngram_join.linked_groups(docs, words=3, num=9, den=10).collect()}
    assert got == {rows[i][0]: g for i, (_, g) in brute(rows, 3, 9, 10).items()}
    assert written.count("left") > 1 and written.count("near") > 2
