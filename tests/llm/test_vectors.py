import numpy as np
from pyspark.sql import functions as F

from taxaspark.llm import embedding_dups, tree_search

SCHEMA = "vec_id long, embedding array<float>, label int"
BAD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1)]


def vectors(seed=1, n=400, copies=60):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    hot = base[0] + rng.standard_normal((copies, 16)) * 0.08
    near = base[rng.integers(0, n, copies)] * rng.uniform(0.5, 3, (copies, 1)) + rng.standard_normal((copies, 16)) * 0.1
    v = np.concatenate((base, hot, near, base[:5])).astype(np.float32)
    return [(i, x.tolist(), int(rng.integers(0, 3)) if i % 40 else None) for i, x in enumerate(v)]


def brute_links(rows, cosine=0.98):
    ok = [(k, np.array(v, dtype=float), y) for k, v, y in rows if y is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: set() for k, _, _ in rows}
    for i, (k, a, y) in enumerate(ok):
        for m, b, z in ok[:i]:
            if y == z and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[k].add(m)
                links[m].add(k)
    component = {}
    for k in sorted(links):
        if k not in component:
            todo = [k]
            while todo:
                if (x := todo.pop()) not in component:
                    component[x] = k
                    todo += links[x]
    return {k: (len(links[k]), component[k]) for k in links}


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("id", "grp", "query", "leaf", "score", "copies"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_links_equal_all_pairs(spark, monkeypatch):
    rows = vectors() + BAD
    rows = [(k, v, 1 if 400 <= k < 460 else y) for k, v, y in rows]  # a label with a large group of near copies
    want = brute_links(rows)
    for cell in (2048, 16):
        monkeypatch.setattr(embedding_dups, "CELL_ROWS", cell)
        got = {r["vec_id"]: (r["n_links"], r["component"]) for r in embedding_dups.near_duplicates(frame(spark, rows)).collect()}
        assert got.keys() == want.keys()
        assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
        assert all(got[k][0] <= want[k][0] for k in got)
        assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


def test_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (4, [0.0, 1.0], None)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component"], r["kept"]) for r in embedding_dups.near_duplicates(frame(spark, rows)).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("3", 0, 3, True), ("4", 0, 4, True), ("None", 0, None, True)]
    assert embedding_dups.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    assert tree_search.nearest(frame(spark, rows).limit(0), F.col("vec_id") == 1).count() == 0


def test_count_that_must_be_reached():
    window, least = embedding_dups.window_and_count(64, 0.98)
    assert 0.04 < window < 0.06 and 20 < least < 40


def test_nearest_recall_and_scores(spark, monkeypatch):
    rows = vectors(seed=5, n=1500) + BAD
    ok = {k: np.array(v, dtype=float) for k, v, _ in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    for cell in (8192, 50):
        monkeypatch.setattr(tree_search, "CELL_VECTORS", cell)
        monkeypatch.setattr(tree_search, "CELL_QUERIES", cell)
        got = {}
        for r in tree_search.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, fit_rows=800).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["vec_id"], r["score"]))
        hits = total = 0
        assert set(got) == {k for k in ok if k % 50 == 0}
        for q, found in got.items():
            exact = sorted((-(ok[q] @ v) / np.sqrt((ok[q] @ ok[q]) * (v @ v)), k) for k, v in ok.items() if k != q)
            found.sort()
            assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
            cosine = {k: -c for c, k in exact}
            assert all(abs(cosine[k] - s) < 1e-12 for _, k, s in found)
            assert all(a[2] >= b[2] for a, b in zip(found, found[1:], strict=False))
            hits += len({k for _, k, _ in found} & {k for _, k in exact[:5]})
            total += 5
        assert hits / total >= 0.9


def test_few_candidates_and_ties(spark):
    rows = [(0, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (5, [3.0, 0.0], None), (9, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    got = [tuple(r) for r in tree_search.nearest(frame(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 7, 1.0), (0, 3, 9, 0.0)]


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(i, [1.0, float(i % 5), 2.0], 1) for i in range(40)] + [(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 1), (52, [1.0] * 6, 1), (53, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dups.near_duplicates(df).collect()}
    assert len(got) == 44 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (50, 51, 52, 53)) and got[0]["n_links"] >= 7
    found = tree_search.nearest(df, F.col("vec_id") % 10 == 0).collect()
    assert {r["query"] for r in found} == {0, 10, 20, 30} and not {r["vec_id"] for r in found} & {50, 51, 52, 53}
