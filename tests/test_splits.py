import hashlib
from collections import Counter

import pytest

from taxaspark.operators import splits as P


def corpus(spark, genera=10, species=3, rows=4):
    data = [
        (f"P{g}_{s}_{r}", f"G{g} s{s}", f"G{g}", f"F{g % 3}", "O") for g in range(genera) for s in range(species) for r in range(rows)
    ]
    return spark.createDataFrame(data, "process_id string, species string, genus string, family string, `order` string")


def roles(df):
    return {r.process_id: r.role for r in df.collect()}


def test_fraction_of_genera_is_held_out(spark):
    assert P.held_out_genera(corpus(spark), (0.3,)).count() == 3
    assert P.held_out_genera(corpus(spark, genera=5), (0.3, 0.5, 0.7)).groupBy("holdout_fraction").count().orderBy(
        "holdout_fraction"
    ).collect() == [(0.3, 2), (0.5, 2), (0.7, 4)]  # 1.5, 2.5 and 3.5 round half to even


def test_same_seed_same_split_and_other_seed_other_genera(spark):
    df = corpus(spark)
    assert roles(P.make_splits(df, (0.3,))) == roles(P.make_splits(df.repartition(7), (0.3,)))
    a = {r.genus for r in P.held_out_genera(df, (0.3,), seed=1).collect()}
    b = {r.genus for r in P.held_out_genera(df, (0.3,), seed=2).collect()}
    assert a != b


def test_roles_partition_the_rows(spark):
    df = corpus(spark)
    held = {r.genus for r in P.held_out_genera(df, (0.5,), seed=7).collect()}
    got = roles(P.make_splits(df, (0.5,), seed=7, val_fraction=0.5))
    rows = {r.process_id: r for r in df.collect()}
    assert set(got) == set(rows)
    assert {i for i, r in got.items() if r == "test"} == {i for i, r in rows.items() if r.genus in held}
    val = Counter(rows[i].species for i, r in got.items() if r == "val")
    assert set(val.values()) == {2}  # floor(4 * 0.5) of every seen species


def test_single_row_species_stay_in_train(spark):
    got = roles(P.make_splits(corpus(spark, 4, 2, 1), (0.25,), val_fraction=0.5))
    assert "val" not in got.values()


def test_other_unit_raises(spark):
    with pytest.raises(NotImplementedError):
        P.make_splits(corpus(spark, 4), (0.3,), unit="family")


def test_random_split_is_exact_and_in_hash_order(spark):
    df = corpus(spark)
    got = roles(P.random_split(df, 0.15))
    order = sorted(got, key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert {i for i, r in got.items() if r == "val"} == set(order[:18])  # ceil(120 * 0.15)


def test_hash_rank_matches_a_plain_sort_in_a_hot_group(spark):
    ids = [f"K{i}" for i in range(5000)]
    df = spark.createDataFrame([(("hot" if i % 3 else f"c{i}"), v) for i, v in enumerate(ids)], "g string, id string")
    ranked = P.hash_rank(df, ["g"], 5, ["id"], "no").where("g = 'hot'").collect()
    hot = [v for i, v in enumerate(ids) if i % 3]
    want = {v: n for n, v in enumerate(sorted(hot, key=lambda v: hashlib.md5(f"5|{v}".encode()).hexdigest()))}
    assert {r.id: r.no for r in ranked} == want
    assert {r.no_of for r in ranked} == {len(hot)}


def test_unknown_id_raises(spark):
    df = corpus(spark, 2, 1, 1)
    ids = spark.createDataFrame([("nope",)], "process_id string")
    with pytest.raises(KeyError):
        P.rows_by_id(df, ids, check=True)


def test_subsets_are_bags(spark):
    df = spark.createDataFrame([("a", "val"), ("b", "test"), ("c", "train")], "process_id string, split string")
    got = sorted((r.process_id, r.subset) for r in P.evaluation_subsets(df).collect())
    assert got == [("a", "all"), ("b", "all"), ("b", "novel")]
