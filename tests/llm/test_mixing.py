import random

from pyspark.sql import functions as F

from taxaspark.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int")


def some_rows():
    rng = random.Random(3)
    sources = ["a", "b", "ü", None, "hot", "tiny"]
    rows = [(i, rng.choice([*sources, "hot", "hot", "hot"]), "w " * rng.choice([0, 1, 5, 40, 700]), 1) for i in range(900)]
    return [*rows, (901, "a", None, 1), (902, "empty", None, 1), (None, "a", "x y", 1), (5, "hot", "same row", 1), (5, "hot", "same row", 1)]


def test_targets_and_words_taken(spark):
    rows = some_rows()
    docs = made(spark, rows)
    sized = mixing.sized(docs, "doc_id")
    got = mixing.sample_copies(sized, mixing.targets_of(sized)).collect()
    sizes = {}
    for _, source, text, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1400, source


def test_reruns_agree_and_columns_stay(spark):
    docs = made(spark, some_rows()).withColumn("row", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("size", F.lit("x"))
    first, second = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert first == second and len(first) > 900
    assert mixing.mix(docs).columns == docs.columns


def test_empty_table(spark):
    docs = made(spark, [])
    assert mixing.mix(docs).count() == 0
    sized = mixing.sized(docs, "doc_id")
    assert mixing.sample_copies(sized, mixing.targets_of(sized)).count() == 0


def test_only_empty_texts(spark):
    assert mixing.mix(made(spark, [(1, "a", None, 0), (2, None, "", 0)])).count() == 0


def test_the_sample_does_not_depend_on_partitions(spark):
    rows = [(i % 250, "w " * (i % 3 + 1), f"s{i % 2}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    told = {tuple(sorted(map(str, mixing.mix(docs.repartition(n)).collect()))) for n in (1, 3, 7)}
    assert len(told) == 1
