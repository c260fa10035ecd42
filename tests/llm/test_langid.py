import os

import pytest
from pyspark.sql import functions as F

from taxaspark.llm import langid

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id int, text string, lang string"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs, ~held)
    got = docs.where(held).select("lang", langid.predict(model, "text").alias("p")).select("lang", F.col("p.lang").alias("said"), "p.score").collect()
    right = [r["lang"] == r["said"] for r in got]
    assert sum(right) / len(right) > 0.97
    assert abs(sum(r["score"] for r in got) / len(got) - sum(right) / len(right)) < 0.05


def small(spark):
    rows = [(i, ("the cat sat on a mat " if i % 2 else "der hund und die katze ") * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    return spark.createDataFrame(rows + [(None, "the", "en"), (70, None, "en"), (71, "12 34", "de"), (72, "x", None)], SCHEMA)


def test_rows_of_all_sorts(spark):
    docs = small(spark).withColumn("score", F.lit(1)).withColumn("y", F.lit(2))
    model = langid.fit(docs, F.lit(True))
    ask = spark.createDataFrame([(1, None, "de"), (2, "", None), (3, "12 !!", "en"), (4, "THE CAT", "de"), (5, "und die Katze " * 20000, None), (6, "the cat", None)], SCHEMA)
    got = {r["doc_id"]: r["p"] for r in ask.select("doc_id", langid.predict(model, "text").alias("p")).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang"] == "en" and got[5]["lang"] == "de"
    assert got[4] == got[6] and all(0 <= p["score"] <= 1 for p in got.values())


def test_labels_of_rows_left_out_do_not_matter(spark):
    docs = small(spark)
    train = F.col("doc_id") % 5 != 0
    other = docs.withColumn("lang", F.when(train, F.col("lang")).otherwise("zz")).withColumn("text", F.when(train, F.col("text")).otherwise("zzz"))
    a, b = langid.fit(docs, train), langid.fit(other, train)
    assert a.languages == b.languages == ("de", "en") and (a.weights == b.weights).all() and (a.idf == b.idf).all()


def test_nothing_to_learn_from(spark):
    docs = small(spark)
    model = langid.fit(docs.limit(0), F.lit(True))
    assert {r["p"]["lang"] for r in docs.select(langid.predict(model, "text").alias("p")).collect()} == {"und"}
    assert docs.limit(0).select(langid.predict(model, "text")).count() == 0


def test_temperature_lowers_the_loss_of_overconfident_logits():
    import numpy as np

    p = langid.softmax(np.array([[10.0, 0.0], [1.0, 1.0]]))
    assert p[0, 0] > 0.999 and p[1, 0] == 0.5
