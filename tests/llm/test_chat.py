import random

from pyspark.sql import functions as F

from taxaspark.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\/INST]", "\\", "<", "[", "\n", "~", "~1", "é", "x y", ""]
SCHEMA = "conv_id int, turn int, role string, text string"


def conversations():
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool\n~<s>"]), "".join(rng.choices(PIECES, k=rng.randint(0, 6)))))
    return rows + [(100, None, None, None), (100, 0, "assistant", None), (None, 0, "user", "no id"), (101, 0, "assistant", "same"), (101, 0, "assistant", "same"), (102, 0, "user", "long " * 30000), (102, 1, "assistant", "yes")]


def test_round_trip_and_loss(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("target", F.lit(1)).withColumn("formatted", F.lit("x")).withColumn("c", F.lit(0)).repartition(4)
    got = chat.examples(turns).select("*", chat.parsed_turns(F.col("formatted")).alias("turns"), chat.trainable_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    want = {}
    for c, said in by.items():
        for i, (role, text) in enumerate(said, 1):
            if role == "assistant":
                want[c, i] = (said[:i], text)
            elif i == len(said):
                want[c, i] = (said, None)
    assert len(got) == len(want)
    for r in got:
        said, loss = want[r["conv_id"], r["target"]]
        assert [tuple(t) for t in r["turns"]] == said
        assert r["loss"] == loss
        assert r["last"] == (r["target"] == len(by[r["conv_id"]]))


def test_texts_hold_no_control_string(spark):
    df = spark.createDataFrame([("".join(random.Random(i).choices(PIECES, k=12)),) for i in range(300)], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e in df.collect():
        assert not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert df.where(chat.unescape(F.col("e")) != F.col("t")).count() == 0


def test_empty_table(spark):
    assert chat.examples(spark.createDataFrame([], SCHEMA)).count() == 0
