import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from taxaspark.llm import packing

TOKENIZER = Tokenizer.from_str(corpus_pipeline.tokenizer_json())


def ids_of(text):
    return np.asarray([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()


def test_words_give_the_ids_of_the_text():
    rng = random.Random(5)
    signs = [*"aAbBéÉßÿÀ×÷µªº \n\t'’ΣσİßIKÅﬀ́​\x1c\x85\xa0<|>12.!?:;=@[`{~_-👍🏽 　", "<|endoftext|>", " <|ENDOFTEXT|>", "'s", "'ll", "\r\n", " it's."]
    encode = packing.WordEncoder(corpus_pipeline.tokenizer_json())
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 14)))
        assert encode(text) == ids_of(text)[:-4], repr(text)


def test_cut_points():
    for n in [1, 2, 31, 4095, 4096, 4097, 9000]:
        pieces = packing.cut_points(n, 4096)
        assert [s for s, _ in pieces] == list(np.cumsum([0, *[length for _, length in pieces]])[:-1])
        assert sum(length for _, length in pieces) == n and all(4096 % length == 0 for _, length in pieces)


@pytest.mark.parametrize("partitions", [1, 3])
def test_every_id_lies_in_one_piece_without_padding(spark, partitions):
    rng = random.Random(1)
    words = ["alpha", "Beta,", "gämma!", "x" * 40, "12.5", "ok."]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 7, 90, 3000])))) for i in range(60)] + [(100, None), (None, "null key"), (101, "word " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(partitions)
    pieces = packing.pack(docs, corpus_pipeline.tokenizer_json()).collect()
    whole = {k: ids_of(t) for k, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(whole)
    for k, parts in by_doc.items():
        parts.sort(key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in parts) == whole[k]
        assert {p["doc_tokens"] for p in parts} == {len(whole[k]) // 4}
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0


def test_checksum_empty_table_and_bad_capacity(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    row = packing.pack(docs, corpus_pipeline.tokenizer_json()).select(F.crc32("ids").alias("c"), "ids").collect()
    assert all(r["c"] == zlib.crc32(bytes(r["ids"])) for r in row)
    assert packing.pack(docs.limit(0), corpus_pipeline.tokenizer_json()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, corpus_pipeline.tokenizer_json(), capacity=1000)


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3, "doc_id int, text string")
    got = packing.pack(docs, corpus_pipeline.tokenizer_json()).agg(F.sum("length")).first()[0]
    assert got == 3 * len(ids_of("a b c")) // 4
