import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxaspark.llm import queries, token_alignment

JSON = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
A = Tokenizer.from_str(JSON)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def tokens(text):
    """((id, start, end) of A, of B), written from the contract."""
    if not text:
        return [], []
    both = []
    of_a = [(i, bytes(BYTE_OF[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    of_b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        of_b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
    for side in (of_a, of_b):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, placed = 0, []
        for i, x in side:
            placed.append((i, at, at + len(x)))
            at += len(x)
        both.append(placed)
    return both


def brute(rows):
    links, out = {}, []
    for n, (_, text) in enumerate(rows):
        a, b = tokens(text)
        links[n] = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]] if len(a) < 400 else [(x[0], {y[2]: y[0] for y in b}[x[2]]) for x in a if x[2] in {y[2] for y in b}]
    counts = Counter(p for found in links.values() for p in found)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for n, (key, text) in enumerate(rows):
        a, b = tokens(text)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x[0]) for x in side if low < x[2] <= cut) for side in (a, b)))
            low = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((key, len(a), len(b), len(cuts), len(links[n]), sum(counts[p] == most[p[1]] for p in links[n]), sum(counts[p] for p in links[n]), digest))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(3)
    words = ["the", "The", "naïve", "Straße", "don't", "1234567", "漢字", "👍🏽", "<|endoftext|>", "</s>", "<s>", "xx", "Être,", "(a)", "▁", "<0x41>", "  ", "\n", "\t", " ", "ﬁ", "i̇", "\x00", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(120)]
    rows += [(i, " ".join(rng.choices(["the", "cat", "sat", "Xylophon", "on", "Matten"], k=rng.randint(1, 40)))) for i in range(200, 260)]
    return rows + [(1000, None), (1001, ""), (None, "null key"), (1002, " "), (1003, "same row"), (1003, "same row"), (1004, "a" * 300)]


def score(spark, rows, partitions):
    docs = spark.createDataFrame(rows, "doc_id int, text string").select(*[F.lit(1).alias(c) for c in ("pairs", "times", "groups", "a_ids", "id", "doc")], "*").repartition(partitions)
    made = token_alignment.align(docs, JSON, public_tokenizers.PATTERN, queries.piece_model(), with_overlaps=False)
    made = made.select("doc_id", F.size("a_ids").alias("n_a"), F.size("b_ids").alias("n_b"), "n_groups", F.when(F.size("a_ids") > 0, F.sha2("groups", 256)).otherwise("").alias("digest"), "pairs", "times")
    got = token_alignment.with_link_scores(made).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest").collect()
    return sorted([tuple(r) for r in got], key=repr)


@pytest.mark.parametrize("hot_share", [token_alignment.HOT_SHARE, 0.02, 2.0])
def test_against_the_definition(spark, monkeypatch, hot_share):
    """With few or no pairs taken as hot, the others come through the join."""
    monkeypatch.setattr(token_alignment, "HOT_SHARE", hot_share)
    rows = fixture()
    assert sum(1 for _, t in rows if tokens(t)[0]) > 60 and any(t and not tokens(t)[0] for _, t in rows)
    assert score(spark, rows, 3) == brute(rows)


def test_slices_and_partitions_change_nothing(spark, monkeypatch):
    rows = fixture()
    want = score(spark, rows, 1)
    monkeypatch.setattr(token_alignment, "SLICE_CHARS", 50)
    monkeypatch.setattr(token_alignment, "COUNTED_PAIRS", 3)
    assert score(spark, rows, 5) == want


def test_overlaps_are_all_pairs_that_share_a_byte(spark):
    rows = [r for r in fixture() if r[1]]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    made = token_alignment.align(docs, JSON, public_tokenizers.PATTERN, queries.piece_model()).collect()
    for r, (_, text) in zip(sorted(made, key=lambda r: repr(r["doc_id"])), sorted(rows, key=lambda r: repr(r[0])), strict=True):
        a, b = tokens(text)
        assert r["a_ids"] == [x[0] for x in a] and r["b_ids"] == [y[0] for y in b]
        want = [(i, j, x[2] == y[2]) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        assert list(zip(r["overlap_a"], r["overlap_b"], r["ends_together"], strict=True)) == want


def test_overlaps_of_random_cuts():
    rng = np.random.default_rng(5)
    for _ in range(30):
        frames = []
        for _ in range(2):
            cuts = [np.unique(np.concatenate([[0, 50], rng.integers(0, 50, rng.integers(0, 30))])) + 50 * d for d in range(4)]
            frames.append(pd.concat([pd.DataFrame({"doc": d, "start": c[:-1], "end": c[1:]}) for d, c in enumerate(cuts)], ignore_index=True))
        a, b = frames
        want = [(i, j) for i, x in a.iterrows() for j, y in b.iterrows() if x.start < y.end and y.start < x.end]
        assert list(zip(*map(list, token_alignment.overlaps(a, b)), strict=True)) == want


def test_both_libraries_read_the_bytes_alike():
    rng = random.Random(9)
    encode = token_alignment.ByteTokens(JSON, public_tokenizers.PATTERN)
    assert encode._fast is not None
    signs = [*"aAé \n\t'’12.<|>  漢👍\x00\x85", " the", "'s", "'LL", "<|endoftext|>", "   "]
    for _ in range(3000):
        text = " " + "".join(rng.choices(signs, k=rng.randint(0, 20)))
        assert encode(text) == A.encode(text, add_special_tokens=False).ids, repr(text)


def test_very_long_texts_and_no_rows(spark):
    rows = [(1, "word " * 60000 + "end"), (2, " " * 200_000), (3, "x" * 50_000), (4, "1" * 50_000)]
    got = {r[0]: r for r in score(spark, rows, 2)}
    assert got[1][1] == len(A.encode(" " + rows[0][1], add_special_tokens=False).ids)
    assert all(got[k][4] == got[k][3] for k in got)
    assert score(spark, [], 1) == []
    assert score(spark, [(1, None), (2, "")], 1) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
