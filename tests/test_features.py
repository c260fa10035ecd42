import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import random_sequence
from taxaspark.functions.vectors import l2_normalise, squared_euclidean, triplet_hinge
from taxaspark.operators import conv
from taxaspark.operators import kmers as K
from taxaspark.operators.encoders import encoder_name, fit_encoder

SEQS = ["ACGTACGTACGTACGTACGTACGT", "TTTTACGTACGTACGTACGTACGT", "GGGGCCCCACGTACGTACGTACGT", "ACGTTTTTGGGGCCCCACGTACGT"]


def brute(seq, k):
    windows = [seq.upper()[i : i + k] for i in range(len(seq) - k + 1)]
    valid = Counter(w for w in windows if set(w) <= set("ACGT"))
    total = sum(valid.values())
    return {w: n / total for w, n in valid.items()}


def table(spark, seqs):
    return spark.createDataFrame([(f"P{i}", s) for i, s in enumerate(seqs)], "process_id string, sequence string")


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_frequencies_match_a_plain_count(spark, k):
    seqs = ["", "AC", "acgtNNNNacgt", "ACGT" * 5, "NNNN", random_sequence(3, 700), "ACG-TTÉGA"]
    long = {(r.process_id, r.kmer): r.freq for r in K.kmer_frequencies(table(spark, seqs), k, ["process_id"]).collect()}
    want = {(f"P{i}", w): f for i, s in enumerate(seqs) for w, f in brute(s, k).items()}
    assert long == pytest.approx(want)
    dense = {r.process_id: r.vec for r in K.kmer_vectors(table(spark, seqs), k).collect()}
    names = ["".join(p) for p in itertools.product("ACGT", repeat=k)]
    assert K.kmer_alphabet(k) == names
    for i, s in enumerate(seqs):
        assert dense[f"P{i}"] == pytest.approx([brute(s, k).get(n, 0.0) for n in names])


def test_tokens_are_every_valid_window_in_order(spark):
    seqs = ["ACGTNACG", "AC", "acgta"]
    got = Counter((r.process_id, r.kmer) for r in K.kmer_tokens(table(spark, seqs), 3, ["process_id"]).collect())
    assert got == Counter([("P0", "ACG"), ("P0", "CGT"), ("P0", "ACG"), ("P2", "ACG"), ("P2", "CGT"), ("P2", "GTA")])


def test_sparse_to_dense_in_sql(spark):
    freqs = K.kmer_frequencies(table(spark, SEQS), 2, ["process_id"])
    a = {r.process_id: r.vec for r in K.dense_from_long(freqs, 2, ["process_id"]).collect()}
    b = {r.process_id: r.vec for r in K.kmer_vectors(table(spark, SEQS), 2).collect()}
    assert a == b


def test_large_words_are_exact():
    text, letter, row = K.joined_letters(pa.array(["ACGT" * 10, "T" * 40]))
    at = K.valid_windows(letter, 28)
    code = K.window_codes(letter, at, 28)
    for place, value in zip(at, code):
        word = bytes(text[place : place + 28]).decode()
        assert value == int("".join(str("ACGT".index(c)) for c in word), 4)


def test_pca_keeps_distances_at_full_rank_and_caps_components(spark):
    df = table(spark, [random_sequence(i, 200) for i in range(12)])
    model = K.fit_kmer_pca(df, 2, 1000)
    assert model.dimensions == 12  # min(1000, rows, 4^2)
    full = K.fit_kmer_pca(table(spark, [random_sequence(i, 200) for i in range(40)]), 2, 16)
    vec = np.array([r.vec for r in full.transform(df).orderBy("process_id").collect()])
    raw = np.array([r.vec for r in K.kmer_vectors(df, 2).orderBy("process_id").collect()])
    d = lambda m: np.linalg.norm(m[:, None] - m[None], axis=-1)
    np.testing.assert_allclose(d(vec), d(raw), atol=1e-12)
    again = K.fit_kmer_pca(df, 2, 3).transform(df).orderBy("process_id").collect()
    assert [r.vec for r in again] == [r.vec for r in K.fit_kmer_pca(df, 2, 3).transform(df).orderBy("process_id").collect()]


def test_one_hot_marks_known_bases_in_place(spark):
    seqs = [random_sequence(i, 7 + i).replace("G", "N" if i % 2 else "G") for i in range(5)] + ["", "RYK"]
    for width in (4, 9):
        x = conv.one_hot(seqs, width)
        marked = {(i, int(c), int(p)) for i, c, p in zip(*np.nonzero(x), strict=True)}
        assert marked == {(i, "ACGT".index(b), p) for i, s in enumerate(seqs) for p, b in enumerate(s[:width]) if b in "ACGT"}
        rows = conv.one_hot_long(table(spark, seqs[2:3]), ["process_id"], width).collect()
        assert {(2, r.channel, r.pos) for r in rows} == {m for m in marked if m[0] == 2}


def loop_forward(w, seq, max_len):
    x = conv.one_hot([seq], max_len)[0]
    k = w.conv_w.shape[2]
    pooled = np.zeros(len(w.conv_w))
    for f in range(len(w.conv_w)):
        acts = [max(0.0, float((x[:, i : i + k] * w.conv_w[f]).sum() + w.conv_b[f])) for i in range(max_len - k + 1)]
        pooled[f] = np.mean(acts)
    pre = pooled @ w.dense_w + w.dense_b
    return pre / max(np.linalg.norm(pre), 1e-9)


def test_embedding_equals_a_direct_loop(spark):
    w = conv.initial_weights(4, 5, 6, 1)
    seqs = [random_sequence(i, 30 + 5 * i) for i in range(4)]
    got = conv.ConvModel(w, 48).transform(table(spark, seqs)).orderBy("process_id").collect()
    for r, s in zip(got, seqs):
        np.testing.assert_allclose(r.vec, loop_forward(w, s, 48), atol=1e-12)
        assert np.linalg.norm(r.vec) == pytest.approx(1.0)


def test_gradient_matches_finite_differences():
    w = conv.initial_weights(3, 3, 4, 2)
    a, p, n = ([random_sequence(10 * k + i, 20) for i in range(3)] for k in range(3))
    total, _ = conv.triplet_gradient(w, a, p, n, 16, 0.4)
    flat = w.flat()
    for at in range(0, flat.size, 7):
        step = np.zeros_like(flat)
        step[at] = 1e-6
        up = conv.triplet_gradient(w.like(flat + step), a, p, n, 16, 0.4)[1]
        down = conv.triplet_gradient(w.like(flat - step), a, p, n, 16, 0.4)[1]
        assert total[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_counted_windows_give_the_same_vectors_and_gradient(monkeypatch):
    w = conv.initial_weights(3, 4, 5, 2)
    texts = [random_sequence(i, 9 + 6 * i) for i in range(4)] + ["", "ACGTNNACGTxACg", "A"]
    d_emb = np.random.default_rng(1).normal(size=(len(texts), 5))
    w = w.like(w.flat() + 0.01)  # with biases
    emb, saved = conv.embed(w, texts, 24)
    plain, laid_out = conv.forward(w, conv.one_hot(texts, 24))
    np.testing.assert_allclose(emb, plain, atol=1e-12)
    np.testing.assert_allclose(conv.gradient(w, emb, saved, d_emb), conv.gradient(w, plain, laid_out, d_emb), atol=1e-12)
    monkeypatch.setattr(conv, "_TABLE", 0)
    assert len(conv.embed(w, texts, 24)[1]) == 4


def families(spark, copies=5, length=70):
    """Species that differ in base composition; each row is a fresh draw."""
    rng = np.random.default_rng(13)
    rows = []
    for species, share in (("x", [0.55, 0.15, 0.15, 0.15]), ("y", [0.1, 0.1, 0.2, 0.6]), ("z", [0.1, 0.5, 0.3, 0.1])):
        rows += [(f"{species}{i}", species, "".join(rng.choice(list("ACGT"), length + i, p=share))) for i in range(copies)]
    return spark.createDataFrame(rows, "process_id string, species string, sequence string")


SHAPE = {"embedding_dim": 6, "n_filters": 5, "kernel_size": 4, "learning_rate": 0.2, "margin": 0.5, "seed": 3}


def test_training_does_not_depend_on_partitions_and_lowers_the_loss(spark):
    df = families(spark)
    a, b = conv.fit_conv(df, epochs=12, batch_size=15, **SHAPE), conv.fit_conv(df.repartition(4), epochs=12, batch_size=15, **SHAPE)
    np.testing.assert_allclose(a.weights.flat(), b.weights.flat(), atol=1e-12)
    assert np.mean(a.losses[-4:]) < np.mean(a.losses[:4])
    assert a.dimensions == 6 and a.max_len == 74 and len(a.losses) == 12


def test_updates_follow_the_gradient_of_each_step(spark):
    df = families(spark)
    model = conv.fit_conv(df, epochs=2, batch_size=8, **SHAPE)
    seqs = {r.process_id: r.sequence for r in df.collect()}
    mined = sorted(conv.mine_triplets(df.select("process_id", "species"), 32, 3).collect(), key=lambda r: r.triplet)
    w = conv.initial_weights(5, 4, 6, 3)
    for at in range(0, 32, 8):
        g, loss = conv.triplet_gradient(w, *[[seqs[r[s]] for r in mined[at : at + 8]] for s in ("anchor", "positive", "negative")], 74, 0.5)
        assert model.losses[at // 8] == pytest.approx(loss / 8)
        w = w.like(w.flat() - 0.2 * g / 8)
    np.testing.assert_allclose(model.weights.flat(), w.flat(), atol=1e-9)


@pytest.mark.parametrize("chars", [1, 4000, 1 << 24])
def test_small_steps_share_jobs(spark, monkeypatch, chars):
    """Not a job per step; whatever a job holds, the steps are the same."""
    df, jobs = families(spark), []
    descend = conv._descend
    monkeypatch.setattr(conv, "_JOB_CHARS", chars)
    monkeypatch.setattr(conv, "_descend", lambda *a: jobs.append(1) or descend(*a))
    model = conv.fit_conv(df, epochs=3, batch_size=4, **SHAPE)
    monkeypatch.setattr(conv, "_BATCH", 3)  # too large for one task: a job per step
    alone = conv.fit_conv(df, epochs=3, batch_size=4, **SHAPE)
    assert len(jobs) == {1: 12, 4000: 3, 1 << 24: 1}[chars] and len(model.losses) == 12
    np.testing.assert_allclose(model.losses, alone.losses, atol=1e-9)
    np.testing.assert_allclose(model.weights.flat(), alone.weights.flat(), atol=1e-9)


def test_defaults_read_whole_sequences_in_several_updates(spark):
    df = families(spark, copies=30)
    model = conv.fit_conv(df, epochs=1, **SHAPE)
    assert model.max_len == 99 and len(model.losses) == 3  # 90 rows in steps of 32
    with pytest.raises(ValueError):
        conv.fit_conv(df, epochs=0, **SHAPE)
    with pytest.raises(ValueError):
        conv.fit_conv(df, **(SHAPE | {"kernel_size": 200}))


def test_triplets_follow_the_rules(spark):
    rows = [(f"{s}{i}", s) for s, n in (("a", 5), ("b", 1), ("c", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "process_id string, species string")
    mined = conv.mine_triplets(df, 600, 3).collect()
    assert len(mined) == 600
    for r in mined:
        assert r.anchor != r.positive and r.anchor[0] == r.positive[0] != r.negative[0]
    assert {r.anchor[0] for r in mined} == {"a", "c"}  # one row cannot anchor
    share = Counter(r.anchor[0] for r in mined)
    assert 0.4 < share["a"] / 600 < 0.6  # uniform over species, not rows
    with pytest.raises(ValueError):
        conv.mine_triplets(df.where("species = 'b'"), 5, 3)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [3.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    row = df.select(
        squared_euclidean(F.col("a"), F.col("b")).alias("d"), l2_normalise(F.col("a")).alias("u"), l2_normalise(F.col("b")).alias("z"),
        triplet_hinge(F.col("a"), F.col("b"), F.col("c"), 0.5).alias("h"),
    ).first()
    assert row.d == 25.0 and row.u == [0.6, 0.8] and row.z == [0.0, 0.0] and row.h == 9.5


def test_encoder_names(spark):
    assert encoder_name(" CNN ") == "conv_triplet" and encoder_name("pca") == "kmer_pca"
    with pytest.raises(ValueError, match="unknown encoder"):
        fit_encoder("not_a_real_encoder", None)


def test_a_step_counts_its_three_sides_in_one_reused_array(monkeypatch):
    """Whatever was counted in it before; windows are counted a few sequences at a time."""
    monkeypatch.setattr(conv, "_COUNTED", 2)
    w = conv.initial_weights(3, 4, 5, 2)
    texts = [random_sequence(i, 3 + 7 * i) for i in range(6)] + ["", None, "é" * 9, "ACGTNNACGTxACg" * 3, "A", "T" * 24]
    space, calls, real = conv.Space(), [], conv.embed
    monkeypatch.setattr(conv, "embed", lambda w, s, *a: calls.append(len(s)) or real(w, s, *a))
    for sides in ((texts[:4], texts[4:8], texts[8:]), (texts[3:5], texts[:2], texts[9:11])):
        got = conv.triplet_gradient(w, *sides, 24, 0.4, space)
        x, y, z = (conv.forward(w, conv.one_hot(s, 24)) for s in sides)
        to_p, to_n = x[0] - y[0], x[0] - z[0]
        hinge = (to_p**2).sum(axis=1) - (to_n**2).sum(axis=1) + 0.4
        on = (hinge > 0)[:, None]
        want = sum(conv.gradient(w, *side, d * on) for side, d in ((x, 2 * to_p - 2 * to_n), (y, -2 * to_p), (z, 2 * to_n)))
        np.testing.assert_allclose(got[0], want, atol=1e-10)
        assert got[1] == pytest.approx(np.maximum(hinge, 0).sum())
    assert calls == [12, 6]
    for sequence in texts:
        counts, ones = conv.window_counts([sequence], 24, 4)
        plain = conv._patches(conv.one_hot([sequence], 24), 4)[0]
        assert counts.sum() == len(plain) and (counts @ ones == plain.sum(axis=0)).all()


def test_a_job_takes_hundreds_of_steps():
    assert conv._JOB_CHARS // (3 * 800 * 128) >= 400
