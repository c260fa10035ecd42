import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import RANKS, random_sequence, random_specimens, vector_rows
from taxaspark.functions.scores import alignment_confidence, neighbour_confidence
from taxaspark.operators import kmers, naive_bayes, nearest_neighbor, similarity

A, B = ("A a", "A", "FA", "OA"), ("B b", "B", "FB", "OB")
SEQ_ROW = "holdout_fraction double, split string, process_id string, species string, genus string, family string, `order` string, sequence string"


def sequence_rows(spark, rows):
    return spark.createDataFrame([(0.5, s, i, *t, q) for s, i, t, q in rows], SEQ_ROW)


# --- nearest neighbour ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def two_points(spark):
    train = [("train", "1", A, None, None, (0.0, 0.0)), ("train", "2", B, None, None, (10.0, 10.0))]
    return nearest_neighbor.fit(vector_rows(spark, train))


def nearest(spark, model, *vectors):
    queries = [("test", f"q{i}", (None,) * 4, None, None, v) for i, v in enumerate(vectors)]
    return nearest_neighbor.predict(model, vector_rows(spark, queries)).orderBy("process_id").collect()


def test_exact_match_and_closer_row(spark, two_points):
    same, other, far = nearest(spark, two_points, (0.0, 0.0), (9.9, 9.9), (1e6, -1e6))
    assert tuple(same[r] for r in RANKS) == A and same.nearest["species"] == "A a"
    assert same.confidence["species"] > 0.9
    assert other.species == "B b"
    assert far.species is not None and 0.0 <= far.confidence["order"] < same.confidence["order"]


def test_ties_go_to_the_smallest_id(spark):
    train = [("train", i, t, None, None, (1.0, 1.0)) for i, t in (("9", A), ("3", B), ("5", A))]
    (p,) = nearest(spark, nearest_neighbor.fit(vector_rows(spark, train)), (0.0, 0.0))
    assert p.nearest_id == "3" and p.species == "B b"


def test_scale_is_the_median_leave_one_out_distance(spark):
    rows = [r for r in random_specimens(80, seed=3) if r[0] == "train"]
    vec = np.array([r[5] for r in rows])
    d = np.linalg.norm(vec[:, None] - vec[None], axis=-1)
    np.fill_diagonal(d, np.inf)
    model = nearest_neighbor.fit(vector_rows(spark, rows))
    assert model.scales[0.5] == pytest.approx(np.median(d.min(axis=1)))
    one = nearest_neighbor.fit(vector_rows(spark, rows[:1]))
    assert one.scales[0.5] == 1.0
    twins = [("train", str(i), A, None, None, (1.0, 2.0)) for i in range(3)]
    assert nearest_neighbor.fit(vector_rows(spark, twins)).scales[0.5] == 1.0


def test_confidence_is_monotone(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "d double")
    a, b, c = (r[0] for r in df.select(neighbour_confidence(F.col("d"), F.lit(1.0))).collect())
    assert a == 1.0 and a > b > c


# --- naive Bayes -----------------------------------------------------------------------------------

NB_TRAIN = [
    ("train", "1", A, "ACGTACGTACGTACGTACGT"),
    ("train", "2", A, "ACGTACGTACGTACGTACGA"),
    ("train", "3", B, "TTTTGGGGCCCCTTTTGGGG"),
]


def bayes_by_hand(train, query, k):
    """log prior + sum of freq * log theta, from the definition."""
    words = kmers.kmer_alphabet(k)

    def freq(s):
        w = [s[i : i + k] for i in range(len(s) - k + 1)]
        w = [x for x in w if set(x) <= set("ACGT")]
        return np.array([w.count(x) / len(w) if w else 0.0 for x in words])

    species = sorted({t[2][0] for t in train})
    joint = []
    for s in species:
        rows = [freq(t[3]) for t in train if t[2][0] == s]
        total = np.sum(rows, axis=0)
        theta = np.log((total + 1.0) / (total.sum() + len(words)))
        joint.append(math.log(len(rows) / len(train)) + float(freq(query) @ theta))
    p = np.exp(np.array(joint) - max(joint))
    return dict(zip(species, p / p.sum()))


@pytest.mark.parametrize("query", ["ACGTACGTACGTACGTACGT", "TTTTGGGGCCCCTTTTGGGG", "A" * 20, "NN", ""])
def test_bayes_posterior(spark, query):
    train = kmers.kmer_vectors(sequence_rows(spark, NB_TRAIN), 2)
    model = naive_bayes.fit(train)
    asked = kmers.kmer_vectors(sequence_rows(spark, [("test", "q", (None,) * 4, query)]), 2)
    p = naive_bayes.predict(model, asked).first()
    want = bayes_by_hand(NB_TRAIN, query, 2)
    best = max(sorted(want), key=lambda s: want[s])
    assert p.species == best and p.confidence["species"] == pytest.approx(want[best])
    assert p.nearest["species"] == p.species
    c = [p.confidence[r] for r in RANKS]
    assert all(0.0 <= x <= 1.0 + 1e-12 for x in c)
    assert c == sorted(c)  # never falls towards the order
    assert (p.genus, p.family, p.order) == (A if best == "A a" else B)[1:]


# --- similarity search -----------------------------------------------------------------------------


def brute_segment(q, s, diag):
    """(score, length): the best run on one diagonal; earliest end, then shortest."""
    places = range(max(diag, 0), min(len(q), len(s) + diag))
    steps = [1 if q[i] == s[i - diag] and q[i] in "ACGT" else -2 for i in places]
    best = None
    for end in range(len(steps)):
        total = 0
        for start in range(end, -1, -1):
            total += steps[start]
            key = (-total, end, end - start)
            if best is None or key < best[0]:
                best = (key, total, end - start + 1)
    return best[1:]


def brute_hits(queries, subjects, word):
    out = {}
    for qid, q in queries:
        best = None
        for sid, s in subjects:
            valid = lambda w: set(w) <= set("ACGT")
            diags = {
                i - j
                for i in range(len(q) - word + 1)
                for j in range(len(s) - word + 1)
                if q[i : i + word] == s[j : j + word] and valid(q[i : i + word])
            }
            for d in diags:
                score, length = brute_segment(q, s, d)
                key = (-score, sid, length)
                best = key if best is None or key < best else best
        if best:
            out[qid] = (-best[0], best[1], best[2])
    return out


def related(seed, n, length=60):
    """Sequences in families: copies, mutated copies, shifted copies and a shared low-complexity run."""
    rng = np.random.default_rng(seed)
    parents = [random_sequence(seed * 100 + i, length) for i in range(3)]
    out = []
    for i in range(n):
        s = list(parents[i % 3])
        for at in rng.integers(0, len(s), size=int(rng.integers(0, 6))):
            s[at] = "ACGTN"[int(rng.integers(5))]
        text = "".join(s)[int(rng.integers(0, 8)) :]
        out.append(text + "A" * int(rng.integers(0, 14)) if i % 2 else text)
    return out


def test_best_segment_of_many_random_pairs():
    rng = np.random.default_rng(5)
    letters = np.array(list("ACGTN"))
    q = ["".join(rng.choice(letters, rng.integers(4, 25))) for _ in range(300)]
    s = ["".join(rng.choice(letters, rng.integers(4, 25))) for _ in range(300)]
    d = np.array([int(rng.integers(-len(b) + 2, len(a) - 1)) for a, b in zip(q, s)])
    score, length, matches = similarity.score_diagonals(q, s, d)
    for i in range(300):
        want = brute_segment(q[i], s[i], int(d[i]))
        if want[0] > 0:
            assert (score[i], length[i]) == want
            assert matches[i] == (2 * want[1] + want[0]) // 3


def test_best_scores_are_those_of_the_segments(monkeypatch):
    """Also where an overlap is longer than what is compared at a time, and pairs are more than are scored at a time."""
    monkeypatch.setattr(similarity, "_PAIRS", 64)
    monkeypatch.setattr(similarity, "_AHEAD", 16)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ACGTN"), rng.integers(1, 90), p=[0.5, 0.3, 0.1, 0.05, 0.05])) for _ in range(60)]
    q, s = rng.integers(0, 60, 500), rng.integers(0, 60, 500)
    d = np.array([int(rng.integers(-len(texts[b]) + 1, len(texts[a]))) for a, b in zip(q, s)])
    score, _, _ = similarity.score_diagonals([texts[i] for i in q], [texts[i] for i in s], d)
    assert similarity.best_scores(texts, texts, q, s, d).tolist() == np.maximum(score, 0).tolist()


def test_no_text_travels_with_a_pair(spark, monkeypatch):
    """A text comes to a tile of pairs once, however many diagonals its sequence has there; results do not change."""
    seen = []
    real = similarity.stage
    monkeypatch.setattr(similarity, "stage", lambda df, name, **k: seen.append((name, df.columns)) or real(df, name, **k))
    monkeypatch.setattr(similarity, "TILE_PAIRS", 50)
    queries = [("test", f"Q{i:02d}", B, s) for i, s in enumerate(related(1, 20) + ["AC" * 60, "CA" * 55 + "G"])]
    subjects = [("train", f"S{i:02d}", A, s) for i, s in enumerate(related(1, 16)[::-1] + ["AC" * 50 + "T", "GT" + "AC" * 40])]
    hits = similarity.best_hits(sequence_rows(spark, queries), sequence_rows(spark, subjects), 8).collect()
    assert {h.qseqid: (h.score, h.sseqid, h.length) for h in hits} == brute_hits([(i, s) for _, i, _, s in queries], [(i, s) for _, i, _, s in subjects], 8)
    pairs = [columns for name, columns in seen if name in ("first-pairs", "pairs")]
    assert pairs == [["q", "s", "diag", "mask", "floor"]] * 2


def test_words_of_one_sequence_alone_are_not_looked_up(spark, monkeypatch):
    """A sequence that is a query of one fraction and a subject of another shares no word with itself."""
    kept = {}
    real = similarity.stage

    def stage(df, name, **k):
        kept[name] = real(df, name, **k)
        return kept[name]

    monkeypatch.setattr(similarity, "stage", stage)
    a, b = random_sequence(3), random_sequence(4)
    rows = [(0.3, "X", a, "test"), (0.5, "X", a, "train"), (0.3, "Y", b, "train"), (0.5, "Y", b, "test")]
    df = spark.createDataFrame(rows, "holdout_fraction double, process_id string, sequence string, split string")
    assert similarity.best_hits(df.where("split = 'test'"), df.where("split = 'train'")).count() == 0
    assert kept["shared-words"].count() == 0


@pytest.mark.parametrize("hot_pairs", [similarity.HOT_PAIRS, 20, 0])
def test_search_equals_brute_force_on_both_paths(spark, hot_pairs, monkeypatch):
    """With no, some, and all shared words on the bounded-cell path."""
    monkeypatch.setattr(similarity, "HOT_BAND", 7)
    word = 8
    queries = [("test", f"Q{i:02d}", B, s) for i, s in enumerate(related(1, 30))]
    subjects = [("train", f"S{i:02d}", A, s) for i, s in enumerate(related(1, 24)[::-1] + related(1, 6))]
    hits = similarity.best_hits(sequence_rows(spark, queries), sequence_rows(spark, subjects), word, hot_pairs).collect()
    want = brute_hits([(i, s) for _, i, _, s in queries], [(i, s) for _, i, _, s in subjects], word)
    assert {h.qseqid: (h.score, h.sseqid, h.length) for h in hits} == want
    total = sum(len(s) for *_, s in subjects)
    for h in hits:
        bits = (1.33 * h.score - math.log(0.621)) / math.log(2)
        assert h.bitscore == pytest.approx(bits)
        size = len(next(s for _, i, _, s in queries if i == h.qseqid))
        assert h.evalue == pytest.approx(size * total * 2.0**-bits)


def test_identity_gate_has_three_outcomes(spark):
    train = sequence_rows(spark, [("train", "T1", A, random_sequence(1)), ("train", "T2", B, random_sequence(2))])
    worn = list(random_sequence(2))
    for at in range(3, 150, 31):
        worn[at] = "ACGT"[("ACGT".index(worn[at]) + 1) % 4]
    queries = sequence_rows(spark, [
        ("test", "same", A, random_sequence(1)), ("test", "worn", B, "".join(worn)), ("test", "none", A, random_sequence(99)),
    ])
    hits = similarity.significant(similarity.best_hits(queries, train), 1e-10)
    got = {r.process_id: r for r in similarity.calls(queries, hits, train, 97.0).collect()}
    assert got["same"].species == "A a" and 0 < got["same"].confidence["species"] <= 1 and got["same"].pident == 100.0
    assert got["worn"].species is None and got["worn"].nearest["species"] == "B b" and got["worn"].confidence["genus"] > 0
    assert got["none"].species is None and got["none"].nearest["species"] is None and got["none"].confidence["order"] == 0.0


def test_alignment_confidence(spark):
    # Bit scores and the confidences shown for them.
    shown = [(412.0, 0.892), (388.0, 0.886), (401.0, 0.889), (376.0, 0.883), (394.0, 0.887)]
    df = spark.createDataFrame([(b, None) for b, _ in shown] + [(None, 1e-20), (None, 1.0), (None, None), (float("nan"), None), (0.0, -1.0)], "b double, e double")
    got = [r[0] for r in df.select(alignment_confidence(F.col("b"), F.col("e"))).collect()]
    assert [round(x, 3) for x in got[:5]] == [c for _, c in shown]
    assert got[5] > got[6] > 0 and got[7:] == [0.0, 0.0, 0.0]
