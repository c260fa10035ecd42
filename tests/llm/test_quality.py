import math
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taxaspark.llm import quality

FOLDER = "/root/testdata/sf0.01"
GOOD = ["the cat sat on the mat.", "a dog ran to the house, and the cat sat.", "on the mat a dog sat.", "the house, the mat.", "Dogs and cats ran."]
OTHER = ["XQZ!! the cat", "the mat", "zzz zzz", "é ñ 12"]


def brute(texts):
    """Interpolated modified Kneser-Ney over character classes, by dictionaries."""
    counts = {quality.ORDER: Counter()}
    for t in texts:
        classes = (0,) * (quality.ORDER - 1) + tuple(quality.char_class(c) for c in t)
        for i in range(len(t)):
            counts[quality.ORDER][classes[i : i + quality.ORDER]] += 1
    for order in range(quality.ORDER - 1, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    discount, contexts = {}, {}
    for order, found in counts.items():
        n = Counter(found.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(k, max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)]
        discount[order] = lambda c, d=d: d[min(c, 3) - 1] if c else 0.0
        contexts[order] = defaultdict(list)
        for g, c in found.items():
            contexts[order][g[:-1]].append(c)

    def p(gram):
        order = len(gram)
        if not order:
            return 1 / quality.CLASSES
        lower, seen = p(gram[1:]), contexts[order].get(gram[:-1])
        if not seen:
            return lower
        c, total = counts[order][gram], sum(seen)
        return (c - discount[order](c)) / total + sum(map(discount[order], seen)) / total * lower

    return p


def test_scores_equal_a_brute_force_model(spark):
    docs = spark.createDataFrame([(t, True) for t in GOOD] + [(t, False) for t in OTHER], "text string, fit boolean").repartition(3)
    got = {r["gram"]: r["logp"] for r in quality.gram_scores(quality.corpus_grams(docs)).collect()}
    p, expected = brute(GOOD), {}
    for t in GOOD + OTHER:
        classes = (0,) * (quality.ORDER - 1) + tuple(quality.char_class(c) for c in t)
        for i in range(len(t)):
            g = classes[i : i + quality.ORDER]
            expected[sum(c << 6 * (quality.ORDER - 1 - k) for k, c in enumerate(g))] = math.log(p(g))
    assert set(got) == set(expected)
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-9


def test_probabilities_of_a_context_sum_to_one():
    p = brute(GOOD)
    context = tuple(quality.char_class(c) for c in "the")
    assert abs(sum(p((*context, c)) for c in range(quality.CLASSES)) - 1) < 1e-9


def test_classes_fit():
    assert {quality.char_class(chr(c)) for c in range(0x3000)} <= set(range(1, quality.CLASSES))
    assert list(quality.gram_codes("")) == []


def labelled(spark):
    rows = [(i, GOOD[i % len(GOOD)] * (1 + i % 4), "en" if i % 3 else None) for i in range(200)]
    bad = [(1000, "#$ QX" * 80, "en"), (1001, None, "en"), (1002, "", None), (1003, "ZZ!! " * 100, "xx"), (None, GOOD[0], "en"), (3, "again " * 30, "en")]
    docs = spark.createDataFrame(rows + bad, "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000, 0, 0), (None, 1, 0), (1, 1, 0), (2, None, None)], "doc_id int, quality int, toxic int")
    return docs, labels


def test_rows_of_all_sorts(spark):
    docs, labels = labelled(spark)
    docs = docs.withColumn("score", F.lit("s")).withColumn("fit", F.lit("f")).withColumn("doc", F.lit(1))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(200)) <= set(ids) and None in ids and not {1000, 1001, 1002, 1003} & set(ids)


def test_without_trusted_rows_every_text_stays(spark):
    docs, labels = labelled(spark)
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.where("length(text) > 0").count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_fit_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    chosen = quality.chosen_rows(labels, "doc_id", F.col("quality") == 1, 300, 100)
    n = {r["fit"]: r["count"] for r in chosen.groupBy("fit").count().collect()}
    assert 230 < n[True] < 370 and 60 < n[False] < 140


def test_model_and_thresholds_come_from_all_trusted_rows(spark, monkeypatch):
    labels = spark.range(100_000).select((F.col("id") % 99_000).alias("doc_id"), F.lit(1).alias("quality"))
    docs = spark.createDataFrame([(1, GOOD[0], "en")], "doc_id long, text string, lang string")
    staged, stage = {}, quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    quality.judge(docs, labels)
    n = {r["fit"]: r["count"] for r in staged["trusted"].groupBy("fit").count().collect()}
    assert sum(n.values()) == 99_000 and abs(n[True] - 74_250) < 1000


def test_many_trusted_rows_are_joined_in_a_shuffle(spark, monkeypatch):
    docs, labels = labelled(spark)
    told = lambda: sorted(map(repr, quality.judged(docs, labels).select("doc", "log_perplexity", "threshold", "keep").collect()))
    by_broadcast = told()
    monkeypatch.setattr(quality, "fits_broadcast", lambda *_: False)
    assert told() == by_broadcast and len(by_broadcast) == docs.count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_junk_goes_and_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    score, threshold = quality.judge(docs, labels)
    got = docs.select("doc_id", (score <= threshold).alias("keep")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in got.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.2


def junk_kind(text):
    words = text.split()
    if sum(a == b for a, b in zip(words, words[1:], strict=False)) > 0.3 * len(words):
        return "repeats"
    return "bars" if text.count(" | ") > 0.2 * len(words) else "other"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_every_kind_of_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs, labels).select("doc.doc_id", "doc.text", "keep").join(labels, "doc_id").where("text is not null").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    assert sum(good) >= 0.985 * len(good)
    kinds = defaultdict(list)
    for r in got:
        if r["quality"] == 0:
            kinds[junk_kind(r["text"])].append(r["keep"])
    assert len(kinds["repeats"]) > 100 and all(sum(kept) < 0.06 * len(kept) for kept in kinds.values()), {k: (sum(v), len(v)) for k, v in kinds.items()}


@pytest.mark.parametrize("most", [0, 6, 1000])
def test_word_costs_equal_a_brute_force_model(spark, monkeypatch, most):
    from taxaspark.llm import word_model as M

    monkeypatch.setattr(M, "HEAD", most)

    fit = [("a b a c",), ("b a d",), ("a b",), ("c a b d d",)]
    texts = ["a b a c", "x a b", "x a b", "d d d d", "b\ty  a"]
    weights, unseen, ends = M.model(spark.createDataFrame(fit, "text string").repartition(2))
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    head, tail = M.split_head(weights)
    assert len(head.value[0]) <= most and (most < 1000 or tail.count() == 0)
    costs = docs.select("text", M.text_key(F.col("text")).alias("key")).join(M.tail_costs(docs, head, tail), "key", "left").select("text", "tail", M.size_and_repeats(F.col("text"), head).alias("s"))
    pairs = Counter(p for (t,) in fit for w in [["<", *t.split(), ">"]] for p in zip(w, w[1:], strict=False))
    ones = Counter(w for _, w in pairs)

    def off(found):
        n = Counter(found.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(k, max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    d2, d1 = off(pairs), off(ones)

    def p(u, w):
        low = (ones[w] - d1(ones[w])) / len(pairs) + max(sum(map(d1, ones.values())) / len(pairs), 1e-9) / (len(ones) + 1)
        after = [c for (a, _), c in pairs.items() if a == u]
        return (pairs[u, w] - d2(pairs[u, w])) / sum(after) + max(sum(map(d2, after)) / sum(after), 1e-9) * low if after else low

    for r in costs.where("length(text) > 0").collect():
        w = ["<", *r["text"].split(), ">"]
        want = -sum(math.log(p(*g)) for g in zip(w, w[1:], strict=False))
        assert r["s"]["words"] * unseen + r["s"]["head"] + (r["tail"] or 0.0) + ends == pytest.approx(want), r
        assert r["s"]["repeats"] == pytest.approx(sum(n * math.log(n) for n in Counter(zip(w, w[1:], strict=False)).values()))


def test_every_pair_is_counted_in_one_slice(spark):
    from taxaspark.llm import word_model as M

    texts = [("a b a c",), (None,), ("",), ("c a b d d e f g",), ("a b",)]
    docs = spark.createDataFrame(texts, "text string").repartition(2)
    parts = [{(r["u"], r["w"]): r["n"] for r in M.pair_counts(docs, part).collect()} for part in range(M.SLICES)]
    want = Counter(p for (t,) in texts if t for w in [["<", *t.split(), ">"]] for p in zip(w, w[1:], strict=False))
    assert sum(map(len, parts)) == len(set().union(*parts)) == len(want) and sum(map(len, parts)) > max(map(len, parts))
    assert sorted(n for part in parts for n in part.values()) == sorted(want.values())


@pytest.mark.parametrize("small", [True, False])
def test_slices_do_not_change_word_scores(spark, monkeypatch, small):
    from taxaspark.llm import word_model as M

    docs, labels = labelled(spark)
    monkeypatch.setattr(M, "HEAD", 5)
    told = lambda: {(str(r["doc"]["doc_id"]), r["doc"]["text"]): r for r in quality.judged(docs, labels).select("doc", "word_score", "word_threshold", "keep").collect()}
    sliced = told()
    monkeypatch.setattr(M, "SLICES", 1)
    monkeypatch.setattr(quality, "fits_broadcast", lambda *_: small)
    whole = told()
    assert sliced.keys() == whole.keys()
    for k, r in sliced.items():
        assert r["keep"] == whole[k]["keep"] and r["word_score"] == pytest.approx(whole[k]["word_score"]) and r["word_threshold"] == pytest.approx(whole[k]["word_threshold"])


def test_only_what_is_read_goes_through_the_join_with_costs(spark):
    docs, labels = labelled(spark)
    plan = quality.judged(docs, labels).select("doc.doc_id", "keep")._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter") :].splitlines()[1]
    assert "Project" in join and "of_0" in join and "of_1" not in join
