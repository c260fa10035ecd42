"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text: of characters and of words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm import word_model
from taxaspark.session import fits_broadcast, stage, unstage

ORDER = 4
_BITS = 6
CLASSES = 1 << _BITS
GRAMS = CLASSES**ORDER
#: Target: of held-out trusted rows each score may reject half a hundredth per language, both together one hundredth.
QUANTILE = 0.995
MARGIN = 0.0
#: So many characters at the language's median are added to every text, since few characters tell little.
PRIOR_CHARS = 200
#: The same for the score by words.
PRIOR_WORDS = 20
#: Of all trusted rows, one in so many is kept out of each model, for its thresholds.
HELD_OUT = 4
# Of a trusted row's key in a broadcast table.
_KEY_BYTES = 32
# Scores travel as whole thousandths of a nat.
_UNIT = 1000.0
_CHUNK_CHARS = 4_000_000

# Character classes: 0 stands before a text, then blank, other white space, digit, any capital, a-z, frequent signs
# on their own, further signs and further letters spread over the rest.
_SIGNS = ".,'\"-:;!?()"
_BLANK, _SPACE, _DIGIT, _CAPITAL, _A = 1, 2, 3, 4, 5
_SIGN = _A + 26
_OTHER_SIGN, _OTHER_SIGNS = _SIGN + len(_SIGNS), 4
_LETTER = _OTHER_SIGN + _OTHER_SIGNS
_CLASS_OF: list[np.ndarray] = []


def char_class(c: str) -> int:
    if c == " ":
        return _BLANK
    if "a" <= c <= "z":
        return _A + ord(c) - 97
    if c in _SIGNS:
        return _SIGN + _SIGNS.index(c)
    kind = unicodedata.category(c)
    if kind == "Lu":
        return _CAPITAL
    if kind[0] in "LM":
        return _LETTER + ord(c) % (CLASSES - _LETTER)
    if kind[0] == "N":
        return _DIGIT
    return _SPACE if c.isspace() or kind[0] in "ZC" else _OTHER_SIGN + ord(c) % _OTHER_SIGNS


def gram_codes(text: str) -> np.ndarray:
    """For every character the code of the n-gram that ends with it."""
    if not _CLASS_OF:
        _CLASS_OF.append(np.fromiter((char_class(chr(c)) for c in range(0x30000)), np.int32, 0x30000))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    classes = np.zeros(len(points) + ORDER - 1, dtype=np.int32)
    classes[ORDER - 1 :] = _CLASS_OF[0][np.minimum(points, 0x2FFFF)]
    codes = classes[: len(points)].copy()
    for i in range(1, ORDER):
        codes <<= _BITS
        codes |= classes[i : i + len(points)]
    return codes


def corpus_grams(docs: DataFrame) -> DataFrame:
    """(text, fit) → (gram, n): every n-gram of the corpus with its count in the rows to fit on, 0 if there is none.

    A task adds its rows up before the shuffle, so a frequent n-gram is one row per task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, fitted = np.zeros(GRAMS, dtype=bool), np.zeros(GRAMS, dtype=np.int32)
        waiting, chars = [], 0
        for batch in batches:
            for text, fit in zip(batch["text"], batch["fit"], strict=True):
                if not text:
                    continue
                codes = gram_codes(text)
                seen[codes] = True
                if fit:
                    waiting.append(codes)
                    chars += len(codes)
                    if chars >= _CHUNK_CHARS:
                        _add(fitted, waiting)
                        waiting, chars = [], 0
        _add(fitted, waiting)
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"gram": found.astype(np.int64), "n": fitted[found].astype(np.int64)})

    return docs.select("text", "fit").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _add(total: np.ndarray, codes: list[np.ndarray]) -> None:
    if codes:
        found, n = np.unique(np.concatenate(codes), return_counts=True)
        total[found] += n.astype(total.dtype)


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney: what is taken off a count of 1, 2, and 3 or more."""
    n = counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return tuple(min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, n) → (gram, logp): natural log of the interpolated probability of each n-gram's last character.

    Lower orders count the different characters seen before a shorter gram. Counts, contexts and the scores of the
    next lower order are joined per order, sharded by gram; no gram or context has more than one row per class.
    """
    counts, levels = grams.where("n > 0"), []
    for order in range(ORDER, 0, -1):
        counts = stage(counts, f"grams{order}")
        levels.append((order, counts, discounts(counts)))
        counts = counts.select((F.col("gram") % CLASSES ** (order - 1)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    scores = None
    for order, counts, d in reversed(levels):
        wanted = grams.select((F.col("gram") % CLASSES**order).alias("gram")).distinct() if order < ORDER else grams.select("gram")
        wanted = wanted.select("gram", F.shiftright("gram", _BITS).alias("context"), (F.col("gram") % CLASSES ** (order - 1)).alias("rest"))
        contexts = counts.groupBy(F.shiftright("gram", _BITS).alias("context")).agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("left"))
        joined = wanted.join(counts, "gram", "left").join(contexts, "context", "left")
        lower = F.lit(1.0 / CLASSES)
        if scores is not None:
            joined, lower = joined.join(scores.select(F.col("gram").alias("rest"), F.col("p").alias("lower")), "rest"), F.col("lower")
        n = F.coalesce("n", F.lit(0))
        p = F.when(F.col("total").isNull(), lower).otherwise((n - _discount(n, d)) / F.col("total") + F.col("left") / F.col("total") * lower)
        scores = joined.select("gram", p.alias("p"))
    return scores.select("gram", F.log("p").alias("logp"))


def score_table(scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(gram, thousandths of a nat) of the n-grams there are: 6 bytes each, and never more than the 64^4 possible ones."""
    cost = F.least(F.round(-_UNIT * F.col("logp")), F.lit(32767)).cast("short")
    got = scores.select(F.col("gram").cast("int").alias("gram"), cost.alias("cost")).toArrow()
    return got["gram"].to_numpy(), got["cost"].to_numpy()


def log_perplexity(text: str | Column, table: Broadcast) -> Column:
    """Mean cost per character of a whole text, in nats; null if it has no character."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        costs = np.full(GRAMS, int(_UNIT * np.log(CLASSES)), dtype=np.int16)
        costs[table.value[0]] = table.value[1]
        for part in parts:
            yield pd.Series([float(costs[gram_codes(t)].sum(dtype=np.int64)) / len(t) / _UNIT if t else None for t in part], dtype="float64")

    return run(F.col(text) if isinstance(text, str) else text)


def chosen_rows(labels: DataFrame, key: str, good: Column, fit_rows: int | None = None, calibration_rows: int | None = None) -> DataFrame:
    """(key, fit): the keys that ``good`` marks, each once; true ones, by a hash of the key, are fitted on.

    All of them, one in ``HELD_OUT`` not fitted on; with both numbers told, a sample of about so many.
    """
    trusted = labels.where(good & F.col(key).isNotNull()).select(F.col(key).alias("chosen")).distinct()
    spread = F.abs(F.xxhash64("chosen", F.lit("quality"))) % 1_000_000
    if fit_rows is None or calibration_rows is None:
        return trusted.select("chosen", (spread < 1_000_000 * (1 - 1 / HELD_OUT)).alias("fit"))
    n, most = max(1, trusted.count()), fit_rows + calibration_rows
    share = min(1.0, most / n)
    cut = 1_000_000 * share * fit_rows / most
    return trusted.where(spread < 1_000_000 * share).select("chosen", (spread < cut).alias("fit"))


def _marked(rows: DataFrame, chosen: DataFrame, small: bool) -> DataFrame:
    """``rows`` (key, ...) with ``fit``, null where the key is not a chosen one. Few keys are broadcast; in a shuffle rows
    without a key would all meet, so they stay out of it."""
    if small:
        return rows.join(F.broadcast(chosen), F.col("key") == F.col("chosen"), "left").drop("chosen")
    told = rows.where("key is not null").join(chosen, F.col("key") == F.col("chosen"), "left").drop("chosen")
    return told.unionByName(rows.where("key is null").withColumn("fit", F.lit(None).cast("boolean")))


def judge(
    docs: DataFrame, labels: DataFrame, good: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang",
    fit_rows: int | None = None, calibration_rows: int | None = None, quantile: float = QUANTILE, margin: float = MARGIN, prior_chars: int = PRIOR_CHARS,
):
    """(score, threshold), two columns over ``docs``; a row is kept where the first is at most the second.

    The model is fitted on all rows of ``docs`` that ``labels`` (same key) marks by ``good`` (default: quality is 1) but
    one in ``HELD_OUT``; ``fit_rows`` and ``calibration_rows`` are an optional bound that nothing here needs. The score is the log perplexity per character, with ``prior_chars`` characters at the
    language's median added, so that a short text is not judged by a few letters. The threshold is the language's
    ``quantile`` of the score over further trusted rows, not fitted on, plus ``margin``; a language without any takes
    that over all. The n-grams of all documents are gathered and scored.

    A null or empty text has a null score and is not kept; a null language is a language of its own; documents
    with equal keys are judged one by one; without trusted rows the
    threshold is infinite and every text that is not empty is kept; an empty table stays empty.
    """
    spark = docs.sparkSession
    chosen = stage(chosen_rows(labels, key, F.col("quality") == 1 if good is None else good, fit_rows, calibration_rows), "trusted")
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    marked = _marked(narrow, chosen, fits_broadcast(chosen.count(), _KEY_BYTES))
    grams = stage(corpus_grams(marked.select("text", F.coalesce("fit", F.lit(False)).alias("fit"))), "grams")
    table = spark.sparkContext.broadcast(score_table(gram_scores(grams)))
    unstage(grams)
    held = marked.where("not fit").select("lang", F.length("text").alias("chars"), log_perplexity("text", table).alias("perplexity")).where("perplexity is not null")
    held = stage(held, "calibration")
    medians = _by_language(held, "perplexity", 0.5)
    shrunk = lambda cost, chars, language: (cost * chars + prior_chars * _of_language(medians, language)) / (chars + prior_chars)
    cuts = _by_language(held.withColumn("score", shrunk(F.col("perplexity"), F.col("chars"), F.col("lang"))), "score", quantile)
    score = shrunk(log_perplexity(docs[text], table), F.length(docs[text]), docs[lang])
    return score, _of_language(cuts, docs[lang]) + margin


def _by_language(held: DataFrame, value: str, quantile: float) -> dict:
    """Quantile per language, of at most as many languages as there are calibration rows; all of them under ''."""
    cut = F.expr(f"percentile_approx({value}, {quantile}, 10000)").alias("cut")
    found = {("of", r["lang"]): r["cut"] for r in held.groupBy("lang").agg(cut).collect()}
    return found | {"all": held.agg(cut).first()["cut"]}


def _of_language(found: dict, language: Column) -> Column:
    """Infinite where there is nothing to go by."""
    other = F.lit(float("inf") if found["all"] is None else found["all"])
    named = [F.lit(v) for k, cut in found.items() if k != "all" and k[1] is not None for v in (k[1], cut)]
    out = F.coalesce(F.create_map(*named)[language], other) if named else other
    return F.when(language.isNull(), found[("of", None)]).otherwise(out) if ("of", None) in found else out


def judge_words(docs: DataFrame, labels: DataFrame, good: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, prior_words: int = PRIOR_WORDS):
    """(head, costs, score, threshold): the n-grams to read texts with, a table with a row per distinct text that has
    others, and functions of a text's size, its language and that row's ``tail``.

    The score is the mean cost of a word under ``word_model``, fitted on all trusted rows but one in ``HELD_OUT``, plus
    the mean log of how often its pair occurs in the text: what a text repeats is cheap to any model, but not common.
    Shrunk and cut like the score by characters. None without trusted rows.
    """
    trusted = labels.where((F.col("quality") == 1 if good is None else good) & F.col(key).isNotNull()).select(F.col(key).alias("chosen")).distinct()
    trusted = stage(trusted.withColumn("fit", F.abs(F.xxhash64("chosen", F.lit("words"))) % HELD_OUT > 0), "word-trusted")
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    small = fits_broadcast(trusted.count(), _KEY_BYTES)
    told = _marked(narrow.where("length(text) > 0"), trusted, small).where("fit is not null").select("text", "lang", "fit")
    told = told if small else stage(told, "word-texts")  # the model reads them several times; they are shuffled once
    fitted = word_model.model(told.where("fit"))
    if fitted is None:
        return None
    weights, unseen, ends = fitted
    head, tail = word_model.split_head(weights)
    costs = word_model.tail_costs(narrow.select("text"), head, tail)
    unstage(weights)

    def raw(size, rest):
        return (size["words"] * unseen + size["head"] + F.coalesce(rest, F.lit(0.0)) + ends + size["repeats"]) / (size["words"] + 1)

    held = told.where("not fit").select(word_model.text_key(F.col("text")).alias("key"), "lang", word_model.size_and_repeats(F.col("text"), head).alias("size"))
    held = held.join(costs, "key", "left").select("lang", F.col("size.words").alias("words"), raw(F.col("size"), F.col("tail")).alias("raw"))
    held = stage(held, "word-calibration")
    if not small:
        unstage(told)
    medians = _by_language(held, "raw", 0.5)

    def score(size, language, rest):
        return (raw(size, rest) * (size["words"] + 1) + prior_words * _of_language(medians, language)) / (size["words"] + 1 + prior_words)

    shrunk = (F.col("raw") * (F.col("words") + 1) + prior_words * _of_language(medians, F.col("lang"))) / (F.col("words") + 1 + prior_words)
    cuts = _by_language(held.withColumn("score", shrunk), "score", quantile)
    return head, costs, score, lambda language: _of_language(cuts, language)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """(doc, log_perplexity, threshold, word_score, word_threshold, keep): ``docs`` as structs, with both scores.

    A row is kept where both are within their thresholds. ``options`` go to ``judge``. A null or empty text is not kept;
    without trusted rows every other one is.
    """
    good = options.get("good")
    score, threshold = judge(docs, labels, key=key, text=text, lang=lang, **options)
    by_words = judge_words(docs, labels, good, key, text, lang)
    size = F.lit(None) if by_words is None else word_model.size_and_repeats(docs[text], by_words[0])
    held = docs.select(
        *[docs[c].alias(f"of_{i}") for i, c in enumerate(docs.columns)], word_model.text_key(docs[text]).alias("key"), docs[lang].alias("language"), size.alias("size"),
        score.alias("log_perplexity"), threshold.alias("threshold"),
    )
    if by_words is None:
        held = held.withColumn("word_score", F.lit(None).cast("double")).withColumn("word_threshold", F.lit(float("inf")))
    else:
        _, costs, word_score, word_threshold = by_words
        held = held.join(costs, "key", "left")
        made = F.when(F.col("log_perplexity").isNotNull(), word_score(F.col("size"), F.col("language"), F.col("tail")))
        held = held.withColumn("word_score", made).withColumn("word_threshold", word_threshold(F.col("language")))
    within = (F.col("log_perplexity") <= F.col("threshold")) & (F.coalesce("word_score", F.lit(0.0)) <= F.col("word_threshold"))
    doc = F.struct(*[F.col(f"of_{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("doc")  # only now, so that columns nobody reads stay out of the join
    return held.select(doc, "log_perplexity", "threshold", "word_score", "word_threshold", F.coalesce(within, F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``judged`` rejects; columns stay as they are."""
    return judged(docs, labels, text=text, **options).where("keep").select("doc.*")
