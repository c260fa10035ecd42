"""Secret scans: credential patterns, and values in a credential's place that are costly to guess."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.llm.guesses import COMMON_WORDS, Ranked, log10_guesses
from taxaspark.session import stage

#: In this order where two start at one place.
KINDS = ("assign", "access", "hex", "guess")
SPAN_TYPE = "array<struct<kind:string,start:long,stop:long>>"
MIN_LOG10 = 8.0
MASK = "[SECRET]"
#: Words of a corpus that are ranked, at most: those of 3 to 24 letters in at least so many documents.
DICTIONARY = 100_000
LEAST_DOCUMENTS = 3


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


_ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_CONTEXT_WORDS = "password|passwd|pwd|passphrase|passcode|secret|token|api_?key|private_?key|access_?key|credential|authorization|authentication|auth"
# After the word its plural, a digit, a separator or a capital may go on; "Author" and "tokenizer" are other words.
_CONTEXT_REST = r"s?(?:[\d_-][\w-]*|(?<=[a-z])[A-Z][\w-]*)?(?![\w-])"
_CONTEXT = re.compile(
    "(?:" + _either_case(_CONTEXT_WORDS) + ")" + _CONTEXT_REST + r"""["']?[ \t]*(?:=>|:=|[:=])[ \t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"']+))"""
)
# One of these is in every match, so a text without them needs no further look.
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")


def base_spans(text: str, whole: bool = False) -> list[tuple[int, int, int]]:
    """(start, kind, end) of credential patterns; of an assignment its value, or if ``whole`` all of it from its word on."""
    low = text.lower()
    found = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(0 if whole else 2), 0, m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def _values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what stands after a credential word."""
    low = text.lower()
    if any(h in low for h in _CONTEXT_HINTS):
        for m in _CONTEXT.finditer(text):
            start, end = next(m.span(g) for g in (1, 2, 3) if m[g] is not None)
            while m[3] is not None and end > start and text[end - 1] in ".,;:)]}>":
                end -= 1
            yield start, end


_LETTERS = re.compile(r"[^\W\d_]+")


def corpus_words(docs: DataFrame, text: str = "text", most: int = DICTIONARY, least: int = LEAST_DOCUMENTS) -> Ranked:
    """Common words, then the words of ``docs`` by the number of documents that have them.

    A word counts where it stands outside credential patterns and values, so that a secret is no word for being leaked
    often. What reaches the driver and the tasks is ``most`` words of at most 24 letters, below 10 MB.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter()
            for body in batch["text"]:
                if body:
                    free, upto = [], 0
                    for start, end in sorted([*((a, b) for a, _, b in base_spans(body)), *_values(body)]):
                        free.append(body[upto:start])
                        upto = max(upto, end)
                    found.update({w for w in _LETTERS.findall(" ".join([*free, body[upto:]]).lower()) if 3 <= len(w) <= 24})
            yield pd.DataFrame({"word": pd.Series(list(found), dtype=object), "n": pd.Series(list(found.values()), dtype="int64")})

    counted = docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ranked = stage(counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most), "dictionary")
    return Ranked((*COMMON_WORDS, *[r["word"] for r in ranked.orderBy(F.desc("n"), "word").collect()]))


def all_spans(text: str, min_log10: float = MIN_LOG10, words: tuple[str, ...] | Ranked = COMMON_WORDS, whole: bool = False) -> list[tuple[int, int, int]]:
    """Base spans, and what stands after a credential word and costs more than 10^``min_log10`` guesses, unless a
    base span covers it; sorted by start, then kind. ``whole`` is as for ``base_spans`` and adds or drops no span."""
    found = base_spans(text)
    for start, end in _values(text):
        if end - start >= 6 and not any(a <= start and end <= b for a, k, b in found if k < 3) and log10_guesses(text[start:end], words) >= min_log10:
            found.append((start, 3, end))
    if whole and any(k == 0 for _, k, _ in found):
        found = base_spans(text, whole=True) + [s for s in found if s[1] == 3]
    return sorted(found)


def secret_spans(text: str | Column, min_log10: float = MIN_LOG10, words: tuple[str, ...] | Ranked = COMMON_WORDS, whole: bool = False) -> Column:
    """Column of spans (kind, start, stop; code points, stop exclusive) in a whole text.

    An assignment's span is its value, which is what to mask; ``whole``: the matched text from the credential word on.

    A value is cut at least cost into words, dates, repeats, keyboard walks and single characters
    (``guesses.log10_guesses``). ``words``: ranked words, cheapest first, as of ``corpus_words``. A null or empty text
    has none.
    """
    sent = SparkSession.getActiveSession().sparkContext.broadcast(words) if isinstance(words, Ranked) else None
    given = words if sent is None else None

    @F.pandas_udf(SPAN_TYPE)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[(KINDS[k], a, b) for a, k, b in all_spans(t, min_log10, given if sent is None else sent.value, whole)] if t else [] for t in part], dtype=object)

    return scan(F.col(text) if isinstance(text, str) else text)


def spans_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mask``."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("upto"))

    def step(state, s):
        gap = F.substring(text, (state["upto"] + 1).cast("int"), (s["start"] - state["upto"]).cast("int"))
        return F.struct(
            F.when(s["start"] >= state["upto"], F.concat(state["done"], gap, F.lit(mask))).otherwise(state["done"]).alias("done"),
            F.greatest(state["upto"], s["stop"]).alias("upto"),
        )

    return F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substring(text, (s["upto"] + 1).cast("int"), F.length(text))))


def mask_secrets(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with secrets in ``text`` masked; all columns stay as they are, a null text stays null. Words to guess by
    are those of ``docs`` unless ``words`` says otherwise.

    Each text is scanned whole and by itself, so order, ties and repeated rows do not matter; an empty table stays
    empty. Other columns are carried along in one struct, so any name is fine.
    """
    options["words"] = options.get("words") or corpus_words(docs, text)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), secret_spans(docs[text], **options).alias("spans"))
    body = F.col("doc")[text]
    return held.select(F.col("doc").withField(f"`{text}`", F.when(F.size("spans") > 0, masked(body, F.col("spans"))).otherwise(body)).alias("doc")).select("doc.*")
