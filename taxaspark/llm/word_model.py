"""Cost of whole texts under an interpolated modified Kneser-Ney model of word pairs, sharded by n-gram.

Words are told apart as they are written, by 64-bit hashes; nothing is folded. The model is two tables that grow with
the trusted text; a text's distinct words and pairs are joined with them and summed up again per text. For a pair (u, w),

    -log p(w|u) = one(w) + back(u) + more(u, w)

where ``more`` is 0 for a pair that the model has not seen, so the cost of a text is a sum over the n-grams it shares
with the model, plus a constant for every word it does not. The most frequent n-grams of the model, at most ``HEAD``, are
broadcast and summed where a text is read; only a text's other n-grams are shuffled. Whatever grows with the n-grams is
shuffled in ``SLICES`` parts, one after another: texts are read again for each, and the disk holds one part's shuffle at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm import quality
from taxaspark.llm.ngram_join import hash_bits, in_bits
from taxaspark.session import stage, unstage

_START, _END = (int(x) for x in pd.util.hash_array(np.array(["\n<", "\n>"], dtype=object)).view(np.int64))
_TINY = 1e-9
#: At most so many n-grams are broadcast: 16 bytes each.
HEAD = 1 << 20
#: Parts of the n-grams by the low bits of their hash; a power of two.
SLICES = 4
# So many characters are hashed in one go.
_CHUNK_CHARS = 2_000_000


def word_hashes(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, edges) for runs of texts of about ``_CHUNK_CHARS``: the hashes of each text's words between those of its
    start and its end, text after text, and where each begins and the last one ends. A null text has no words."""
    held, chars = [], 0
    for text in texts:
        held.append(["\n<", *(text or "").encode("utf-8", "replace").decode().split(), "\n>"])
        chars += len(text or "")
        if chars >= _CHUNK_CHARS:
            yield _hashed(held)
            held, chars = [], 0
    if held:
        yield _hashed(held)


def _hashed(held: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    words = np.array([w for text in held for w in text], dtype=object)
    return pd.util.hash_array(words, categorize=False).view(np.int64), np.cumsum([0, *map(len, held)])


def _mixed_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    u, w = first.view(np.uint64), second.view(np.uint64)
    mixed = u * np.uint64(0x9E3779B97F4A7C15) ^ (w + (u >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def grams_of(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, owner, single): all words, then all pairs of a word or an end with what stands before it; the place of each
    one's text in its run; and which hashes of ``words`` are words."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    inside = np.ones(len(words), dtype=bool)
    inside[edges[:-1]] = False
    pairs = np.zeros(len(words), dtype=np.int64)
    pairs[1:] = _mixed_pair(words[:-1], words[1:])
    single = inside.copy()
    single[edges[1:] - 1] = False
    return np.concatenate([words[single], pairs[inside]]), np.concatenate([owner[single], owner[inside]]), single


def size_and_repeats(text: Column, head: Broadcast) -> Column:
    """(words, repeats, head): how many words, the sum of n log n over distinct pairs that occur n times, and the sum of
    the weights of the n-grams in ``head``."""

    @F.pandas_udf("words long, repeats double, head double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [pd.DataFrame({"words": np.zeros(0, np.int64), "repeats": np.zeros(0), "head": np.zeros(0)})]
            for words, edges in word_hashes(part):
                grams, owner, single = grams_of(words, edges)
                at, known = _looked_up(grams, head.value[0])
                weight = np.bincount(owner[known], head.value[1][at[known]], minlength=len(edges) - 1)
                pairs, repeats = grams[int(single.sum()) :], np.zeros(len(edges) - 1)
                starts = edges - np.arange(len(edges))  # each text has one pair fewer than words and ends
                for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    n = np.unique(pairs[lo:hi], return_counts=True)[1]
                    repeats[i] = (n * np.log(n)).sum()
                made.append(pd.DataFrame({"words": np.diff(edges) - 2, "repeats": repeats, "head": weight}))
            yield pd.concat(made, ignore_index=True)

    return run(text)


def _looked_up(grams: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_in_head`` in sorted order, which reads a large table in one sweep."""
    order = np.argsort(grams)
    at, known = np.empty(len(grams), dtype=np.int64), np.empty(len(grams), dtype=bool)
    at[order], known[order] = _in_head(grams[order], head)
    return at, known


def _in_head(grams: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(head):
        return np.zeros(len(grams), dtype=np.int64), np.zeros(len(grams), dtype=bool)
    at = np.minimum(np.searchsorted(head, grams), len(head) - 1)
    return at, head[at] == grams


def _of_slice(grams: np.ndarray, part: int, slices: int) -> np.ndarray:
    return grams & (slices - 1) == part


def pair_counts(texts: DataFrame, part: int) -> DataFrame:
    """(text) → (u, w, n): how often each word follows another one or a text's start, or ends a text; one slice of the pairs."""
    slices = SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words, edges in word_hashes(t for t in batch["text"] if t):
                inside = np.ones(len(words), dtype=bool)
                inside[edges[:-1]] = False
                u, w = words[:-1][inside[1:]], words[inside]
                own = _of_slice(_mixed_pair(u, w), part, slices)
                pairs = pd.DataFrame({"u": u[own], "w": w[own]})
                yield pairs.groupby(["u", "w"], sort=False).size().rename("n").reset_index()

    return texts.select("text").mapInPandas(count, "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n"))


def lexicon(pairs: DataFrame, types: int) -> tuple[DataFrame, float, tuple[float, float, float]]:
    """(word, p, total, back) of all words, the chance of a word never seen, and the discounts of pairs.

    p is a word's chance by itself, total how often it stands before another, and back the share of that given to words
    not seen after it. A text's start has no p, its end has no back.
    """
    ones = stage(pairs.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")), "words")
    d2, d1 = quality.discounts(pairs), quality.discounts(ones)
    vocabulary, left = ones.agg(F.count("*"), F.sum(quality._discount(F.col("n"), d1))).first()
    unseen = max(left / types, _TINY) / (vocabulary + 1)
    after = pairs.groupBy(F.col("u").alias("word")).agg(F.sum("n").alias("total"), F.sum(quality._discount(F.col("n"), d2)).alias("off"))
    after = after.select("word", "total", F.greatest(F.col("off") / F.col("total"), F.lit(_TINY)).alias("back"))
    alone = ones.select("word", ((F.col("n") - quality._discount(F.col("n"), d1)) / types + unseen).alias("p"))
    made = stage(alone.join(after, "word", "full").select("word", "p", "total", "back"), "lexicon")
    unstage(ones)
    return made, unseen, d2


def word_head(words: DataFrame) -> tuple[Broadcast, bool]:
    """The most frequent words, at most ``HEAD``, sorted, with their p, total and back; and whether these are all."""
    known = words.where("p is not null and total is not null")
    least = _least(known, "total")
    got = words.where(F.lit(False) if least is None else (F.col("total") >= least) | F.col("total").isNull() | F.col("p").isNull()).toArrow()
    order = np.argsort(got["word"].to_numpy())
    values = [got[c].cast("double").to_numpy(zero_copy_only=False)[order] for c in ("p", "total", "back")]
    return words.sparkSession.sparkContext.broadcast((got["word"].to_numpy()[order], *values)), words.count() == len(order)


def pair_weights(pairs: DataFrame, words: DataFrame, d2: tuple[float, float, float], head: Broadcast, covers: bool) -> DataFrame:
    """(gram, weight, n) of every pair. Only pairs with a word that is not in ``head`` are shuffled, if it does not have all."""
    off = np.array([0.0, *d2])

    def both(frame: pd.DataFrame) -> tuple:
        at, has_u = _in_head(frame["u"].to_numpy(), head.value[0])
        to, has_w = _in_head(frame["w"].to_numpy(), head.value[0])
        return at, to, has_u & has_w

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, p, total, back = head.value
        for frame in batches:
            at, to, covered = both(frame)
            at, to, n = at[covered], to[covered], frame["n"].to_numpy()[covered]
            low = back[at] * p[to]
            more = np.log(low) - np.log((n - off[np.minimum(n, 3)]) / total[at] + low)
            grams = _mixed_pair(frame["u"].to_numpy()[covered], frame["w"].to_numpy()[covered])
            yield pd.DataFrame({"gram": grams, "weight": more.astype(np.float32), "n": n})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            left = frame[~both(frame)[2]]
            yield left.assign(gram=_mixed_pair(left["u"].to_numpy(), left["w"].to_numpy()))

    made = pairs.mapInPandas(weigh, "gram long, weight float, n long")
    if covers:
        return made
    rest = pairs.mapInPandas(others, "u long, w long, n long, gram long")
    rest = rest.join(words.select(F.col("word").alias("u"), "total", "back"), "u").join(words.select(F.col("word").alias("w"), "p"), "w")
    low = F.col("back") * F.col("p")
    more = F.log(low) - F.log((F.col("n") - quality._discount(F.col("n"), d2)) / F.col("total") + low)
    return made.unionByName(rest.select("gram", more.cast("float").alias("weight"), "n"))


def model(texts: DataFrame) -> tuple[DataFrame, float, float] | None:
    """(text) → (gram, weight, n) of every word and pair seen, the cost of any word before weights, and that of a text's ends."""
    pairs = [stage(pair_counts(texts, part).sortWithinPartitions("u", "w"), "pairs") for part in range(SLICES)]
    every = reduce(DataFrame.unionByName, pairs)
    types = every.count()
    if not types:
        return None
    words, unseen, d2 = lexicon(every, types)
    single = words.where("p is not null and back is not null")
    weight = (F.lit(float(np.log(unseen))) - F.log("p") - F.log("back")).cast("float")
    single = single.select(F.col("word").alias("gram"), weight.alias("weight"), F.col("total").alias("n"))
    end, start = words.where(F.col("word") == _END).first()["p"], words.where(F.col("word") == _START).first()["back"]
    weights = stage(single, "weights")
    head, covers = word_head(words)
    for part in pairs:
        weights = stage(pair_weights(part, words, d2, head, covers), "weights", into=weights)
        unstage(part)
    head.destroy()
    unstage(words)
    return weights, -float(np.log(unseen)), -float(np.log(end) + np.log(start))


def _least(counted: DataFrame, n: str) -> int | None:
    """The count that at most ``HEAD`` rows have or exceed; rows of equal counts stay together."""
    least, so_far = None, 0
    for r in counted.groupBy(n).agg(F.count("*").alias("many")).orderBy(F.desc(n)).collect():  # different counts: few
        so_far += r["many"]
        if so_far > HEAD:
            break
        least = r[n]
    return least


def split_head(weights: DataFrame) -> tuple[Broadcast, DataFrame]:
    """The n-grams above a count that at most ``HEAD`` have, sorted, and the table of all others."""
    least = _least(weights, "n")
    most = F.lit(False) if least is None else F.col("n") >= least
    got = weights.where(most).select("gram", "weight").toArrow()
    grams, values = got["gram"].to_numpy(), got["weight"].to_numpy()
    order = np.argsort(grams)
    return weights.sparkSession.sparkContext.broadcast((grams[order], values[order])), weights.where(~most).select("gram", "weight")


def text_key(text: Column) -> Column:
    """Equal texts have equal costs, so a hash of the text is all that a text's n-grams carry along."""
    return F.xxhash64(text)


def tail_costs(docs: DataFrame, head: Broadcast, tail: DataFrame) -> DataFrame:
    """(text) → (key, tail): per distinct text the sum of the weights of its words and pairs in ``tail``, if it has any.

    N-grams that a bit table of fixed size does not have are not shuffled; copies in one batch are read once. The result is
    staged: it is the sum over slices of the n-grams, which only leave a number for each text.
    """
    slices = SLICES

    def grams(batches: Iterator[pd.DataFrame], part: int, table: Broadcast) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = batch.groupby("key", sort=False)["text"].agg(["first", "size"])
            keys, copies, done = each.index.to_numpy(np.int64), each["size"].to_numpy(np.int64), 0
            for words, edges in word_hashes(each["first"]):
                found, owner, _ = grams_of(words, edges)
                own = _of_slice(found, part, slices)
                found, owner = found[own], owner[own]
                wanted = ~_looked_up(found, head.value[0])[1]
                wanted[wanted] = in_bits(table.value, found[wanted])
                own = pd.DataFrame({"owner": owner[wanted] + done, "gram": found[wanted]}).groupby(["owner", "gram"], sort=False).size().rename("n").reset_index()
                at, done = own["owner"].to_numpy(), done + len(edges) - 1
                order = np.argsort(at, kind="stable")  # a text's rows together, so that its key packs well
                yield pd.DataFrame({"key": keys[at], "gram": own["gram"], "n": own["n"] * copies[at]}).iloc[order]

    keyed = docs.where("length(text) > 0").select(text_key(F.col("text")).alias("key"), "text")
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies"))
    sums = None
    for part in range(slices):
        known = tail.where(F.col("gram").bitwiseAND(F.lit(slices - 1)) == part)
        table = docs.sparkSession.sparkContext.broadcast(hash_bits(known, "gram"))  # of one slice, so fewer others pass
        asked = keyed.mapInPandas(partial(grams, part=part, table=table), "key long, gram long, n long")
        sums = stage(asked.join(known, "gram").groupBy("key").agg(F.sum(F.col("n") * F.col("weight")).alias("part")), "sums", into=sums)
        table.destroy()
    whole = sums.groupBy("key").agg(F.sum("part").alias("all")).join(copies, "key")
    costs = stage(whole.select("key", (F.col("all") / F.col("copies")).alias("tail")), "costs")
    unstage(sums)
    return costs
