"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the tokens that end together."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.llm.packing import _BYTE_LETTERS
from taxaspark.session import stage

# Characters of text whose tokens are in memory at once; a longer text is a slice of its own.
SLICE_CHARS = 1 << 20
# A pair with at least this share of all links is looked up in a table every worker has: there are at most 2^18 such.
HOT_SHARE = 1 / (1 << 18)
# Distinct pairs a task counts before it hands them on.
COUNTED_PAIRS = 1 << 21


class ByteTokens:
    """A byte-level vocabulary: ids of a text, and the bytes of every id.

    Where ids follow the merges, which is the rule for such files, the faster of the two libraries reads the same
    vocabulary; what it can't take, and any other file, goes to the file's own library.
    """

    def __init__(self, tokenizer_json: str, pattern: str):
        self._json, self._slow, self._fast = tokenizer_json, None, None
        model = json.loads(tokenizer_json)["model"]
        letters = {c: b for b, c in _BYTE_LETTERS.items()}
        self.bytes = [b""] * (1 + max(model["vocab"].values()))
        for entry, i in model["vocab"].items():
            if all(c in letters for c in entry):
                self.bytes[i] = bytes(letters[c] for c in entry)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        if made == sorted(made) and made[:1] != [-1]:
            import tiktoken

            ranks = {entry: i for i, entry in enumerate(self.bytes) if len(entry) == 1} | {self.bytes[i]: i for i in made}
            self._fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self._fast is not None:
            try:
                return self._fast.encode_ordinary(text)
            except BaseException as error:  # its regular expressions give up, by a panic, on very long runs of one kind
                if isinstance(error, (KeyboardInterrupt, SystemExit)):
                    raise
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._json)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A sentence-piece vocabulary: ids of texts, and the bytes of every id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [
            bytes([int(self._model.id_to_piece(i)[3:5], 16)]) if self._model.is_byte(i) else self._model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self._model.get_piece_size())
        ]

    def __call__(self, text: str) -> list[int]:
        return self._model.encode(text)


_TOKENS: dict[tuple, tuple] = {}


def _tokenizers(byte_json: str, pattern: str, piece_model: bytes):
    """One pair per worker process."""
    name = (byte_json, pattern, piece_model)
    if name not in _TOKENS:
        _TOKENS.clear()
        a, b = ByteTokens(byte_json, pattern), PieceTokens(piece_model)
        sizes = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (a, b)]
        words = [np.array([f"{i}{sign}" for sign in ",|" for i in range(len(a.bytes))], dtype=object), np.array([f"{i}{sign}" for sign in ",;" for i in range(len(b.bytes))], dtype=object)]
        _TOKENS[name] = a, b, sizes, words
    return _TOKENS[name]


def _frame(ids: list[list[int]], sizes: np.ndarray, first_byte: np.ndarray) -> pd.DataFrame:
    """Tokens in order: id, doc, and byte start and end counted over the whole slice, so that a document's are its own."""
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=sum(map(len, ids)))
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    size = sizes[flat]
    ends = np.cumsum(size)
    before = np.cumsum([0, *[len(x) for x in ids]])[:-1]
    shift = first_byte - np.concatenate(([0], ends))[before] if len(ids) else first_byte
    return pd.DataFrame({"id": flat, "doc": doc, "start": ends - size + shift[doc], "end": ends + shift[doc]})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (of a, of b) of all tokens that share a byte, by a and then b.

    Both frames hold doc, start and end, with the same bytes covered without gaps. Every token's start lies in one
    token of the other side, found by an as-of merge within the document; a pair that overlaps is found from the start
    that comes later, so both directions together are all of them.
    """
    left = a.assign(a=np.arange(len(a)))[["doc", "start", "a"]]
    right = b.assign(b=np.arange(len(b)))[["doc", "start", "b"]]
    of_a = pd.merge_asof(left, right, on="start", by="doc")
    of_b = pd.merge_asof(right, left, on="start", by="doc")
    later = a["start"].to_numpy()[of_b["a"].to_numpy()] != of_b["start"].to_numpy()  # equal starts came from the first
    at_a = np.concatenate([of_a["a"].to_numpy(), of_b["a"].to_numpy()[later]])
    at_b = np.concatenate([of_a["b"].to_numpy(), of_b["b"].to_numpy()[later]])
    order = np.lexsort((at_b, at_a))
    return at_a[order], at_b[order]


def _group_texts(a: pd.DataFrame, b: pd.DataFrame, ends_a: np.ndarray, ends_b: np.ndarray, docs: int, words) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` per document: both sides' ids, dealt by group, a's first; ends mark a group's last token."""
    last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    last_a[ends_a] = 1
    last_b[ends_b] = 1
    group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
    texts = np.concatenate([words[0][a["id"].to_numpy() + last_a * (len(words[0]) // 2)], words[1][b["id"].to_numpy() + last_b * (len(words[1]) // 2)]])
    texts = texts[np.argsort(group, kind="stable")].tolist()
    edges = np.cumsum(np.bincount(a["doc"], minlength=docs) + np.bincount(b["doc"], minlength=docs)).tolist()
    return ["".join(texts[low:high])[:-1] for low, high in zip([0, *edges], edges, strict=False)]


def _lists(values: np.ndarray, per_doc: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_doc))), pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, byte_json: str, pattern: str, piece_model: bytes, key: str = "doc_id", text: str = "text", with_overlaps: bool = True) -> DataFrame:
    """Tokens of both vocabularies over space + text, and where they meet; one row per document.

    Columns: ``key``; a_ids and b_ids; n_groups; groups, as ``a1,a2|b1;a3|b2,b3`` cut where tokens of both sides end;
    pairs and times, the distinct links (a's id * 2^32 + b's id of two tokens that end together) and how often the
    document has each; with ``with_overlaps`` also overlap_a, overlap_b (places of tokens that share a byte) and
    ends_together. ``byte_json``, ``pattern`` (that splits words) and ``piece_model`` are the vocabularies' contents.

    Special tokens' strings are plain text. A text that is null, empty, or that either side's tokens don't spell out
    byte by byte, has no tokens: empty lists and an empty string. Very long texts are whole, one at a time; equal rows
    give equal rows, null keys are kept, an empty table gives none. Other columns are not read.
    """
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    fields = [(key, docs.schema[key].dataType), ("a_ids", ints), ("b_ids", ints), ("n_groups", T.LongType()), ("groups", T.StringType()), ("pairs", longs), ("times", ints)]
    if with_overlaps:
        fields += [("overlap_a", ints), ("overlap_b", ints), ("ends_together", T.ArrayType(T.BooleanType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def slices(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        start, held = 0, 0
        for i, t in enumerate(texts):
            if i > start and held + len(t) > SLICE_CHARS:
                yield batch.column(0).slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(t)
        if texts:
            yield batch.column(0).slice(start), texts[start:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, encode_b, sizes, words = _tokenizers(byte_json, pattern, piece_model)
        for batch in batches:
            for keys, texts in slices(batch):
                n = len(texts)
                ids_a, ids_b, lengths = [], [], []
                for t in texts:
                    spelt = (" " + t).encode() if t else b""
                    of_a, of_b = (encode_a(" " + t), encode_b(t)) if t else ([], [])
                    same = b"".join([encode_a.bytes[i] for i in of_a]) == spelt == b"".join([encode_b.bytes[i] for i in of_b])
                    ids_a.append(of_a if same else [])
                    ids_b.append(of_b if same else [])
                    lengths.append(len(spelt) if same else 0)
                first = np.cumsum([0, *lengths])[:-1]
                a, b = _frame(ids_a, sizes[0], first), _frame(ids_b, sizes[1], first)
                at_a, at_b = overlaps(a, b)
                together = a["end"].to_numpy()[at_a] == b["end"].to_numpy()[at_b]
                link_a, link_b = at_a[together], at_b[together]
                doc = a["doc"].to_numpy()[link_a]
                link = (a["id"].to_numpy()[link_a] << 32) + b["id"].to_numpy()[link_b]
                order = np.lexsort((link, doc))
                new = np.ones(len(link), dtype=bool)
                new[1:] = (doc[order][1:] != doc[order][:-1]) | (link[order][1:] != link[order][:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(link)))
                distinct = np.bincount(doc[order][new], minlength=n)
                columns = [
                    keys,
                    _lists(a["id"].to_numpy(), np.bincount(a["doc"], minlength=n), pa.int32()),
                    _lists(b["id"].to_numpy(), np.bincount(b["doc"], minlength=n), pa.int32()),
                    pa.array(np.bincount(doc, minlength=n), pa.int64()),
                    pa.array(_group_texts(a, b, link_a, link_b, n, words), pa.string()),
                    _lists(link[order][new], distinct, pa.int64()),
                    _lists(times, distinct, pa.int32()),
                ]
                if with_overlaps:
                    per = np.bincount(a["doc"].to_numpy()[at_a], minlength=n)
                    firsts = [np.concatenate(([0], np.cumsum(np.bincount(t["doc"], minlength=n))))[:-1] for t in (a, b)]
                    of = a["doc"].to_numpy()[at_a]
                    columns += [_lists(at_a - firsts[0][of], per, pa.int32()), _lists(at_b - firsts[1][of], per, pa.int32()), _lists(together, per, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids in all documents, and whether none of its b id's pairs has more.

    Tasks add up their documents' pairs before the exchange, so that a frequent pair is a row per task. ``aligned``
    holds pairs and times; without rows, or links, the result is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            both = np.concatenate([known, _flat(batch, "pairs")])
            known, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, _flat(batch, "times")]), minlength=len(known)).astype(np.int64)
            if len(known) > COUNTED_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(counts)], names=["pair", "n"])
                known, counts = known[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(counts)], names=["pair", "n"])

    counted = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    counted = stage(counted, "pairs")
    # One row per id of the second vocabulary, whatever the corpus.
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_link_scores(aligned: DataFrame) -> DataFrame:
    """``aligned`` without pairs and times, with n_links, n_best and count_sum.

    A link's count is how many links of the whole corpus hold its pair; count_sum adds it up over a document's links,
    n_best counts those whose pair is, ties included, the most frequent of its b id. Pairs with a share of 2^-18 of all
    links or more, at most 2^18 pairs, go to every worker; the others are joined, where none of them can be a hot key.
    Rows without links have zeros. Columns of ``aligned`` beside pairs and times are kept; their names may not begin
    with two underscores.
    """
    spark = aligned.sparkSession
    rows = stage(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(rows), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= total * HOT_SHARE).toArrow().to_pandas().sort_values("pair")
    table = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            links, times = _flat(batch, "pairs"), _flat(batch, "times").astype(np.int64)
            per = np.diff(batch.column(1).offsets.to_numpy())
            doc = np.repeat(np.arange(len(per)), per)
            at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
            known = pair[at] == links if len(pair) else np.zeros(len(links), dtype=bool)
            add = [np.zeros(len(per), dtype=np.int64) for _ in range(3)]
            np.add.at(add[0], doc, times)
            np.add.at(add[1], doc[known], times[known] * best[at[known]])
            np.add.at(add[2], doc[known], times[known] * n[at[known]])
            cold = np.bincount(doc[~known], minlength=len(per))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in add], _lists(links[~known], cold, pa.int64()), _lists(times[~known], cold, pa.int32())], names=["__row", "n_links", "n_best", "count_sum", "pairs", "times"])

    scored = rows.select("__row", "pairs", "times").mapInArrow(run, "__row long, n_links long, n_best long, count_sum long, pairs array<long>, times array<int>")
    scored = stage(scored, "scored")
    cold = scored.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("__row", "l.pairs", "l.times")
    rare = counts.where(F.col("n") < total * HOT_SHARE).withColumnRenamed("pair", "pairs")
    cold = cold.join(rare, "pairs").select("__row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"), F.lit(0).cast("long").alias("n_links"))
    sums = scored.select("__row", "n_best", "count_sum", "n_links").unionByName(cold).groupBy("__row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    return rows.drop("pairs", "times").join(sums, "__row").drop("__row")
