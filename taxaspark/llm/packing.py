"""Harmonic packing of token streams into training sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 4096
# Distinct words whose ids a worker remembers before it starts over.
CACHED_WORDS = 600_000
FLUSH_BYTES = 8 << 20
# Letters that are composed and lower case already, then ASCII signs; no "<", with which special tokens begin.
_SIMPLE_WORD = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([!-/:;=-@\[-`{-~]*)")
# Byte-level vocabularies write each byte as a printable character: Latin-1 ones as themselves, the rest from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in order, and
    each distinct word is encoded once. Only blank and line feed split, which is safe for any further white space.
    A word of Latin letters with signs behind it, which is most of them, is two units to the tokenizer whatever
    follows: the letters go to its model directly, the signs are looked up. All other words take the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._words: dict[str, bytes] = {}
        self._letters: dict[str, bytes] = {}
        self._signs: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join([self._words[w] for w in words])
        except KeyError:
            if len(self._words) > CACHED_WORDS:
                self._words = {}
            if len(self._letters) > CACHED_WORDS:
                self._letters = {}
            known = self._words
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in words])

    def _word(self, word: str) -> bytes:
        simple = _SIMPLE_WORD.fullmatch(word.lower())
        if not simple:
            return self._whole(word)
        letters, signs = simple.groups()
        ids = self._letters.get(letters)
        if ids is None:
            units = letters if letters.isascii() else "".join([_BYTE_LETTERS[b] for b in letters.encode()])
            ids = self._letters[letters] = np.asarray([t.id for t in self._tokenizer.model.tokenize(units)], dtype="<u4").tobytes()
        if not signs:
            return ids
        if signs not in self._signs:
            if len(self._signs) > CACHED_WORDS:
                self._signs = {}
            self._signs[signs] = self._whole(signs)
        return ids + self._signs[signs]

    def _whole(self, word: str) -> bytes:
        return np.asarray(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """One per worker process, which keeps what it knows from task to task."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = WordEncoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]


def cut_points(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then falling reciprocals capacity / 2^j of it.

    Every length is a power of two, so a bin of its class is filled exactly by capacity / length pieces.
    """
    pieces = [(start, capacity) for start in range(0, tokens - tokens % capacity, capacity)]
    start, rest = tokens - tokens % capacity, tokens % capacity
    while rest:
        length = 1 << (rest.bit_length() - 1)
        pieces.append((start, length))
        start, rest = start + length, rest - length
    return pieces


class HarmonicBins:
    """One open bin per class of length; a full one leaves at once, so less than a sequence per class is held."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def add(self, length: int, piece) -> Iterator[tuple]:
        waiting = self.open.setdefault(length, [])
        waiting.append(piece)
        if len(waiting) * length == self.capacity:
            yield from self._close(length, waiting)
            self.open[length] = []

    def finish(self) -> Iterator[tuple]:
        """An unfilled bin becomes shorter sequences, each of a power of two, so none of them is padded."""
        for length, waiting in self.open.items():
            while waiting:
                n = 1 << (len(waiting).bit_length() - 1)
                yield from self._close(length, waiting[:n])
                waiting = waiting[n:]
        self.open = {}

    def _close(self, length: int, pieces: list) -> Iterator[tuple]:
        for i, piece in enumerate(pieces):
            yield (*piece, self.next_id, i * length)
        self.next_id += 1


def pack(docs: DataFrame, tokenizer_json: str, end_id: int = 2, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole texts into sequences of ``capacity`` tokens (a power of two); one row per piece.

    A document is cut into pieces whose lengths are ``capacity / 2^j``; class j fills a bin with 2^j of them, and
    every worker fills bins from its own rows alone, so nothing is shuffled. What a worker's last bin of a class
    lacks is no padding either: it is split into sequences whose totals are powers of two.

    ``tokenizer_json`` is the tokenizer file's content, so that executors need no file. Columns: ``key``, start,
    length, ids (little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset.
    A null text is empty and gives the end id alone; an empty table no row; equal rows are packed one by one, ties
    need no order; a null key is kept. Other columns are not read, so their names cannot clash.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType)]
        + [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
    )
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        out, held, kind = [], 0, None

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for ident, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(value.as_py() or "") + end
                n, ident = len(ids) // 4, ident.as_py()
                for start, length in cut_points(n, capacity):
                    for row in bins.add(length, (ident, start, length, ids[4 * start : 4 * (start + length)], n)):
                        out.append(row)
                        held += 4 * length + 64
                    if held >= FLUSH_BYTES:
                        yield flush()
                        out, held = [], 0
        if kind is not None:
            out.extend(bins.finish())
            yield flush()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
