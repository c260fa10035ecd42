"""Jaccard similarity join of shingle sets by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.llm.rows import cells, components, group_edges, whole_groups
from taxaspark.llm.shingles import mixed, set_digest, shingles
from taxaspark.session import stage, unstage

#: Rows of one bucket that are compared in one go; a larger bucket is cut into pairs of such parts.
CELL_ROWS = 2048
# Exact copies a task remembers, so that it sends their keys once.
_SEEN = 200_000
_FILTER_BITS = 26
# A fold has so many longs at least, and one for so many blocks of its sketch.
_FOLDED, _BLOCKS_A_LONG = 4, 24
# Rows joined with folds in one go: so many, or so many for each sketch, so that the shuffles stay in proportion to the sets.
_SLICE_ROWS, _ROWS_A_SKETCH = 1 << 20, 4
# Bits of a long that count together: all of a fold's, either half of either block of a sketch's.
_FOLD_FIELDS = [[-1]]
_BLOCK_FIELDS = [[0xFFFF, 0xFFFF << 16], [0xFFFF << 32, -1 << 48]]
_CELL = ["bucket", "i", "j"]
_BLOCK_MIX = 0xC2B2AE3D27D4EB4F


@dataclass(frozen=True)
class Bands:
    """Sizes in bands, each with a sketch of its own width, for pairs with Jaccard similarity of ``num / den`` or more.

    Such sets of a and b shingles differ in at most (den - num) / (den + num) * (a + b). A band's sketch has one
    block of 32 bits more than two sets of its largest size may differ, plus some spare ones. Every shingle goes to
    one block and flips one bit of each of its halves: the blocks of two sketches that differ, and in either half of
    a block the bits that do, are no more than the shingles that do, so more blocks than the spare ones are equal.
    Shingles that cancel each other in one half seldom do in the other.
    """

    num: int
    den: int

    @property
    def least(self) -> int:
        """Smaller sets are linked to equal ones only."""
        return -(-self.num // (self.den - self.num))

    def edge(self, band: int) -> int:
        return _edge(self.least, band)

    def differ(self, total: int) -> int:
        return (self.den - self.num) * total // (self.den + self.num)

    def spare(self, band: int, size: int | None = None) -> int:
        """Blocks that need not be joined on: one less than a pair has equal. A set of ``size`` has more of them, since
        it and the largest set of the band that it can be linked to differ in less than two of the largest sets may."""
        if size is not None:
            return self.blocks(band) - 1 - self.differ(size + min(self.edge(band + 1) - 1, size * self.den // self.num))
        needed = self.differ(2 * (self.edge(band + 1) - 1)) + 1
        spare = 1 + 3 * (self.den - self.num) * needed // (self.den + self.num)
        return spare + (needed + spare) % 2  # an even number of blocks fills whole longs

    def blocks(self, band: int) -> int:
        return self.differ(2 * (self.edge(band + 1) - 1)) + 1 + self.spare(band)

    def of(self, size: int) -> list[int]:
        """A set's own band, and the next one if it can be linked to a set of that."""
        if size < self.least:
            return []
        band = 0
        while self.edge(band + 1) <= size:
            band += 1
        return [band, band + 1] if self.den * size >= self.num * self.edge(band + 1) else [band]

    def sketch(self, found: np.ndarray, band: int) -> np.ndarray:
        """``found`` is sorted, so each block's shingles stand together."""
        blocks = self.blocks(band)
        at = ((found >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        bits = np.uint64(1) << (found & np.uint64(15)) | np.uint64(1) << (np.uint64(16) + (found >> np.uint64(8) & np.uint64(15)))
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        made = np.zeros(blocks, dtype=np.uint32)
        made[at[starts]] = np.bitwise_xor.reduceat(bits, starts)
        return made


@lru_cache(maxsize=1000)
def _edge(least: int, band: int) -> int:
    """Half as much again from band to band, so that a set can only be linked into the next one."""
    if not band:
        return least
    size = _edge(least, band - 1)
    return max(size + 1, size * 3 // 2)


def block_keys(sketch: np.ndarray, band: int) -> np.ndarray:
    """A join key for each block: its place and bits hashed, with the band in the low byte."""
    place = np.arange(1, sketch.shape[-1] + 1, dtype=np.uint64) * np.uint64(_BLOCK_MIX)
    return mixed(sketch.astype(np.uint64) ^ place) & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(band & 255)


def parity(sketch: np.ndarray) -> np.ndarray:
    """How many bits of each block's fuller half are set; of two sketches xor-ed, the shingles that differ at least."""
    return np.maximum(np.bitwise_count(sketch & np.uint32(0xFFFF)), np.bitwise_count(sketch >> np.uint32(16)))


def keys(sketch: np.ndarray, band: int, spare: int) -> np.ndarray:
    """The keys of all blocks but ``spare`` ones with the fewest bits; of as many bits, those with the smallest hashes.

    Blocks with few bits hold few shingles, or none, and are equal more often. Blocks that are equal have one place in
    that order in both sketches. Of two linked sets, the one whose first kept block stands higher leaves out fewer
    blocks than are equal, so it keeps an equal one, and the other does too, each by its own number of spare blocks.
    """
    made = block_keys(sketch, band)
    order = parity(sketch).astype(np.uint64) << np.uint64(59) | made >> np.uint64(5)
    return made[order >= np.partition(order, spare)[spare]]


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


_SKETCHES = pa.list_(pa.struct([("band", pa.int32()), ("words", pa.list_(pa.int64()))]))


def shingle_sets(docs: DataFrame, key: str, text: str, words: int, bands: Bands) -> DataFrame:
    """(key, n, digest, rid, sketches): size, identity and sketches of every document's set.

    rid is a short form of the digest. A task gives the sketches of equal sets once, and null with the others.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = narrow.select("key").schema.add("n", "long").add("digest", "binary").add("rid", "long")
    schema = schema.add(T.StructField("sketches", T.ArrayType(T.StructType().add("band", "integer").add("words", T.ArrayType(T.LongType())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, digests, sketches = [], [], []
                for value in batch.column(1):
                    s = shingles(value.as_py(), words)
                    digest = set_digest(s) if len(s) else None
                    sizes.append(len(s))
                    digests.append(digest)
                    if len(s) < bands.least or digest in seen:
                        sketches.append(None)
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(digest)
                    sketches.append([(band, bands.sketch(s, band).view(np.int64)) for band in bands.of(len(s))])
                rids = pa.array([None if d is None else _short(d) for d in digests], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), rids, pa.array(sketches, _SKETCHES)],
                    names=["key", "n", "digest", "rid", "sketches"],
                )

    return narrow.mapInArrow(run, schema)


def bucket_keys(sets: DataFrame, bands: Bands) -> DataFrame:
    """(bucket, rid) for the joined blocks of every sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sketches = batch.column(2).to_numpy(zero_copy_only=False)
                of = zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), sketches, strict=True)
                made = [keys(w.view(np.uint32), band, bands.spare(band, n)).view(np.int64) for band, n, w in of]
                if made:
                    rids = np.repeat(batch.column(0).to_numpy(), [len(k) for k in made])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made)), pa.array(rids)], names=["bucket", "rid"])

    return sets.select("rid", "n", F.explode("sketches").alias("s")).select("rid", "s.band", "s.words", "n").mapInArrow(run, "bucket long, rid long")


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket, rid, hub): rows of buckets with more than one set; the hub is the smallest rid.

    One shuffle; each task reads its sorted rows in a stream and holds one batch, however large a bucket is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, hub, last, told = None, None, None, False
        for batch in batches:
            b, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(b):
                continue
            new_bucket = np.concatenate(([bucket is None or b[0] != bucket], b[1:] != b[:-1]))
            new_row = new_bucket | np.concatenate(([last is None or r[0] != last], r[1:] != r[:-1]))
            first = np.maximum.accumulate(np.where(new_bucket, np.arange(len(b)), -1))
            hubs = np.where(first >= 0, r[first], hub if hub is not None else 0)
            member = new_row & ~new_bucket  # each further set of a bucket
            out_b, out_r, out_h = b[member], r[member], hubs[member]
            # the hub itself is told with the first of them, unless an earlier batch did
            starts = np.concatenate(([True], out_b[1:] != out_b[:-1])) if len(out_b) else np.zeros(0, dtype=bool)
            if len(out_b) and told and out_b[0] == bucket:
                starts[0] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((out_b, out_b[starts]))), pa.array(np.concatenate((out_r, out_h[starts]))), pa.array(np.concatenate((out_h, out_h[starts])))],
                names=["bucket", "rid", "hub"],
            )
            told = bool(len(out_b) and out_b[-1] == b[-1]) or (told and b[-1] == bucket)
            bucket, hub, last = b[-1], hubs[-1], r[-1]

    return buckets.repartition("bucket").sortWithinPartitions("bucket", "rid").mapInArrow(run, "bucket long, rid long, hub long")


def _bits(hashes: DataFrame, column: str) -> DataFrame:
    """(word, bits): a bit table that has the bit of every hash; of fixed size, 2^20 words at most."""
    place = F.shiftrightunsigned(column, 64 - _FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - _FILTER_BITS}) & 63 as int))")
    return hashes.select(F.shiftright(place, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def hash_bits(hashes: DataFrame, column: str) -> np.ndarray:
    """The bit table of a column of hashes (8 MB); others pass it too, which costs work only."""
    got = _bits(hashes, column).toArrow()
    table = np.zeros(1 << (_FILTER_BITS - 6), dtype=np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint64)


def in_bits(table: np.ndarray, rids: np.ndarray) -> np.ndarray:
    place = rids.view(np.uint64) >> np.uint64(64 - _FILTER_BITS)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def folded(sketch: np.ndarray) -> np.ndarray:
    """The low halves of a sketch's blocks with their longs laid on one another; they still differ in no more bits than
    shingles do. Three bits a block stay, or some less, so unlike sets differ in more than one, and linked ones in less."""
    bits = (sketch & np.uint32(0xFFFF)).astype(np.uint16)
    longs = max(_FOLDED, -(-len(bits) // _BLOCKS_A_LONG))
    padded = np.zeros(-(-len(bits) // (4 * longs)) * 4 * longs, dtype=np.uint16)
    padded[: len(bits)] = bits
    return np.bitwise_xor.reduce(padded.view(np.uint64).reshape(-1, longs), axis=0)


def asked_sketches(sets: DataFrame, rids: DataFrame, whole: bool = False) -> DataFrame:
    """(digest, rid, n, band, fold): the folded sketches of the sets whose rid is asked for, each once. With ``whole``,
    words in place of fold: the sketches as they are."""
    table = sets.sparkSession.sparkContext.broadcast(hash_bits(rids, "rid"))
    names = ["digest", "rid", "n", "band", "words" if whole else "fold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bits(table.value, batch.column(1).to_numpy())))
            made = batch.column(4)
            if not whole:
                made = pa.array([folded(w.view(np.uint32)).view(np.int64) for w in made.to_numpy(zero_copy_only=False)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], made], names=names)

    flat = sets.select("digest", "rid", "n", F.explode("sketches").alias("s")).select("digest", "rid", "n", "s.band", F.col("s.words").alias(names[4]))
    return flat.mapInArrow(run, flat.schema).join(rids, "rid", "left_semi").dropDuplicates(["rid", "digest", "band"]).select(*names)


def asked_sets(docs: DataFrame, text: str, words: int, rids: DataFrame) -> DataFrame:
    """(digest, shingles) of the sets whose rid is asked for, each once; reads the texts again."""
    table = docs.sparkSession.sparkContext.broadcast(hash_bits(rids, "rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows, held = [], 0
            for value in batch.column(0):
                s = shingles(value.as_py(), words)
                if not len(s) or (digest := set_digest(s)) in seen or not in_bits(table.value, np.frombuffer(digest[:8], dtype="<i8"))[0]:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(digest)
                rows.append((digest, _short(digest), s.view(np.int64)))
                held += 8 * len(s)
                if held > 16 << 20:
                    yield _sets_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _sets_batch(rows)

    made = docs.select(text).mapInArrow(run, "digest binary, rid long, shingles array<long>")
    return made.join(rids, "rid", "left_semi").dropDuplicates(["rid", "digest"]).select("digest", "shingles")


def _sets_batch(rows: list) -> pa.RecordBatch:
    digest, rid, sets = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(rid, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "rid", "shingles"])


def _flips(a: str, b: str, fields: list[list[int]]) -> Column:
    """At least so many shingles differ: the sum over longs and blocks of the bits that do in the fuller field."""

    def differ(x: Column, y: Column) -> Column:
        counts = [[F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(mask))) for mask in block] for block in fields]
        return sum((F.greatest(*c) if len(c) > 1 else c[0] for c in counts), F.lit(0))

    return F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda t, x: t + x)


def slices(rows: DataFrame, by: str, sketches: DataFrame) -> list[DataFrame]:
    """Staged ``rows`` by a hash of ``by`` in parts of bounded size, which go one after another; together they are all rows."""
    parts = -(-rows.count() // max(_SLICE_ROWS, _ROWS_A_SKETCH * sketches.count()))
    return [rows.where(F.pmod(F.xxhash64(by), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [rows]


def close_pairs(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """(a, b) rids → those whose sketches differ in no more bits than linked sets may, with their digests.

    Folded sketches, which are small, are compared first, and then the whole ones of the pairs that are left: only
    those are fetched from ``sets``.
    """

    def alike(both: DataFrame, bits: str, fields: list[list[int]]) -> DataFrame:
        return both.where(_flips(f"a_{bits}", f"b_{bits}", fields) * (bands.den + bands.num) <= (F.col("a_n") + F.col("b_n")) * (bands.den - bands.num))

    side = lambda x: sketches.select(*[F.col(c).alias(x if c == "rid" else f"{x}_{c}") for c in ("rid", "digest", "n", "band", "fold")])
    near = None
    for part in slices(pairs, "a", sketches):
        both = part.join(side("a"), "a").join(side("b"), "b").where("a_band = b_band and a_digest <> b_digest")
        found = alike(both, "fold", _FOLD_FIELDS).select("a", "b", "a_digest", "b_digest", "a_n", "b_n", F.col("a_band").alias("band"))
        near = stage(found, "near", into=near)
    rids = stage(near.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "rids")
    words = stage(asked_sketches(sets, rids, whole=True), "words")
    whole = lambda x: words.select("band", F.col("digest").alias(f"{x}_digest"), F.col("words").alias(f"{x}_words"))
    both = near.join(whole("a"), ["a_digest", "band"]).join(whole("b"), ["b_digest", "band"])
    close = stage(alike(both, "words", _BLOCK_FIELDS).select("a", "b", "a_digest", "b_digest").distinct(), "close")
    unstage(near, rids, words)
    return close


def verified(close: DataFrame, docs: DataFrame, text: str, words: int, bands: Bands) -> DataFrame:
    """Close pairs → (a, b) digests of those whose sets are linked."""
    rids = stage(close.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "rids")
    sets = stage(asked_sets(docs, text, words, rids), "shingles")
    unstage(rids)
    whole = lambda x: sets.select(F.col("digest").alias(f"{x}_digest"), F.col("shingles").alias(f"{x}_set"))
    both = close.join(whole("a"), "a_digest").join(whole("b"), "b_digest").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    linked = both.where(F.col("common") * bands.den >= (F.size("a_set") + F.size("b_set") - F.col("common")) * bands.num)
    linked = stage(linked.select(F.col("a_digest").alias("a"), F.col("b_digest").alias("b")), "links")
    unstage(sets)
    return linked


def open_pairs(rows: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """(bucket, rid, label), without hubs → pairs of one bucket with unequal labels whose folded sketches are close enough.

    Large buckets are cut into parts, and each pair of parts is one cell, so no task holds more than two parts. Only
    folds go to the cells: the whole sketches are for the few pairs that are left.
    """
    apart = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    cut = cells(rows.join(apart.select("bucket"), "bucket"), ["bucket"], "rid", CELL_ROWS).withColumn("band", F.col("bucket").bitwiseAND(F.lit(255)).cast("int"))
    cut = cut.join(sketches.select("rid", "n", "band", "fold"), ["rid", "band"]).select(*_CELL, "part", "rid", "label", "n", "fold")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in whole_groups(batches, _CELL):
            yield _pairs_batch(frame, bands)

    return cut.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(compare, "a long, b long").distinct()


def _pairs_batch(frame: pd.DataFrame, bands: Bands) -> pa.RecordBatch:
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    rids, labels, sizes, parts = (frame[c].to_numpy(np.int64) for c in ("rid", "label", "n", "part"))
    whole = (frame["i"] == frame["j"]).to_numpy()
    edges = group_edges(frame, _CELL) if len(frame) else []
    folds = frame["fold"].to_numpy()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo < 2 or (labels[lo:hi] == labels[lo]).all():
            continue
        fold = np.stack(folds[lo:hi]).view(np.uint64)  # of a negative number numpy counts the bits of its absolute value
        for x in range(hi - lo - 1):
            rest = slice(lo + x + 1, hi)
            apart = labels[rest] != labels[lo + x]
            if not whole[lo]:
                apart &= parts[rest] != parts[lo + x]
            others = np.flatnonzero(apart) + x + 1
            for at in range(0, len(others), 512):  # so many at a time hold little memory
                y = others[at : at + 512]
                flips = np.bitwise_count(fold[y] ^ fold[x]).sum(axis=1, dtype=np.int64)
                found = rids[lo + y[flips * (bands.den + bands.num) <= (sizes[lo + y] + sizes[lo + x]) * (bands.den - bands.num)]]
                left.append(np.minimum(found, rids[lo + x]))
                right.append(np.maximum(found, rids[lo + x]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def linked_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(key, n_shingles, group): documents whose shingle sets have Jaccard similarity num/den or more are linked, and
    group is the same for all that links connect; it is the smallest key among them. Exact, whatever the sizes.

    Equal sets are one set throughout. Sets sharing a bucket (an equal block of their sketches) are first tested
    with the bucket's hub; after that only other sets of a bucket that are still in different groups are compared, so
    a large group of copies costs as much as it has members, not pairs.

    A text that is null, empty or all white space has no shingle and a group of its own, which is its key; one with
    fewer words than a shingle is one shingle; repeated rows are copies; a null key is kept, but never names a group
    that has another key; an empty table gives no row. Other columns are not read.
    """
    bands = Bands(num, den)
    sets = stage(shingle_sets(docs, key, text, words, bands), "sets")
    shared = stage(shared_buckets(bucket_keys(sets, bands)), "shared")
    asked = stage(shared.select("rid").distinct(), "asked")
    sketches = stage(asked_sketches(sets, asked), "sketches")
    every = stage(sets.select("key", "n", "digest"), "every")
    unstage(asked)
    tested = stage(shared.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct(), "tested")
    close = close_pairs(tested, sketches, sets, bands)
    links = verified(close, docs, text, words, bands)
    roots = components(links, "a", "b")
    names = sketches.select("digest", "rid").distinct()
    labels = roots.join(names, F.col("node") == F.col("digest")).select("rid", "root")
    labels = labels.join(names.select("digest", F.col("rid").alias("label")), F.col("root") == F.col("digest")).select("rid", "label")
    rows = shared.where("rid <> hub").select("bucket", "rid").join(labels, "rid", "left").select("bucket", "rid", F.coalesce("label", "rid").alias("label"))
    rows = stage(rows, "labelled")
    unstage(shared, close)
    left = None
    for part in slices(rows, "bucket", sketches):
        left = stage(open_pairs(part, sketches, bands).join(tested, ["a", "b"], "left_anti"), "left", into=left)
    unstage(rows, tested)
    near = close_pairs(left, sketches, sets, bands)
    unstage(left, sketches, sets)
    if not near.isEmpty():
        roots = components(links.unionByName(verified(near, docs, text, words, bands)), "a", "b")
    named = every.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("key", "n", F.coalesce("root", "digest").alias("root"))
    names = named.where("root is not null").groupBy("root").agg(F.min("key").alias("group"))
    named = named.join(names, "root", "left")
    return named.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("group")).alias("group"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of ``linked_groups``, that with the smallest key; columns stay as they
    are. Of rows with the same key and text that whose JSON comes first stays. Documents without a shingle all stay.

    Only rows whose key is given up, or is there twice, are shuffled, and the few that a bit table of fixed size
    takes for such.
    """
    groups = stage(linked_groups(docs, key, text, **options).select(F.col(key).alias("k"), F.col(key).eqNullSafe(F.col("group")).alias("first")), "groups")
    touched = groups.groupBy("k").agg(F.count("*").alias("n"), F.max("first").alias("first")).where("n > 1 or not first").select("k", "first")
    touched = stage(touched, "touched")
    bits = _bits(touched.select(F.xxhash64("k").alias("hash")), "hash")
    held = docs.select(docs[key].alias("k"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(docs[key]).alias("hash"))
    place = F.shiftrightunsigned("hash", 64 - _FILTER_BITS)
    marked = held.join(F.broadcast(bits), F.shiftright(place, 6).cast("int") == F.col("word"), "left")
    maybe = F.coalesce(F.expr(f"shiftrightunsigned(bits, cast(shiftrightunsigned(hash, {64 - _FILTER_BITS}) & 63 as int)) & 1") == 1, F.lit(False))
    seen = marked.where(maybe).select("k", "doc").join(touched.withColumnRenamed("k", "t"), F.col("k").eqNullSafe(F.col("t")), "left")
    turn = F.row_number().over(Window.partitionBy("k", f"doc.`{text}`").orderBy(F.to_json("doc")))
    seen = seen.where("first or first is null").withColumn("turn", turn).where("turn = 1 or first is null")
    return marked.where(~maybe).select("doc.*").unionByName(seen.select("doc.*"))
