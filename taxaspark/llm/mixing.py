"""Mix sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.rows import positions
from taxaspark.session import stage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) → with weight and target.

    Weights repeat over the sources by code point, null last. Targets divide ``share`` of all sizes by weight; none
    goes above ``most`` times its source's size, and what is cut off is shared again until none is above. Only
    sums come to the driver, so any number of sources does.
    """
    placed = positions(sizes, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = stage(placed.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    per_weight, capped_before = 0.0, -1
    while True:
        capped = F.col("cap") <= per_weight * F.col("weight")
        cut, held, left = placed.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if cut == capped_before or not left:
            break
        per_weight, capped_before = (share * total - held) / left, cut
    return placed.select("source", "source_size", "weight", F.least("cap", per_weight * F.col("weight")).alias("target"))


def sample_copies(rows: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """(row key …, source, size) → with source_size, target and copies.

    Every document of a source expects target / source_size copies. Their prefix sum runs over the source's
    documents from short to long, so each stretch of sizes gets its share; one offset per source, from a hash of
    seed and source, is added, and a document is emitted once per whole number that the sum crosses on it.
    """
    tied = [F.col(c) for c in rows.columns if c not in ("source", "size")]
    placed = positions(rows, ["source"], [F.col("size"), *tied], "place")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("of"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rates = targets.select(F.col("source").alias("of"), "source_size", "target").select(
        "*", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset")
    )
    crossed = F.floor((F.col("place") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("place") * F.col("rate") + F.col("offset"))
    copies = F.least(F.greatest(crossed, F.floor("rate")), F.ceil("rate"))  # rounding cannot add a copy
    joined = placed.join(rates, F.col("source").eqNullSafe(F.col("of")))
    return joined.select(*rows.columns, "source_size", "target", copies.cast("long").alias("copies"))


def sized(docs: DataFrame, key: str, source: str = "source", text: str = "text") -> DataFrame:
    """Narrow rows, written once: the only pass over the texts."""
    return stage(docs.select(F.col(key).alias("row"), F.monotonically_increasing_id().alias("line"), F.col(source).alias("source"), word_count(text).alias("size")), "sized")


def targets_of(rows: DataFrame, **options) -> DataFrame:
    return stage(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **options), "targets")


def mix(docs: DataFrame, source: str = "source", text: str = "text", seed: str = "mix", **options) -> DataFrame:
    """``docs`` with every row repeated or left out so that sources reach their targets (see ``source_targets``).

    Columns and their names stay as they are. A null text counts no word and is taken at its source's rate like
    any other; a null source is a source; equal rows are sampled one by one; an empty table stays empty. Which rows come
    out depends on the rows alone, not on their order or partitions.
    """
    tagged = stage(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[source].alias("source"), word_count(docs[text]).alias("size"), F.monotonically_increasing_id().alias("row")), "tagged")
    # Rows of a size are ordered by what is in them, so that the sample does not depend on how they are dealt.
    rows = tagged.select(F.md5(F.to_json("doc")).alias("content"), "row", "source", "size")
    taken = sample_copies(rows, targets_of(rows, **options), seed).where("copies > 0").select("row", "copies")
    out = tagged.select("row", "doc").join(taken, "row")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
