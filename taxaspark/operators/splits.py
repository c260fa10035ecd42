"""Seeded sampling, clade-exclusion splits and id lookups.

Every draw is by order of md5(seed | id): the same on any partitioning and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark import FRACTIONS
from taxaspark.session import stage

SEED = 42
VAL_FRACTION = 0.15
_PREFIX = 3  # hex digits: 4,096 buckets per group


def hash_key(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c) for c in cols]))


def _spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rank range that each hash-prefix bucket covers within its group (≤ 4,096 rows a group)."""
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    group = [F.col(k) for k in keys] or [F.lit(0)]
    running = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sizes.withColumn("_end", F.sum("_n").over(running))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    )


def _bucketed(df: DataFrame, seed: int, ids: list[str]) -> DataFrame:
    return df.withColumn("_hash", hash_key(seed, *ids)).withColumn("_bucket", F.substring("_hash", 1, _PREFIX))


def _with_spans(df: DataFrame, keys: list[str], seed: int, ids: list[str]) -> DataFrame:
    rows = _bucketed(df, seed, ids)
    spans = _spans(rows, keys)
    match = F.col("r._bucket") == F.col("s._bucket")
    for k in keys:
        match = match & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    return rows.alias("r").join(spans.alias("s"), match).select(
        "r.*", F.col("s._start"), F.col("s._end"), F.col("s._total")
    )


def hash_rank(df: DataFrame, keys: list[str], seed: int, ids: list[str], name: str) -> DataFrame:
    """0-based rank in hash order within ``keys``; ranked per (group, bucket), so no task sorts a hot group."""
    within = Window.partitionBy(*[F.col(k) for k in keys], F.col("_bucket")).orderBy("_hash", *ids)
    ranked = _with_spans(df, keys, seed, ids).withColumn(
        name, F.col("_start") + F.row_number().over(within) - 1
    )
    return ranked.withColumn(f"{name}_of", F.col("_total")).drop("_hash", "_bucket", "_start", "_end", "_total")


def _cuts(rows: DataFrame, keys: list[str], quota) -> DataFrame:
    """One row per group: the bucket its quota ends in, and how many rows of that bucket belong."""
    spans = _spans(rows, keys).withColumn("_quota", quota(F.col("_total")))
    reached = F.when(F.col("_end") >= F.col("_quota"), F.struct("_bucket", (F.col("_quota") - F.col("_start")).alias("left")))
    found = spans.groupBy(*keys).agg(F.max("_quota").alias("_quota"), F.min(reached).alias("_at"))
    # Below any hash prefix when nothing is wanted, above all of them when everything is.
    bucket = F.when(F.col("_quota") <= 0, F.lit("")).otherwise(F.coalesce("_at._bucket", F.lit("~")))
    return found.select(*keys, bucket.alias("_cut"), F.coalesce("_at.left", F.lit(0)).alias("_left"))


def hash_take(df: DataFrame, keys: list[str], seed: int, ids: list[str], quota) -> DataFrame:
    """Flag ``taken`` the first ``quota(total)`` rows of each group in hash order.

    The cut is one row per group, written out so that its size is known: while it is small the
    rows are not shuffled at all. Only the bucket a quota ends in is sorted.
    """
    rows = _bucketed(df, seed, ids)
    cuts = stage(_cuts(rows, keys, quota), "cuts")
    if keys:
        match = None
        for k in keys:
            same = F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
            match = same if match is None else match & same
        placed = rows.alias("r").join(cuts.alias("c"), match).select("r.*", "c._cut", "c._left")
    else:
        only = cuts.first()  # a single row, none for an empty table
        placed = rows.withColumns({"_cut": F.lit(only[0] if only else ""), "_left": F.lit(only[1] if only else 0)})
    within = Window.partitionBy(*[F.col(k) for k in keys], F.col("_bucket")).orderBy("_hash", *ids)
    whole = placed.where(F.col("_bucket") != F.col("_cut")).withColumn("taken", F.col("_bucket") < F.col("_cut"))
    border = placed.where(F.col("_bucket") == F.col("_cut")).withColumn("taken", F.row_number().over(within) <= F.col("_left"))
    return whole.unionByName(border).drop("_hash", "_bucket", "_cut", "_left")


def with_fractions(df: DataFrame, fractions=FRACTIONS) -> DataFrame:
    """Repeat each row per held-out fraction."""
    return df.withColumn("holdout_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))


def held_out_genera(df: DataFrame, fractions=FRACTIONS, seed: int = SEED, unit: str = "genus") -> DataFrame:
    """(holdout_fraction, genus) of the genera set aside; the count rounds half to even."""
    if unit != "genus":
        raise NotImplementedError(f"only genus-level holdout is implemented, got unit={unit!r}")
    genera = with_fractions(df.select("genus").distinct(), fractions)
    quota = lambda total: F.bround(total * F.col("holdout_fraction"), 0)
    return hash_take(genera, ["holdout_fraction"], seed, ["genus"], quota).where("taken").drop("taken")


def mark_held_out(df: DataFrame, held_out: DataFrame) -> DataFrame:
    """Rows per fraction with a ``held`` flag; the genus list is a small lookup."""
    fractions = held_out.select("holdout_fraction", "genus", F.lit(True).alias("held"))
    return df.join(fractions, ["holdout_fraction", "genus"], "left").withColumn(
        "held", F.coalesce("held", F.lit(False))
    )


def held_out_rows(df: DataFrame, held_out: DataFrame) -> DataFrame:
    return df.join(held_out, ["holdout_fraction", "genus"], "left_semi")


def seen_rows(df: DataFrame, held_out: DataFrame) -> DataFrame:
    return df.join(held_out, ["holdout_fraction", "genus"], "left_anti")


def validation_sample(seen: DataFrame, val_fraction: float = VAL_FRACTION, seed: int = SEED,
                      also_by: list[str] | None = None) -> DataFrame:
    """Flag floor(n * fraction) rows of each species ``taken``; a species with one row keeps it."""
    quota = lambda total: F.when(total >= 2, F.floor(total * F.lit(float(val_fraction)))).otherwise(F.lit(0))
    return hash_take(seen, ["holdout_fraction", "species", *(also_by or [])], seed, ["process_id"], quota)


def assign_roles(df: DataFrame, fractions=FRACTIONS, seed: int = SEED, val_fraction: float = VAL_FRACTION,
                 unit: str = "genus") -> DataFrame:
    """Every row once per fraction with its ``role``: held-out genera test, the rest train or val.

    The rows meet small tables only (genus list, bucket spans), so they are not shuffled by id.
    """
    held = stage(held_out_genera(df, fractions, seed, unit), "held-out")  # a genus list
    marked = mark_held_out(with_fractions(df, fractions), held)
    sampled = validation_sample(marked, val_fraction, seed, ["held"])
    role = F.when(F.col("held"), "test").when(F.col("taken"), "val").otherwise("train")
    return sampled.withColumn("role", role).drop("held", "taken")


def make_splits(df: DataFrame, fractions=FRACTIONS, seed: int = SEED, val_fraction: float = VAL_FRACTION,
                unit: str = "genus") -> DataFrame:
    """(holdout_fraction, process_id, role): the split table that is saved and read back."""
    rows = df.select("process_id", "species", "genus")
    return assign_roles(rows, fractions, seed, val_fraction, unit).select("holdout_fraction", "process_id", "role")


def split_metadata(df: DataFrame, splits: DataFrame, fractions=FRACTIONS, seed: int = SEED,
                   val_fraction: float = VAL_FRACTION) -> DataFrame:
    """One row per fraction: settings, genus counts and role counts."""
    genera = with_fractions(df.select("genus").distinct(), fractions)
    held = held_out_genera(df, fractions, seed).withColumn("held", F.lit(1))
    counts = genera.join(held, ["holdout_fraction", "genus"], "left").groupBy("holdout_fraction").agg(
        F.count("*").alias("n_genera_total"), F.count("held").alias("n_genera_held_out")
    )
    roles = splits.groupBy("holdout_fraction").agg(
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "val", "test")]
    )
    return counts.join(roles, "holdout_fraction").withColumns(
        {"unit": F.lit("genus"), "seed": F.lit(seed), "val_fraction": F.lit(float(val_fraction))}
    )


def rows_by_id(df: DataFrame, ids: DataFrame, check: bool = False) -> DataFrame:
    """Rows whose process_id is listed; with ``check`` an unknown id raises."""
    if check and ids.join(df.select("process_id"), "process_id", "left_anti").take(1):
        raise KeyError("ids without a row")
    return df.join(ids.select("process_id"), "process_id", "left_semi")


def split_rows(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of every fraction with their role, one row per (fraction, process_id)."""
    return df.join(splits, "process_id")


def random_split(df: DataFrame, val_fraction: float = VAL_FRACTION, seed: int = SEED) -> DataFrame:
    """``role`` val for exactly ceil(n * fraction) rows, train for the rest."""
    quota = lambda total: F.ceil(total * F.lit(float(val_fraction)))
    taken = hash_take(df, [], seed, ["process_id"], quota)
    return taken.withColumn("role", F.when(F.col("taken"), "val").otherwise("train")).drop("taken")


def cap_rows(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """At most ``n`` rows without replacement (the reference's training-size setting)."""
    return df.orderBy(hash_key(seed, "process_id"), "process_id").limit(n)


def evaluation_subsets(predictions: DataFrame) -> DataFrame:
    """`all` = val and test, `novel` = test only; a bag union."""
    labels = F.when(F.col("split") == "test", F.array(F.lit("all"), F.lit("novel"))).otherwise(F.array(F.lit("all")))
    return predictions.where(F.col("split").isin("val", "test")).withColumn("subset", F.explode(labels))
