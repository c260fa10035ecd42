"""Record projection, filters, dedupe and the cleaning funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.functions import text as X
from taxaspark.sources.tables import SEQUENCE_COLUMNS

REQUIRED = ("species", "genus", "family", "order", "sequence")
MIN_LENGTH, MAX_LENGTH, MAX_AMBIGUOUS = 500, 750, 0.01


def project_records(raw: DataFrame) -> DataFrame:
    """Raw records to the nine columns, alternates resolved."""
    lat, lon = X.coordinates()
    fields = {name: X.field(name) for name in X.FIELD_CANDIDATES} | {"lat": lat, "lon": lon}
    return raw.select(*[fields[c].alias(c) for c in SEQUENCE_COLUMNS])


def marker_filter(raw: DataFrame, marker: str | None) -> DataFrame:
    return raw if not marker else raw.where(X.marker() == marker)


def cap_records(raw: DataFrame, max_records: int | None, order_by: str = "process_id") -> DataFrame:
    """The configured pull cap; ordered, so that the same records come back every time."""
    return raw if max_records is None else raw.orderBy(order_by).limit(max_records)


def has_required():
    return X.all_true([F.col(c).isNotNull() & (F.col(c) != "") for c in REQUIRED])


def required_filter(df: DataFrame) -> DataFrame:
    return df.where(has_required())


def normalise_sequences(df: DataFrame) -> DataFrame:
    return df.withColumn("sequence", X.normalise_sequence(F.col("sequence")))


def _digest(*columns: str) -> list:
    """192 bits of some columns, as a number and a text of fixed size; different rows sharing them is taken to be impossible."""
    both = F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in columns])
    return [F.xxhash64(*columns), F.unhex(F.md5(both))]


def dedupe(df: DataFrame) -> DataFrame:
    """One row per (species, sequence): the smallest process_id, nulls last.

    Rows are dealt and sorted by a digest of the two, never by the sequence. The first row of each is picked before the
    shuffle as well as after it, so a sequence that makes up a third of the table sends one row per task.
    """
    rest = [c for c in df.columns if c not in ("species", "sequence", "process_id")]
    number, digest = _digest("species", "sequence")
    order = [F.col("process_id").asc_nulls_last(), *[F.col(c) for c in rest]]
    keyed = df.withColumn("_number", number).withColumn("_digest", digest)
    place = F.row_number().over(Window.partitionBy("_number", "_digest").orderBy(*order))
    return keyed.withColumn("_place", place).where("_place = 1").select(*df.columns)


def length_ok(min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH, sequence: Column | str = "sequence"):
    return F.length(sequence).between(min_length, max_length)


def ambiguity_ok(max_fraction: float = MAX_AMBIGUOUS, sequence: Column | str = "sequence"):
    return X.ambiguous_fraction(F.col(sequence) if isinstance(sequence, str) else sequence) <= max_fraction


def clean_rows(df: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH,
               max_ambiguous: float = MAX_AMBIGUOUS) -> DataFrame:
    """Required fields, normalise, dedupe, length band, ambiguity.

    The last two depend on the dedupe key only, so they run before the shuffle and give the
    same rows.
    """
    # A filter on the normalised text would normalise it once for each place it names it; this does so once in all.
    kept = F.filter(F.array(X.normalise_sequence(F.col("sequence"))), lambda s: length_ok(min_length, max_length, s) & ambiguity_ok(max_ambiguous, s))
    ready = required_filter(df).select(*[F.explode_outer(kept).alias(c) if c == "sequence" else c for c in df.columns])
    return dedupe(ready.where(F.col("sequence").isNotNull()))


def funnel_counts(df: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH,
                  max_ambiguous: float = MAX_AMBIGUOUS) -> DataFrame:
    """Rows left after each stage, in one pass and one shuffle."""
    ok = F.coalesce(has_required(), F.lit(False))
    ready = df.select(ok.alias("ok"), F.when(ok, F.col("species")).alias("species"), F.when(ok, X.normalise_sequence(F.col("sequence"))).alias("sequence"))
    band = F.col("ok") & length_ok(min_length, max_length)
    number, digest = _digest("species", "sequence")
    # What a group's rows have in common is decided before the shuffle, so neither text is in it.
    keyed = ready.select("ok", band.alias("band"), (band & ambiguity_ok(max_ambiguous)).alias("clear"), number.alias("number"), digest.alias("digest"))
    distinct = keyed.groupBy("ok", "band", "clear", "number", "digest").agg(F.count("*").alias("n"))
    return distinct.agg(
        F.sum("n").alias("n_raw"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("n_required"),
        F.count_if(F.col("ok")).alias("n_dedupe"),
        F.count_if(F.col("band")).alias("n_length"),
        F.count_if(F.col("clear")).alias("n_ambiguous"),
    )


def cardinalities(df: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count("*").alias("n_sequences"),
        distinct("species").alias("n_species"),
        distinct("genus").alias("n_genera"),
        distinct("family").alias("n_families"),
        distinct("order").alias("n_orders"),
    )


def clean_pasted_text(df: DataFrame, column: str) -> DataFrame:
    """A text column to a bare sequence plus an error tag and the offending characters."""
    seq = X.pasted_sequence(F.col(column))
    out = df.withColumn("sequence", seq)
    return out.withColumn("error", X.paste_error(F.col("sequence"))).withColumn(
        "invalid", X.invalid_bases(F.col("sequence"))
    )
