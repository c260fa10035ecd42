"""Landing → batches + manifest → cleaned source-of-truth table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.functions import text as X
from taxaspark.operators import cleaning as C
from taxaspark.sources import raw as R
from taxaspark.sources.tables import read_sequences, write_sequences


def pull(records: DataFrame, out_dir: str, manifest_path: str, *, marker: str | None = "COI-5P",
         max_records: int | None = None, batch_size: int = 1000, query: str = "", fetched_at: str = "") -> DataFrame:
    """Filter landed records, write them as array batches, and describe the pull. ``max_records`` caps them if asked to."""
    spark = records.sparkSession
    kept = C.marker_filter(records, marker)
    if max_records is not None:
        kept = kept.orderBy(X.field("process_id")).limit(max_records)
    R.write_array_batches(kept, out_dir, batch_size)
    stored = R.read_array_batches(spark, [out_dir])
    manifest = R.build_manifest(stored, out_dir, query=query, marker=marker, batch_size=batch_size,
                                max_records=max_records, fetched_at=fetched_at)
    manifest.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(manifest_path)
    return spark.read.schema(R.MANIFEST_SCHEMA).json(manifest_path)


def clean(spark: SparkSession, manifest_path: str, out_path: str, min_length: int = C.MIN_LENGTH,
          max_length: int = C.MAX_LENGTH, max_ambiguous: float = C.MAX_AMBIGUOUS, root: str = "") -> DataFrame:
    """The whole cleaning job, from manifest to Parquet."""
    rows = C.project_records(R.read_raw_batches(spark, manifest_path, root))
    write_sequences(C.clean_rows(rows, min_length, max_length, max_ambiguous), out_path)
    return read_sequences(spark, out_path)


def cleaning_summary(spark: SparkSession, manifest_path: str, cleaned: DataFrame, root: str = "") -> DataFrame:
    """Funnel counts beside the cardinalities of the result, one row."""
    rows = C.project_records(R.read_raw_batches(spark, manifest_path, root))
    totals = C.cardinalities(cleaned)
    totals = totals.select(F.struct(*totals.columns).alias("t")).scalar()
    return C.funnel_counts(rows).withColumn("t", totals).select("*", "t.*").drop("t")
