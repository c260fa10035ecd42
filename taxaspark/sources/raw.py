"""Raw record scans, the pull manifest and the chunked raw writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_TEXT_FIELDS = (
    "species", "species_name", "genus", "family", "order", "nuc", "nucleotides", "sequence",
    "processid", "process_id", "bin_uri", "bin", "marker_code", "marker",
)
RAW_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT_FIELDS]
    + [
        T.StructField("coord", T.ArrayType(T.DoubleType())),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]
)
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("api_base_url", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("extent", T.StringType()),
        T.StructField("marker_filter", T.StringType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("fetched_at_utc", T.StringType()),
        T.StructField("batch_size", T.LongType()),
        T.StructField("format", T.StringType()),
        T.StructField("max_records", T.LongType()),
        T.StructField("stopped_early_due_to_max_records", T.BooleanType()),
        T.StructField("total_records_kept", T.LongType()),
        T.StructField("batch_files", T.ArrayType(T.StringType())),
    ]
)


def read_ndjson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One object per line; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(RAW_SCHEMA).option("mode", "FAILFAST").json(path)


def read_array_batches(spark: SparkSession, files: list[str]) -> DataFrame:
    """Concatenate files that each hold one JSON array of records."""
    return spark.read.schema(RAW_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(files)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"no manifest at {path}; land a pull first") from exc


def manifest_files(manifest: DataFrame, root: str = "") -> DataFrame:
    """One row per batch file, with forward slashes and the root put in front."""
    front = F.lit(root.rstrip("/") + "/" if root else "")
    rel = manifest.select(F.explode("batch_files").alias("rel"))
    return rel.select(F.concat(front, F.replace("rel", F.lit("\\"), F.lit("/"))).alias("file"))


def read_raw_batches(spark: SparkSession, manifest_path: str, root: str = "") -> DataFrame:
    """All records of the files a manifest lists (the list, not a directory glob)."""
    listed = manifest_files(read_manifest(spark, manifest_path), root)
    # The file list is the only thing the driver reads, as any file scan does.
    return read_array_batches(spark, [r.file for r in listed.collect()])


def write_batches(records: DataFrame, path: str, batch_size: int = 1000) -> None:
    """NDJSON files of at most ``batch_size`` records; the data is never gathered to be cut.

    Files are compressed; none is so large that a reader would want to split it.
    """
    records.write.option("maxRecordsPerFile", batch_size).option("ignoreNullFields", True).option("compression", "gzip").json(path)


def write_array_batches(records: DataFrame, path: str, batch_size: int = 1000) -> None:
    """Compressed files that each hold one JSON array of at most ``batch_size`` records."""
    record = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    # mapInArrow sees bounded Arrow batches, so an array never outgrows batch_size records.
    lines = records.select(F.to_json(record).alias("value")).mapInArrow(_array_chunks(batch_size), "value string")
    lines.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _array_chunks(batch_size: int):
    def chunks(batches):
        import pyarrow as pa

        held: list[str] = []
        for batch in batches:
            for line in batch.column(0).to_pylist():
                held.append(line)
                if len(held) == batch_size:
                    yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])

    return chunks


def build_manifest(kept: DataFrame, batch_dir: str, *, query: str = "", extent: str = "full",
                   marker: str | None = None, batch_size: int = 1000,
                   max_records: int | None = None, fetched_at: str = "", query_id: str = "") -> DataFrame:
    """One row describing a pull; ``kept`` is the filtered, capped record table."""
    spark = kept.sparkSession
    listing = spark.read.format("binaryFile").load(batch_dir).select("path")
    files = listing.agg(F.array_sort(F.collect_list("path")).alias("batch_files"))
    cap = F.lit(max_records).cast("long")
    counted = kept.agg(F.count("*").alias("total_records_kept"))
    return counted.select(
        F.lit("record pull").alias("source"),
        F.lit("").alias("api_base_url"),
        F.lit(query).alias("query"),
        F.lit(extent).alias("extent"),
        F.lit(marker).cast("string").alias("marker_filter"),
        F.lit(query_id).alias("query_id"),
        F.lit(fetched_at).alias("fetched_at_utc"),
        F.lit(batch_size).cast("long").alias("batch_size"),
        F.lit("json").alias("format"),
        cap.alias("max_records"),
        F.coalesce(F.col("total_records_kept") >= cap, F.lit(False)).alias("stopped_early_due_to_max_records"),
        "total_records_kept",
        files.scalar().alias("batch_files"),
    )
