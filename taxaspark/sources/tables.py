"""Columnar tables and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from taxaspark.functions.vectors import finite_or_null

SEQUENCE_COLUMNS = ("species", "genus", "family", "order", "sequence", "lat", "lon", "process_id", "bin_uri")
SEQUENCE_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c in ("lat", "lon") else T.StringType()) for c in SEQUENCE_COLUMNS]
)
SPLIT_SCHEMA = T.StructType(
    [
        T.StructField("process_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("holdout_fraction", T.DoubleType()),
    ]
)


def write_sequences(df: DataFrame, path: str) -> None:
    df.select(*SEQUENCE_COLUMNS).write.mode("overwrite").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SEQUENCE_SCHEMA, "clean the raw records first")


def write_splits(splits: DataFrame, path: str) -> None:
    """One directory per held-out fraction, so a reader prunes to the one it wants."""
    splits.select("process_id", "role", "holdout_fraction").write.mode("overwrite").partitionBy(
        "holdout_fraction"
    ).parquet(path)


def read_splits(spark: SparkSession, path: str, fraction: float | None = None) -> DataFrame:
    splits = _read(spark, path, SPLIT_SCHEMA, "make the splits first")
    if fraction is None:
        return splits
    picked = splits.where(F.round(F.col("holdout_fraction") * 100) == round(fraction * 100))
    if not picked.take(1):
        raise FileNotFoundError(f"no split for fraction {fraction} at {path}")
    return picked


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType, hint: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"nothing at {path}; {hint}") from exc


def nullify_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    return df.select(
        *[
            finite_or_null(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_json_documents(df: DataFrame, path: str) -> None:
    nullify_non_finite(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv_table(df: DataFrame, path: str) -> None:
    nullify_non_finite(df).write.mode("overwrite").option("header", True).csv(path)


def fasta_lines(df: DataFrame, id_col: str = "process_id", seq_col: str = "sequence") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("value"))


def write_fasta(df: DataFrame, path: str) -> None:
    fasta_lines(df).write.mode("overwrite").text(path)
