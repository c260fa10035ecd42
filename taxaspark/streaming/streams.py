"""Incremental landing ingest and continuous classification; both stateless, both exactly once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from taxaspark.operators.cleaning import marker_filter, project_records
from taxaspark.plans.deployment import Deployment, classify
from taxaspark.sources.raw import RAW_SCHEMA


def landing_stream(spark: SparkSession, landing_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """New NDJSON files as they land; a malformed line stops the stream."""
    return (
        spark.readStream.schema(RAW_SCHEMA)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(landing_dir)
    )


def ingest(spark: SparkSession, landing_dir: str, out: str, checkpoint: str, marker: str | None = "COI-5P",
           every: str | None = None) -> StreamingQuery:
    """Marker filter and projection into a Parquet table; each file is read once. ``every``: see ``_triggered``."""
    rows = project_records(marker_filter(landing_stream(spark, landing_dir), marker))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def classify_stream(deployment: Deployment, reads: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Predictions of a streaming ``reads`` frame against the fitted model, whatever its size.

    Each micro-batch is classified like a table and replaces the folder of its number, so one that is run again after
    a failure leaves no row twice. The result is read as a table partitioned by ``batch``. The model's labels are
    measured, and broadcast where they are small enough, once for the whole stream.
    """
    deployment = replace(deployment, model=deployment.model.prepared())

    def write(rows: DataFrame, batch: int) -> None:
        classify(deployment, rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def _triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """``every``, such as "30 seconds", keeps the stream running; None takes what is there and ends."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
