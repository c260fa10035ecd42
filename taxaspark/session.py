"""Session defaults, shared scratch space and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A table is collected for broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "taxaspark", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="taxaspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/taxaspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application staged, once no frame built on it is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs now: it does so once the driver has collected their frames,
    which by itself it may not do for half an hour."""
    spark._jvm.System.gc()


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), into: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to shared scratch and read it back: lineage is cut, a lost executor costs nothing.

    With ``into``, a staged frame of the same columns, its rows are added to that one's, and both are read back.
    """
    path = scratch_path(df.sparkSession, name) if into is None else into._staged_path
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.mode("errorifexists" if into is None else "append").parquet(path)
    release_shuffles(df.sparkSession)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Delete what ``stage`` wrote for these frames, once every frame built on them has been written itself."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def task_count(spark: SparkSession) -> int:
    """Partitions for small inputs with costly rows; a plain repartition of them would be coalesced away."""
    return 2 * spark.sparkContext.defaultParallelism


def fits_broadcast(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * row_bytes <= limit
