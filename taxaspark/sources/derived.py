"""Record tables derived from the driver's text and vector tables.

The given tables hold no DNA, so whole document texts are re-spelled in the four bases and cut
into consecutive barcode-length pieces; nothing of a text is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base each letter A..Z is re-spelled as.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAN"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A table in one small file would keep one core busy; a large one has splits enough as it is.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("srcn"),
        F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), LETTERS, BASES).alias("dna"),
        (500 + F.col("doc_id") % 300).cast("int").alias("len"),
    )
    # One pass over a text, whatever its length.
    window = F.concat(F.lit(".{1,"), F.col("len"), F.lit("}"))
    pieces = F.regexp_extract_all("dna", window, F.lit(0))
    # The outer form is not given a filter that would spell and cut the text a second time.
    cut = docs.select("doc_id", "lang", "srcn", F.posexplode_outer(pieces).alias("piece", "sequence"))
    return cut.where(F.col("piece").isNotNull()).select(
        "doc_id",
        "piece",
        F.concat(F.lit("D"), F.col("doc_id"), F.lit("_"), F.col("piece")).alias("process_id"),
        F.concat("lang", F.lit("_s"), "srcn").alias("species"),
        F.concat("lang", F.lit("_g"), F.col("srcn") % 5).alias("genus"),
        F.concat("lang", F.lit("_f"), F.col("srcn") % 5 % 2).alias("family"),
        F.col("lang").alias("order"),
        "sequence",
        *_coords("doc_id"),
    )


def _coords(key: str):
    known = F.col(key) % 10 != 0
    return (
        F.when(known, ((F.col(key) * 37) % 180 - 90).cast("double")).alias("lat"),
        F.when(known, ((F.col(key) * 53) % 360 - 180).cast("double")).alias("lon"),
    )


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine-column record table, not yet cleaned."""
    from taxaspark.sources.tables import SEQUENCE_COLUMNS

    rows = _pieces(spark, sf_dir).withColumn("bin_uri", F.concat(F.lit("BIN:"), "species"))
    return rows.select(*SEQUENCE_COLUMNS)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records under raw field names, every one submitted twice.

    Names alternate by record number, some fields are empty, and the second submission is in
    lower case with blanks around it, so that filters, alternates and the dedupe all have work.
    """
    rows = _pieces(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    n = F.col("doc_id") + F.col("piece")

    def when(cond, value):
        return F.when(cond, value)

    seq = F.when(F.col("copy") == 1, F.concat(F.lit("\t "), F.lower("sequence"), F.lit(" \n"))).otherwise(F.col("sequence"))
    pid = F.concat(F.when(F.col("copy") == 1, F.lit("E")).otherwise(F.lit("")), "process_id")
    mark = F.when(n % 7 == 0, F.lit("16S")).otherwise(F.lit("COI-5P"))
    return rows.select(
        when(n % 3 != 0, F.col("species")).otherwise("").alias("species"),
        when(n % 3 == 0, F.col("species")).alias("species_name"),
        when(n % 11 != 0, F.col("genus")).otherwise("").alias("genus"),
        when(n % 13 != 0, F.col("family")).alias("family"),
        "order",
        when(n % 2 == 0, seq).alias("nuc"),
        when(n % 4 == 1, seq).otherwise("").alias("nucleotides"),
        when(n % 4 == 3, seq).alias("sequence"),
        when(n % 5 != 0, pid).alias("processid"),
        when(n % 5 == 0, pid).alias("process_id"),
        when(n % 2 == 0, F.concat(F.lit("BIN:"), "species")).otherwise("").alias("bin_uri"),
        F.concat(F.lit("BIN:"), "species").alias("bin"),
        when(n % 3 == 0, mark).otherwise("").alias("marker_code"),
        when(n % 3 != 0, mark).alias("marker"),
        when(n % 2 == 0, F.array("lat", "lon")).alias("coord"),
        F.coalesce("lat", F.lit(1.5)).alias("lat"),
        F.coalesce("lon", F.lit(2.5)).alias("lon"),
    )


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a given vector: taxonomy, coordinates and ``vec``."""
    emb = _table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("int"))

    def level(prefix, width):
        return F.concat(F.lit(prefix), F.floor(F.col("label") / width).cast("int"))

    return emb.select(
        F.concat(F.lit("V"), F.col("vec_id")).alias("process_id"),
        level("sp", 1).alias("species"),
        level("g", 2).alias("genus"),
        level("f", 4).alias("family"),
        level("o", 8).alias("order"),
        *_coords("vec_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def pasted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as a user would paste it: wrapped FASTA records, and whole documents as they are."""
    wrapped = F.regexp_replace(F.lower("sequence"), "(.{60})", "$1\n")
    fasta = barcodes(spark, sf_dir).select(
        F.col("process_id").alias("read_id"),
        F.concat(F.lit(">"), "process_id", F.lit(" read\n  "), wrapped, F.lit("\n\n")).alias("raw"),
    )
    docs = _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("T"), F.col("doc_id")).alias("read_id"), F.col("text").alias("raw")
    )
    return fasta.unionByName(docs)
