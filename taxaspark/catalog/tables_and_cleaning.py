"""Sources, sinks, cleaning, splitting (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaspark.catalog.registry import query, r9, scratch, shared
from taxaspark.catalog.sql import AMBIGUOUS
from taxaspark.functions import text as X
from taxaspark.operators import cleaning as C
from taxaspark.operators import splits as P
from taxaspark.plans import ingest
from taxaspark.session import stage
from taxaspark.sources import derived as D
from taxaspark.sources import raw as R
from taxaspark.sources import tables as T

RECORD = ("process_id", "species", "genus", "family", "order", "sequence", "lat", "lon", "bin_uri")
RECORD_SQL = 'process_id, species, genus, family, "order", md5(sequence) AS sequence_md5, lat, lon, bin_uri'


def records(df):
    """Nine columns with the sequence as its digest."""
    return df.select(*[c for c in RECORD if c != "sequence"], F.md5("sequence").alias("sequence_md5"))


def landed(spark, sf_dir) -> str:
    """Folder of NDJSON records, landed once per session."""

    def build():
        path = scratch(spark, "landing")
        R.write_batches(D.raw_records(spark, sf_dir), path, 1000)
        return path

    return shared(spark, sf_dir, "landing", build)


def pulled(spark, sf_dir) -> str:
    """Array batches of all records behind a manifest."""

    def build():
        path = scratch(spark, "pull")
        ingest.pull(R.read_ndjson(spark, landed(spark, sf_dir)), f"{path}/batches", f"{path}/manifest", marker=None,
                    max_records=None, batch_size=1000)
        return f"{path}/manifest"

    return shared(spark, sf_dir, "pull", build)


def cleaned_barcodes(spark, sf_dir):
    return shared(spark, sf_dir, "barcodes", lambda: stage(C.clean_rows(D.barcodes(spark, sf_dir)), "barcodes"))


def projected(spark, sf_dir):
    return C.project_records(D.raw_records(spark, sf_dir))


# --- A ---------------------------------------------------------------------------------------


@query("a1_raw_batch_scan", f"SELECT {RECORD_SQL} FROM projected")
def a1(spark, sf_dir):
    files = [r.file for r in R.manifest_files(R.read_manifest(spark, pulled(spark, sf_dir))).collect()]
    return records(C.project_records(R.read_array_batches(spark, files)))


@query("a2_ndjson_scan", f"SELECT {RECORD_SQL}, marker FROM projected")
def a2(spark, sf_dir):
    raw = R.read_ndjson(spark, landed(spark, sf_dir))
    lat, lon = X.coordinates()
    fields = {n: X.field(n) for n in X.FIELD_CANDIDATES} | {"lat": lat, "lon": lon, "marker": X.marker()}
    full = raw.select(*[v.alias(k) for k, v in fields.items()])
    return full.select(*[c for c in (*RECORD, "marker") if c != "sequence"], F.md5("sequence").alias("sequence_md5"))


@query("a3_manifest_read", "SELECT count(*) AS records, true AS all_forward FROM raw")
def a3(spark, sf_dir):
    """Files a manifest lists, counted by the records they hold."""
    files = R.manifest_files(R.read_manifest(spark, pulled(spark, sf_dir)))
    names = [r.file for r in files.collect()]
    return R.read_array_batches(spark, names).agg(
        F.count("*").alias("records"), F.lit(not any("\\" in n for n in names)).alias("all_forward")
    )


@query("a4_chunked_writer", "SELECT count(*) AS records, true AS within_batch FROM raw")
def a4(spark, sf_dir):
    path = scratch(spark, "chunks")
    R.write_batches(D.raw_records(spark, sf_dir), path, 250)
    per_file = R.read_ndjson(spark, path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("records"), (F.max("n") <= 250).alias("within_batch"))


@query(
    "a5_pull_manifest",
    "SELECT 'COI-5P' AS marker_filter, least(count(*), 1500)::BIGINT AS total_records_kept, count(*) >= 1500 AS stopped_early, 1500::BIGINT AS max_records FROM projected WHERE marker='COI-5P'",
)
def a5(spark, sf_dir):
    path = scratch(spark, "capped")
    manifest = ingest.pull(R.read_ndjson(spark, landed(spark, sf_dir)), f"{path}/batches", f"{path}/manifest", max_records=1500)
    return manifest.select("marker_filter", "total_records_kept", F.col("stopped_early_due_to_max_records").alias("stopped_early"), "max_records")


@query("a6_parquet_table", f"SELECT {RECORD_SQL} FROM barcodes")
def a6(spark, sf_dir):
    path = scratch(spark, "sequences")
    T.write_sequences(D.barcodes(spark, sf_dir), path)
    return records(T.read_sequences(spark, path))


@query("a7_split_store", "SELECT process_id, split AS role, 0.5::DOUBLE AS holdout_fraction FROM s_rows WHERE holdout_fraction=0.5::DOUBLE")
def a7(spark, sf_dir):
    path = scratch(spark, "splits")
    T.write_splits(P.make_splits(D.specimens(spark, sf_dir)), path)
    return T.read_splits(spark, path, 0.5)


@query(
    "a10_non_finite_to_null",
    "SELECT process_id, CASE WHEN lat IS NULL OR lat > 60 OR lat < -60 THEN NULL ELSE lat END AS a, CASE WHEN lon > 0 THEN lon END AS b FROM specimens",
)
def a10(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    noisy = D.specimens(spark, sf_dir).select(
        "process_id",
        F.when(lat.isNull(), F.lit(float("nan"))).when(lat > 60, F.lit(float("inf"))).when(lat < -60, F.lit(float("-inf"))).otherwise(lat).alias("a"),
        F.when(lon > 0, lon).otherwise(F.lit(float("nan"))).alias("b"),
    )
    return T.nullify_non_finite(noisy)


@query("a11_fasta_export", "SELECT md5('>'||process_id||chr(10)||sequence) AS record_md5 FROM barcodes")
def a11(spark, sf_dir):
    path = scratch(spark, "fasta")
    T.write_fasta(D.barcodes(spark, sf_dir), path)
    text = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    return text.select(F.md5(F.concat(F.lit(">"), F.rtrim(F.regexp_replace("value", "\n$", "")))).alias("record_md5"))


# --- B ---------------------------------------------------------------------------------------


@query("b1_first_present", "SELECT species, process_id, bin_uri, md5(sequence) AS sequence_md5 FROM projected")
def b1(spark, sf_dir):
    raw = D.raw_records(spark, sf_dir)
    return raw.select(X.field("species").alias("species"), X.field("process_id").alias("process_id"),
                      X.field("bin_uri").alias("bin_uri"), F.md5(X.field("sequence")).alias("sequence_md5"))


@query("b2_coordinates", "SELECT process_id, lat, lon FROM projected")
def b2(spark, sf_dir):
    lat, lon = X.coordinates()
    return D.raw_records(spark, sf_dir).select(X.field("process_id").alias("process_id"), lat.alias("lat"), lon.alias("lon"))


@query("b3_projection", f"SELECT {RECORD_SQL} FROM projected")
def b3(spark, sf_dir):
    return records(projected(spark, sf_dir))


@query("b4_marker_filter", "SELECT process_id, marker FROM projected WHERE marker='COI-5P'")
def b4(spark, sf_dir):
    kept = C.marker_filter(D.raw_records(spark, sf_dir), "COI-5P")
    return kept.select(X.field("process_id").alias("process_id"), X.marker().alias("marker"))


@query("b5_record_cap", "SELECT process_id, species FROM projected WHERE marker='COI-5P' ORDER BY process_id LIMIT 500")
def b5(spark, sf_dir):
    kept = C.marker_filter(D.raw_records(spark, sf_dir), "COI-5P")
    return C.cap_records(C.project_records(kept), 500).select("process_id", "species")


@query("b6_required_fields", f"SELECT {RECORD_SQL} FROM required")
def b6(spark, sf_dir):
    return records(C.required_filter(projected(spark, sf_dir)))


@query("b7_normalise_sequence", "SELECT process_id, md5(sequence) AS sequence_md5, length(sequence) AS n FROM normal")
def b7(spark, sf_dir):
    rows = C.normalise_sequences(C.required_filter(projected(spark, sf_dir)))
    return rows.select("process_id", F.md5("sequence").alias("sequence_md5"), F.length("sequence").alias("n"))


@query("b8_dedupe", f"SELECT {RECORD_SQL} FROM deduped")
def b8(spark, sf_dir):
    return records(C.dedupe(C.normalise_sequences(C.required_filter(projected(spark, sf_dir)))))


@query("b9_length_band", "SELECT process_id, length(sequence) AS n FROM barcodes WHERE length(sequence) BETWEEN 500 AND 750")
def b9(spark, sf_dir):
    return D.barcodes(spark, sf_dir).where(C.length_ok()).select("process_id", F.length("sequence").alias("n"))


@query("b10_ambiguous_fraction", f"SELECT process_id, round({AMBIGUOUS.format('sequence')}, 9) AS ambiguous, {AMBIGUOUS.format('sequence')} <= 0.01 AS kept FROM barcodes")
def b10(spark, sf_dir):
    return D.barcodes(spark, sf_dir).select("process_id", r9(X.ambiguous_fraction(F.col("sequence"))).alias("ambiguous"), C.ambiguity_ok().alias("kept"))


@query(
    "b11_funnel_counts",
    "SELECT (SELECT count(*) FROM projected) AS n_raw, (SELECT count(*) FROM required) AS n_required, (SELECT count(*) FROM deduped) AS n_dedupe, "
    "(SELECT count(*) FROM banded) AS n_length, (SELECT count(*) FROM cleaned) AS n_ambiguous",
)
def b11(spark, sf_dir):
    return C.funnel_counts(projected(spark, sf_dir))


@query(
    "b12_cardinalities",
    'SELECT count(*) AS n_sequences, count(DISTINCT species) AS n_species, count(DISTINCT genus) AS n_genera, count(DISTINCT family) AS n_families, count(DISTINCT "order") AS n_orders FROM clean',
)
def b12(spark, sf_dir):
    return C.cardinalities(C.clean_rows(D.barcodes(spark, sf_dir)))


@query(
    "b13_pasted_text",
    r"""SELECT read_id, md5(seq) AS sequence_md5, CASE WHEN seq='' THEN 'empty' WHEN regexp_replace(seq,'[ACGTN]','','g')<>'' THEN 'invalid_chars' END AS error, length(seq) AS n
    FROM joined""",
    pasted=r"""SELECT process_id AS read_id, '>'||process_id||' read'||chr(10)||'  '||regexp_replace(lower(sequence), '(.{60})', '\1'||chr(10), 'g')||chr(10)||chr(10) AS raw_text FROM barcodes
    UNION ALL SELECT 'T'||doc_id, text FROM documents""",
    joined=r"""SELECT read_id, regexp_replace(upper(replace(array_to_string(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x<>'' AND NOT starts_with(x, '>')), ''), 'ß', 'SS')), '\s', '', 'g') AS seq FROM pasted""",
)
def b13(spark, sf_dir):
    out = C.clean_pasted_text(D.pasted_texts(spark, sf_dir), "raw")
    return out.select("read_id", F.md5("sequence").alias("sequence_md5"), "error", F.length("sequence").alias("n"))


@query("b14_cleaning_job", f"SELECT {RECORD_SQL} FROM cleaned")
def b14(spark, sf_dir):
    return records(ingest.clean(spark, pulled(spark, sf_dir), scratch(spark, "cleaned")))


# --- C ---------------------------------------------------------------------------------------


@query("c1_held_out_genera", "SELECT holdout_fraction, genus FROM c_held")
def c1(spark, sf_dir):
    return P.held_out_genera(cleaned_barcodes(spark, sf_dir))


@query("c2_held_out_rows", "SELECT s.holdout_fraction, s.process_id, h.genus IS NOT NULL AS held FROM s_spread s LEFT JOIN s_held h USING (holdout_fraction, genus)")
def c2(spark, sf_dir):
    rows = D.specimens(spark, sf_dir)
    spread, held = P.with_fractions(rows), P.held_out_genera(rows)
    test = P.held_out_rows(spread, held).select("holdout_fraction", "process_id", F.lit(True).alias("held"))
    return test.unionByName(P.seen_rows(spread, held).select("holdout_fraction", "process_id", F.lit(False).alias("held")))


@query("c3_validation_sample", "SELECT holdout_fraction, process_id, split='val' AS taken FROM s_rows WHERE split<>'test'")
def c3(spark, sf_dir):
    rows = D.specimens(spark, sf_dir)
    seen = P.seen_rows(P.with_fractions(rows), P.held_out_genera(rows))
    return P.validation_sample(seen).select("holdout_fraction", "process_id", "taken")


@query(
    "c4_split_metadata",
    """SELECT holdout_fraction, 'genus' AS unit, 42 AS seed, 0.15::DOUBLE AS val_fraction, count(DISTINCT genus) AS n_genera_total,
    count(DISTINCT CASE WHEN split='test' THEN genus END) AS n_genera_held_out, count(*) FILTER (split='train') AS n_train,
    count(*) FILTER (split='val') AS n_val, count(*) FILTER (split='test') AS n_test FROM s_rows GROUP BY ALL""",
)
def c4(spark, sf_dir):
    rows = D.specimens(spark, sf_dir)
    return P.split_metadata(rows, P.make_splits(rows))


@query("c5_all_splits", "SELECT holdout_fraction, process_id, split AS role FROM c_rows")
def c5(spark, sf_dir):
    return P.make_splits(cleaned_barcodes(spark, sf_dir))


@query("c6_rows_by_id", f"SELECT {RECORD_SQL} FROM c_rows WHERE holdout_fraction=0.3::DOUBLE AND split='val'")
def c6(spark, sf_dir):
    rows = cleaned_barcodes(spark, sf_dir)
    ids = P.make_splits(rows, (0.3,)).where("role = 'val'")
    return records(P.rows_by_id(rows, ids, check=True))


@query(
    "c7_random_split",
    "SELECT process_id, CASE WHEN rn <= ceil(n*0.15::DOUBLE) THEN 'val' ELSE 'train' END AS role FROM (SELECT process_id, row_number() OVER (ORDER BY md5('42|'||process_id), process_id) rn, count(*) OVER () n FROM clean)",
)
def c7(spark, sf_dir):
    return P.random_split(cleaned_barcodes(spark, sf_dir)).select("process_id", "role")


@query("c8_training_cap", "SELECT process_id FROM clean ORDER BY md5('42|'||process_id), process_id LIMIT 300")
def c8(spark, sf_dir):
    return P.cap_rows(cleaned_barcodes(spark, sf_dir), 300).select("process_id")


@query(
    "c9_evaluation_subsets",
    "SELECT subset, holdout_fraction, count(*) AS n, count(DISTINCT process_id) AS n_ids FROM (SELECT 'all' AS subset, * FROM s_rows WHERE split<>'train' UNION ALL SELECT 'novel', * FROM s_rows WHERE split='test') GROUP BY ALL",
)
def c9(spark, sf_dir):
    rows = P.split_rows(D.specimens(spark, sf_dir), P.make_splits(D.specimens(spark, sf_dir))).withColumnRenamed("role", "split")
    return P.evaluation_subsets(rows).groupBy("subset", "holdout_fraction").agg(
        F.count("*").alias("n"), F.count_distinct("process_id").alias("n_ids")
    )
