"""Report tables (J) and streams (K)."""

from __future__ import annotations


from taxaspark import RANKS
from taxaspark.catalog import classification as CL
from taxaspark.catalog.evaluation import _CURVE, KEYS, LOHO, calibrated, rounded_bins, specimen_long, specimen_test
from taxaspark.catalog.registry import query, r6, r9, scratch
from taxaspark.catalog.sql import bins
from taxaspark.catalog.tables_and_cleaning import RECORD_SQL, landed, records
from taxaspark.operators import calibration, metrics, reports
from taxaspark.operators import splits as P
from taxaspark.streaming import streams

LABEL = "CASE method WHEN 'ours' THEN 'ours' WHEN 'blast' THEN 'Similarity search' WHEN 'naive_bayes' THEN 'Naive Bayes' ELSE '1-NN' END"


@query("j1_reliability_rows", "SELECT rank, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 9) AS accuracy, count, round(ece, 6) AS ece FROM s_bins JOIN s_ece USING (rank) WHERE count > 0")
def j1(spark, sf_dir):
    out = reports.reliability_rows(calibration.report(specimen_test(spark, sf_dir), ["rank"]))
    return out.select("rank", r6("mean_confidence").alias("mean_confidence"), r9("accuracy").alias("accuracy"), "count", r6("ece").alias("ece"))


@query("j2_rebin_saved", "SELECT rank, bin_index, round(conf_low, 6) AS conf_low, round(conf_high, 6) AS conf_high, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 9) AS accuracy, count FROM five", five=bins("s_test", "rank", 5))
def j2(spark, sf_dir):
    """Saved wide predictions binned again, into five bins."""
    saved = calibration.held_out_table(CL.specimen_predictions(spark, sf_dir).where("split = 'test'"))
    return rounded_bins(calibration.reliability_bins(calibration.unpivot_saved(saved), ["rank"], 5), "rank")


@query("j3_preferred_reports", "SELECT rank, bin_index, count, round(ece, 6) AS ece FROM l_bins JOIN l_ece USING (rank)", **LOHO)
def j3(spark, sf_dir):
    job = calibrated(spark, sf_dir)
    raw = job["raw"]
    fixed = job["recalibrated"] if job["recalibrated"] is not None else raw.limit(0)
    return reports.preferred_reports(raw, fixed).select("rank", "bin_index", "count", r6("ece").alias("ece"))


def _curves(spark, sf_dir):
    return metrics.fcw_curve(P.evaluation_subsets(specimen_long(spark, sf_dir)), ["holdout_fraction", "subset", "method", "rank"])


def _rows(spark, sf_dir):
    return reports.fcw_rows(_curves(spark, sf_dir), 0.5, "species", "novel", ["ours", "blast", "nearest_neighbor"])


_PICKED = f"SELECT method, {LABEL} AS label, threshold, fcw FROM curve WHERE holdout_fraction=0.5::DOUBLE AND rank='species' AND subset='novel'"
_AT = "SELECT method, label, 0.13::DOUBLE AS threshold, max(v) AS fcw FROM (SELECT *, CASE WHEN threshold<=0.13 AND 0.13<nt THEN fcw+(nv-fcw)*(0.13::DOUBLE-threshold)/(nt-threshold) END AS v FROM (SELECT *, lead(threshold) OVER w AS nt, lead(fcw) OVER w AS nv FROM picked WINDOW w AS (PARTITION BY method ORDER BY threshold))) GROUP BY ALL"


@query("j4_fcw_rows", "SELECT method, label, round(threshold, 6) AS threshold, round(fcw, 9) AS fcw FROM picked", curve=_CURVE, picked=_PICKED)
def j4(spark, sf_dir):
    return _rows(spark, sf_dir).select("method", "label", r6("threshold").alias("threshold"), r9("fcw").alias("fcw"))


@query("j5_curve_at", "SELECT method, label, threshold, round(fcw, 6) AS fcw FROM at_t", curve=_CURVE, picked=_PICKED, at_t=_AT)
def j5(spark, sf_dir):
    return reports.curve_at(_rows(spark, sf_dir), 0.13).select("method", "label", "threshold", r6("fcw").alias("fcw"))


@query("j6_holdout_percents", "SELECT DISTINCT round_even(holdout_fraction*100, 0)::INT AS percent FROM s_preds")
def j6(spark, sf_dir):
    return reports.holdout_percents(specimen_long(spark, sf_dir))


_POINTS = "SELECT holdout_fraction, method, rank, avg((call IS NOT NULL)::INT) AS c, avg((call = truth)::INT) AS a FROM s_preds WHERE split='test' AND holdout_fraction=0.5::DOUBLE GROUP BY ALL"


@query(
    "j7_metric_bars",
    f"""SELECT method, {LABEL} AS label, metric, list_position({list(reports.METRICS)}, metric) AS metric_order, round(value, 9) AS value FROM (SELECT method, rank||' coverage' AS metric, c AS value FROM points UNION ALL SELECT method, rank||' accuracy', a FROM points) WHERE value IS NOT NULL""",
    points=_POINTS,
)
def j7(spark, sf_dir):
    scores = metrics.point_scores(specimen_long(spark, sf_dir).where("split = 'test'"), KEYS)
    return reports.metric_bars(reports.at_percent(scores, 50)).withColumn("value", r9("value"))


@query("j8_headline", "SELECT method, label, round(fcw, 6) AS fcw FROM at_t WHERE method='ours'", curve=_CURVE, picked=_PICKED, at_t=_AT)
def j8(spark, sf_dir):
    return reports.headline(reports.curve_at(_rows(spark, sf_dir), 0.13)).withColumn("fcw", r6("fcw"))


@query(
    "j9_relatives_table",
    "SELECT holdout_fraction, process_id, rn AS place, upper(rank[1])||rank[2:] AS taxon_rank, label, lin.genus AS genus, lin.family AS family, round(d, 6) AS distance, support FROM s_place WHERE rn <= 5 AND rank IN ('species', 'genus')",
)
def j9(spark, sf_dir):
    return reports.relatives_table(CL.specimen_predictions(spark, sf_dir)).withColumn("distance", r6("distance"))


@query(
    "j10_rank_states",
    f"""SELECT p.holdout_fraction, p.process_id, f.rank, CASE WHEN p.predicted_rank IS NULL THEN 'abyss' WHEN f.rank=p.predicted_rank THEN 'committed'
    WHEN list_position({list(RANKS)}, f.rank) < list_position({list(RANKS)}, p.predicted_rank) THEN 'skipped' ELSE 'abyss' END AS state,
    coalesce(CASE f.rank WHEN 'species' THEN species WHEN 'genus' THEN genus WHEN 'family' THEN family ELSE "order" END, f.label) AS taxon FROM s_pred p JOIN s_conf f USING (holdout_fraction, process_id)""",
)
def j10(spark, sf_dir):
    return reports.rank_states(CL.specimen_predictions(spark, sf_dir))


@query("j10_card_names", "SELECT p.holdout_fraction, p.process_id, coalesce(family, label) AS icon_family, coalesce(species, closest, genus, '') AS reference_taxon FROM s_pred p JOIN s_conf f USING (holdout_fraction, process_id) WHERE f.rank='family'")
def j10_cards(spark, sf_dir):
    return reports.card_names(CL.specimen_predictions(spark, sf_dir))


@query("k1_stream_ingest", f"SELECT {RECORD_SQL} FROM projected WHERE marker='COI-5P'")
def k1(spark, sf_dir):
    """The landing folder through the stream; the sink equals the batch path."""
    out = scratch(spark, "ingested")
    streams.ingest(spark, landed(spark, sf_dir), out, scratch(spark, "ingest-checkpoint")).awaitTermination()
    return records(spark.read.parquet(out))


def _streamed(spark, model, reads):
    """What the stream of ``reads``, written as files, leaves in its sink."""
    source, out = scratch(spark, "reads"), scratch(spark, "classified")
    reads.write.parquet(source)
    stream = spark.readStream.schema(reads.schema).parquet(source)
    streams.classify_stream(model, stream, out, scratch(spark, "classify-checkpoint")).awaitTermination()
    return CL.prediction_records(spark.read.parquet(out))


@query("k2_stream_classify", CL.DEPLOYED_SQL, **CL.DEPLOYED)
def k2(spark, sf_dir):
    """The deployed model over a stream of reads."""
    return _streamed(spark, CL.deployed(spark, sf_dir), CL.reads(spark, sf_dir))


@query("k2_sequence_stream", CL.SEQUENCES_SQL, **CL.SEQUENCES)
def k2_sequences(spark, sf_dir):
    """A stream of sequences, encoded and classified micro-batch by micro-batch."""
    return _streamed(spark, CL.deployed_sequences(spark, sf_dir), CL.sequence_reads(spark, sf_dir))
