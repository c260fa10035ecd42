"""Scores (H) and calibration (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaspark import METHODS, RANKS
from taxaspark.catalog.baselines import NB, NB_K, SEGMENTS, barcode_split, specimen_neighbor_calls
from taxaspark.catalog.classification import CLASSIFIER, specimen_classifier, specimen_predictions, specimen_rows
from taxaspark.catalog.features import K2
from taxaspark.catalog.registry import query, r6, r9, scratch, shared
from taxaspark.catalog.sql import bins, fallback_of, neighbours_of
from taxaspark.operators import calibration, classifier, isotonic, metrics
from taxaspark.operators import splits as P
from taxaspark.operators.predictions import long_form
from taxaspark.plans import evaluation as E
from taxaspark.session import stage
from taxaspark.sources import tables as T


def specimen_long(spark, sf_dir):
    """Long predictions of the cascade and of the nearest neighbour, on given vectors."""

    def build():
        ours = long_form(specimen_predictions(spark, sf_dir), "ours")
        return stage(ours.unionByName(long_form(specimen_neighbor_calls(spark, sf_dir), "nearest_neighbor")), "specimen-long")

    return shared(spark, sf_dir, "specimen-long", build)


def specimen_test(spark, sf_dir):
    """The cascade's held-out rows with the correctness of the nearest label."""
    return calibration.correctness(specimen_long(spark, sf_dir).where("method = 'ours' AND split = 'test'"))


def four_methods(spark, sf_dir):
    """Long predictions of all methods over cleaned barcodes."""

    def build():
        return E.system_predictions(encoded_barcodes(spark, sf_dir), nb_k=NB_K)

    return shared(spark, sf_dir, "four-methods", build)


def encoded_barcodes(spark, sf_dir):
    """Split barcodes under the full-rank encoder, whose distances are those of the raw frequencies."""
    return shared(spark, sf_dir, "encoded", lambda: E.encode_splits(barcode_split(spark, sf_dir), "kmer_pca", k=2, n_components=16))


METHOD_SQL = (
    K2
    | {"q_rows": "SELECT r.*, d.vec FROM b_rows r JOIN dense2 d USING (process_id)"}
    | fallback_of("q_rows", 16, "q_")
    | neighbours_of("q_rows", "q_")
    | NB
    | SEGMENTS
    | {
        "nb_conf": """SELECT c.holdout_fraction, c.process_id, sum(p.p) FILTER (p.species=c.species) AS c1, sum(p.p) FILTER (p.genus=c.genus) AS c2, sum(p.p) FILTER (p.family=c.family) AS c3,
            sum(p.p) FILTER (p."order"=c."order") AS c4 FROM nb_call c JOIN nb_post p USING (holdout_fraction, process_id) GROUP BY ALL""",
        "q_bayes": """SELECT 'naive_bayes' AS method, holdout_fraction, r.split, process_id, unnest(['species','genus','family','order']) AS rank,
            unnest([r.species, r.genus, r.family, r."order"]) AS truth, unnest([c.species, c.genus, c.family, c."order"]) AS call, unnest([c.species, c.genus, c.family, c."order"]) AS nearest,
            unnest([c1, c2, c3, c4]) AS confidence FROM nb_call c JOIN nb_conf USING (holdout_fraction, process_id) JOIN b_rows r USING (holdout_fraction, process_id)""",
        "q_blast": """SELECT 'blast' AS method, holdout_fraction, r.split, process_id, unnest(['species','genus','family','order']) AS rank,
            unnest([r.species, r.genus, r.family, r."order"]) AS truth, unnest(CASE WHEN c.pident>=97 THEN [t.species, t.genus, t.family, t."order"] ELSE [NULL, NULL, NULL, NULL] END) AS call,
            unnest([t.species, t.genus, t.family, t."order"]) AS nearest, c.confidence
            FROM w_call c JOIN b_rows r USING (holdout_fraction, process_id) LEFT JOIN (SELECT holdout_fraction, process_id AS sseqid, species, genus, family, "order" FROM b_rows) t USING (holdout_fraction, sseqid)""",
        "q_preds": "SELECT method, holdout_fraction, split, process_id, rank, truth, call, nearest, confidence FROM q_ours UNION ALL BY NAME SELECT method, holdout_fraction, split, process_id, rank, truth, call, nearest, confidence FROM q_nnlong "
        "UNION ALL BY NAME SELECT * FROM q_bayes UNION ALL BY NAME SELECT * FROM q_blast",
        "q_subsets": "SELECT *, 'all' AS subset FROM q_preds UNION ALL BY NAME SELECT *, 'novel' AS subset FROM q_preds WHERE split='test'",
    }
)


# --- H -----------------------------------------------------------------------------------------

KEYS = ["holdout_fraction", "method", "rank"]


@query("h1_coverage", "SELECT holdout_fraction, method, rank, round(avg((call IS NOT NULL)::INT), 9) AS coverage FROM s_preds WHERE split='test' GROUP BY ALL")
def h1(spark, sf_dir):
    out = metrics.point_scores(specimen_long(spark, sf_dir).where("split = 'test'"), KEYS)
    return out.select(*KEYS, r9("coverage").alias("coverage"))


@query("h2_accuracy_answered", "SELECT holdout_fraction, method, rank, round(avg((call = truth)::INT), 9) AS accuracy FROM s_preds WHERE split='test' GROUP BY ALL")
def h2(spark, sf_dir):
    out = metrics.point_scores(specimen_long(spark, sf_dir).where("split = 'test'"), KEYS)
    return out.select(*KEYS, r9("accuracy_among_answered").alias("accuracy"))


def _binomial(src: str, keys: str) -> str:
    """Twin of ``metrics.binomial_ranges`` over (keys, size, p)."""
    ends = f"""SELECT *, CASE WHEN p <= 0 OR p >= 1 THEN m ELSE greatest(0, m-d) END AS lo, CASE WHEN p <= 0 OR p >= 1 THEN m ELSE least(size, m+d) END AS hi
        FROM (SELECT *, least(floor((size+1)*p)::BIGINT, size) AS m, ceil(12*sqrt(size*p*(1-p)))::BIGINT+30 AS d FROM {src})"""
    steps = f"SELECT *, CASE WHEN k=lo THEN 0 ELSE ln((size-k+1)::DOUBLE/k*p/(1-p)) END AS step FROM (SELECT *, unnest(range(lo, hi+1)) AS k FROM ({ends}))"
    levels = f"SELECT *, sum(step) OVER (PARTITION BY {keys} ORDER BY k) AS lev FROM ({steps})"
    weights = f"SELECT *, exp(lev - max(lev) OVER (PARTITION BY {keys})) AS wt FROM ({levels})"
    cumulated = f"SELECT *, sum(wt) OVER (PARTITION BY {keys} ORDER BY k)/sum(wt) OVER (PARTITION BY {keys}) AS c FROM ({weights})"
    return f"SELECT {keys}, k, coalesce(lag(c) OVER (PARTITION BY {keys} ORDER BY k), -1) AS below, CASE WHEN k=hi THEN 2 ELSE c END AS upto FROM ({cumulated})"


def _hashed_uniform(stream: str) -> str:
    return f"(('0x'||substr(md5('42|'||holdout_fraction||'|'||method||'|'||rank||'|'||rep||'|{stream}'),1,8))::BIGINT + 0.5::DOUBLE)/4294967296.0::DOUBLE"


_BOOT = {
    "bc": "SELECT holdout_fraction, method, rank, count(*) AS n, count(*) FILTER (call = truth) AS n_right, count(*) FILTER (call <> truth) AS n_wrong FROM s_preds WHERE split='test' GROUP BY ALL",
    "b_trials": "SELECT holdout_fraction, method, rank, n AS size, (n_right+n_wrong)::DOUBLE/n AS p FROM bc",
    "b_ranges": _binomial("b_trials", "holdout_fraction, method, rank"),
    "b_reps": f"SELECT *, {_hashed_uniform('answered')} AS u FROM (SELECT *, unnest(range(1000)) AS rep FROM bc)",
    "b_drawn": f"SELECT holdout_fraction, method, rank, n, n_right, n_wrong, rep, k AS answered, {_hashed_uniform('right')} AS u2 FROM b_reps JOIN b_ranges USING (holdout_fraction, method, rank) WHERE u > below AND u <= upto",
    "b_trials2": "SELECT DISTINCT holdout_fraction, method, rank, answered, answered AS size, CASE WHEN n_right+n_wrong > 0 THEN n_right::DOUBLE/(n_right+n_wrong) ELSE 0 END AS p FROM b_drawn",
    "b_ranges2": _binomial("b_trials2", "holdout_fraction, method, rank, answered"),
    "br": "SELECT holdout_fraction, method, rank, n, rep, answered, k AS hits FROM b_drawn JOIN b_ranges2 USING (holdout_fraction, method, rank, answered) WHERE u2 > below AND u2 <= upto",
}


@query(
    "h3_bootstrap_interval",
    """SELECT holdout_fraction, method, rank, round(quantile_cont(answered::DOUBLE/n, 0.025), 6) AS coverage_low, round(quantile_cont(answered::DOUBLE/n, 0.975), 6) AS coverage_high,
    round(quantile_cont(hits::DOUBLE/answered, 0.025) FILTER (answered > 0), 6) AS accuracy_low, round(quantile_cont(hits::DOUBLE/answered, 0.975) FILTER (answered > 0), 6) AS accuracy_high FROM br GROUP BY ALL""",
    **_BOOT,
)
def h3(spark, sf_dir):
    out = metrics.bootstrap_intervals(specimen_long(spark, sf_dir).where("split = 'test'"), KEYS)
    return out.select(*KEYS, *[r6(c).alias(c) for c in ("coverage_low", "coverage_high", "accuracy_low", "accuracy_high")])


_GRID = f"SELECT holdout_fraction, unnest({list(METHODS)}) AS method, rank FROM (SELECT DISTINCT holdout_fraction, rank FROM s_ours)"


@query(
    "h4_method_scores",
    "SELECT g.holdout_fraction, g.method, g.rank, s.n, round(s.c, 9) AS coverage, round(s.a, 9) AS accuracy FROM grid g LEFT JOIN "
    "(SELECT holdout_fraction, method, rank, count(*) AS n, avg((call IS NOT NULL)::INT) AS c, avg((call = truth)::INT) AS a FROM s_preds WHERE split='test' GROUP BY ALL) s USING (holdout_fraction, method, rank)",
    grid=_GRID,
)
def h4(spark, sf_dir):
    """Methods that did not run keep a row of nulls."""
    out = metrics.with_missing_methods(metrics.point_scores(specimen_long(spark, sf_dir).where("split = 'test'"), KEYS))
    return out.select(*KEYS, "n", r9("coverage").alias("coverage"), r9("accuracy_among_answered").alias("accuracy"))


SUBSET_KEYS = ["holdout_fraction", "subset", "method", "rank"]


@query("h5_strict_accuracy", "SELECT holdout_fraction, subset, method, rank, round(avg(coalesce(call = truth, false)::INT), 9) AS accuracy FROM s_subsets GROUP BY ALL")
def h5(spark, sf_dir):
    return metrics.subset_scores(specimen_long(spark, sf_dir)).select(*SUBSET_KEYS, r9("accuracy").alias("accuracy"))


@query(
    "h6_false_confident_wrong",
    "SELECT holdout_fraction, subset, method, rank, round(avg(coalesce(call <> truth AND confidence >= 0.2, false)::INT), 9) AS fcw FROM s_subsets GROUP BY ALL",
)
def h6(spark, sf_dir):
    out = metrics.subset_scores(specimen_long(spark, sf_dir), 0.2)
    return out.select(*SUBSET_KEYS, r9("false_confident_wrong_rate").alias("fcw"))


_CURVE = "SELECT holdout_fraction, subset, method, rank, i/20.0::DOUBLE AS threshold, avg(coalesce(nearest <> truth AND confidence >= i/20.0::DOUBLE, false)::INT) AS fcw FROM s_subsets, range(21) t(i) GROUP BY ALL"


@query("h7_fcw_curve", "SELECT holdout_fraction, subset, method, rank, round(threshold, 6) AS threshold, round(fcw, 9) AS fcw FROM curve", curve=_CURVE)
def h7(spark, sf_dir):
    out = metrics.fcw_curve(P.evaluation_subsets(specimen_long(spark, sf_dir)), SUBSET_KEYS)
    return out.select(*SUBSET_KEYS, r6("threshold").alias("threshold"), r9("fcw").alias("fcw"))


@query(
    "h8_label_and_score",
    "SELECT holdout_fraction, method, process_id, rank, coalesce(nearest, call) AS label, round(CASE WHEN confidence IS NULL OR isnan(confidence) OR isinf(confidence) THEN 0 ELSE confidence END, 6) AS score FROM s_preds",
)
def h8(spark, sf_dir):
    return specimen_long(spark, sf_dir).select("holdout_fraction", "method", "process_id", "rank", metrics.scored_label().alias("label"), r6(metrics.usable_confidence()).alias("score"))


@query(
    "h9_rank_score_row",
    "SELECT method, rank, round(avg(coalesce(call = truth, false)::INT), 9) AS accuracy, round(avg(coalesce(call <> truth AND confidence >= 0.5, false)::INT), 9) AS fcw, count(*) AS n, count(call) AS n_called FROM s_preds GROUP BY ALL",
)
def h9(spark, sf_dir):
    out = metrics.rank_scores(specimen_long(spark, sf_dir), ["method", "rank"])
    return out.select("method", "rank", r9("accuracy").alias("accuracy"), r9("false_confident_wrong_rate").alias("fcw"), "n", "n_called")


_SCORES = "SELECT holdout_fraction, subset, method, rank, avg(coalesce(call = truth, false)::INT) AS accuracy, avg(coalesce(call <> truth AND confidence >= 0.5, false)::INT) AS fcw, count(*) AS n, count(call) AS n_called FROM s_subsets GROUP BY ALL"


@query("h10_subset_scores", "SELECT holdout_fraction, subset, method, rank, round(accuracy, 9) AS accuracy, round(fcw, 9) AS fcw, n, n_called FROM sc", sc=_SCORES)
def h10(spark, sf_dir):
    out = metrics.subset_scores(specimen_long(spark, sf_dir))
    return out.select(*SUBSET_KEYS, r9("accuracy").alias("accuracy"), r9("false_confident_wrong_rate").alias("fcw"), "n", "n_called")


_TABLE = f"""SELECT g.method, g.rank, round(a.accuracy, 9) AS accuracy, round(a.fcw, 9) AS false_confident_wrong_rate, round(b.accuracy, 9) AS accuracy_novel, round(b.fcw, 9) AS false_confident_wrong_rate_novel
    FROM (SELECT method, unnest({list(RANKS)}) AS rank FROM (SELECT unnest({list(METHODS)}) AS method)) g
    LEFT JOIN (SELECT * FROM sc WHERE subset='all' AND holdout_fraction=0.5::DOUBLE) a USING (method, rank) LEFT JOIN (SELECT * FROM sc WHERE subset='novel' AND holdout_fraction=0.5::DOUBLE) b USING (method, rank)"""
TABLE_COLUMNS = ("accuracy", "false_confident_wrong_rate", "accuracy_novel", "false_confident_wrong_rate_novel")


def rounded_table(table):
    return table.select("method", "rank", *[r9(c).alias(c) for c in TABLE_COLUMNS])


@query("h11_method_table", _TABLE, sc=_SCORES)
def h11(spark, sf_dir):
    return rounded_table(metrics.comparison_table(metrics.subset_scores(specimen_long(spark, sf_dir)), 0.5))


@query("h12_table_fraction", "SELECT 0.5::DOUBLE AS wanted, 0.5::DOUBLE AS chosen, count(*) AS n FROM s_preds WHERE holdout_fraction=0.5::DOUBLE UNION ALL SELECT 0.4, 0.5, count(*) FROM s_preds WHERE holdout_fraction=0.5::DOUBLE")
def h12(spark, sf_dir):
    long = specimen_long(spark, sf_dir)
    parts = []
    for wanted in (0.5, 0.4):
        chosen = metrics.table_fraction(long, wanted)
        rows = long.where(F.col("holdout_fraction") == chosen).agg(F.count("*").alias("n"))
        parts.append(rows.select(F.lit(wanted).alias("wanted"), F.lit(chosen).alias("chosen"), "n"))
    return parts[0].unionByName(parts[1])


@query(
    "h13_classifier_accuracy",
    f"""SELECT holdout_fraction, split, rank, round(avg(hit), 9) AS accuracy, count(*) AS n FROM (SELECT e.holdout_fraction, e.split, unnest({list(RANKS)}) AS rank,
    unnest([(lin.species=q.species)::INT, (lin.genus=q.genus)::INT, (lin.family=q.family)::INT, (lin."order"=q."order")::INT]) AS hit FROM e_best e JOIN s_rows q USING (holdout_fraction, process_id)) GROUP BY ALL""",
    **CLASSIFIER,
)
def h13(spark, sf_dir):
    out = classifier.predict(specimen_classifier(spark, sf_dir), E.query_rows(specimen_rows(spark, sf_dir)))
    return metrics.classifier_accuracy(out).select("holdout_fraction", "split", "rank", r9("accuracy").alias("accuracy"), "n")


@query("h14_novelty_rates", "SELECT holdout_fraction, count(*) AS n, round(avg(is_novel::INT), 9) AS novelty_rate, round(avg((predicted_rank IS NULL)::INT), 9) AS abstention_rate FROM s_pred WHERE split='test' GROUP BY ALL")
def h14(spark, sf_dir):
    out = metrics.novelty_rates(specimen_predictions(spark, sf_dir).where("split = 'test'"), ["holdout_fraction"])
    return out.select("holdout_fraction", "n", r9("novelty_rate").alias("novelty_rate"), r9("abstention_rate").alias("abstention_rate"))


_RESOLVED = f"""SELECT f.holdout_fraction, f.rank, count(p.process_id) AS resolved_count, avg((CASE f.rank WHEN 'species' THEN species=true_species WHEN 'genus' THEN genus=true_genus WHEN 'family' THEN family=true_family ELSE "order"=true_order END)::INT) AS resolved_accuracy
    FROM (SELECT DISTINCT holdout_fraction, unnest({list(RANKS)}) AS rank FROM s_pred) f LEFT JOIN (SELECT * FROM s_pred WHERE split='test') p ON p.holdout_fraction=f.holdout_fraction AND p.predicted_rank=f.rank GROUP BY ALL"""


@query("h15_resolved_by_rank", "SELECT holdout_fraction, rank, resolved_count, round(resolved_accuracy, 9) AS resolved_accuracy FROM res", res=_RESOLVED)
def h15(spark, sf_dir):
    out = metrics.resolved_by_rank(specimen_predictions(spark, sf_dir).where("split = 'test'"), ["holdout_fraction"])
    return out.withColumn("resolved_accuracy", r9("resolved_accuracy"))


_SEEN = "SELECT holdout_fraction, avg(is_novel::INT) AS false_novelty, avg((species=true_species)::INT) FILTER (predicted_rank='species') AS accuracy FROM s_pred WHERE split='val' GROUP BY ALL"


@query("h16_seen_species_rates", "SELECT holdout_fraction, round(false_novelty, 9) AS false_novelty_flag_rate, round(accuracy, 9) AS species_accuracy_when_confident FROM seen_rates", seen_rates=_SEEN)
def h16(spark, sf_dir):
    out = metrics.seen_species_rates(specimen_predictions(spark, sf_dir))
    return out.select("holdout_fraction", *[r9(c).alias(c) for c in ("false_novelty_flag_rate", "species_accuracy_when_confident")])


@query("h17_encoder_comparison")
def h17(spark, sf_dir):
    """Both encoders under the same splits and cascade."""
    conv = {"embedding_dim": 8, "n_filters": 8, "kernel_size": 5, "epochs": 2, "batch_size": 128}
    return E.compare_encoders_job(barcode_split(spark, sf_dir), {"kmer_pca": {"k": 3, "n_components": 20}, "conv_triplet": conv})


@query(
    "h17_encoder_scores",
    """SELECT s.holdout_fraction, s.rank, round(s.accuracy, 9) AS accuracy, round(s.fcw, 9) AS fcw, round(e.ece, 6) AS ece, r.resolved_count, round(n.novelty, 9) AS novelty_rate
    FROM (SELECT * FROM sc WHERE subset='novel' AND method='ours') s JOIN pf_ece e USING (holdout_fraction, rank) JOIN res r USING (holdout_fraction, rank)
    JOIN (SELECT holdout_fraction, avg(is_novel::INT) AS novelty FROM s_pred WHERE split='test' GROUP BY ALL) n USING (holdout_fraction)""",
    sc=_SCORES,
    res=_RESOLVED,
    pf_bins=bins("s_test", "holdout_fraction, rank"),
    pf_ece="SELECT holdout_fraction, rank, sum(count*abs(accuracy-mean_confidence))/sum(count) AS ece FROM pf_bins WHERE count>0 GROUP BY ALL",
)
def h17_given(spark, sf_dir):
    """The comparison's score row on given vectors."""
    out = E.encoder_scores(specimen_predictions(spark, sf_dir), "given").where("split = 'test'")
    return out.select("holdout_fraction", "rank", r9("accuracy").alias("accuracy"), r9("false_confident_wrong_rate").alias("fcw"),
                      r6("ece").alias("ece"), "resolved_count", r9("novelty_rate").alias("novelty_rate"))


@query(
    "h18_base_classifier_job",
    f"""SELECT holdout_fraction, split, rank, round(avg(hit), 9) AS accuracy, count(*) AS n FROM (SELECT e.holdout_fraction, e.split, unnest({list(RANKS)}) AS rank,
    unnest([(lin.species=q.species)::INT, (lin.genus=q.genus)::INT, (lin.family=q.family)::INT, (lin."order"=q."order")::INT]) AS hit FROM e_best e JOIN q_rows q USING (holdout_fraction, process_id)) GROUP BY ALL""",
    **(METHOD_SQL | {k: v.replace("s_rows", "q_rows").replace("s_cent", "q_cent") for k, v in CLASSIFIER.items()}),
)
def h18_base(spark, sf_dir):
    out = E.base_classifier_job(encoded_barcodes(spark, sf_dir))
    return out.select("holdout_fraction", "split", "rank", r9("accuracy").alias("accuracy"), "n")


_SUMMARY = """SELECT t.*, r1.resolved_count AS species_count, round(r1.resolved_accuracy, 9) AS species_accuracy, r3.resolved_count AS family_count, round(r3.resolved_accuracy, 9) AS family_accuracy,
    round(v.false_novelty, 9) AS false_novelty_flag_rate, round(v.accuracy, 9) AS species_accuracy_when_confident
    FROM (SELECT holdout_fraction, count(*) AS n_test, round(avg(is_novel::INT), 9) AS novelty_detection_recall, round(avg((predicted_rank IS NULL)::INT), 9) AS abstention_rate FROM s_pred WHERE split='test' GROUP BY ALL) t
    JOIN res r1 ON r1.holdout_fraction=t.holdout_fraction AND r1.rank='species' JOIN res r3 ON r3.holdout_fraction=t.holdout_fraction AND r3.rank='family' JOIN seen_rates v ON v.holdout_fraction=t.holdout_fraction"""


@query("h18_fallback_job", _SUMMARY, res=_RESOLVED, seen_rates=_SEEN)
def h18_fallback(spark, sf_dir):
    out = E.fallback_job(specimen_rows(spark, sf_dir))
    ratios = ("novelty_detection_recall", "abstention_rate", "species_accuracy", "family_accuracy", "false_novelty_flag_rate", "species_accuracy_when_confident")
    return out.select("holdout_fraction", "n_test", "species_count", "family_count", *[r9(c).alias(c) for c in ratios])


@query(
    "h18_benchmark_job",
    """SELECT holdout_fraction, method, rank, count(*) AS n, round(avg((call IS NOT NULL)::INT), 9) AS coverage, round(avg((call = truth)::INT), 9) AS accuracy_among_answered,
    any_value(cl) AS coverage_low, any_value(ch) AS coverage_high, any_value(al) AS accuracy_low, any_value(ah) AS accuracy_high
    FROM q_preds JOIN (SELECT holdout_fraction, method, rank, round(quantile_cont(answered::DOUBLE/n, 0.025), 6) AS cl, round(quantile_cont(answered::DOUBLE/n, 0.975), 6) AS ch,
    round(quantile_cont(hits::DOUBLE/answered, 0.025) FILTER (answered > 0), 6) AS al, round(quantile_cont(hits::DOUBLE/answered, 0.975) FILTER (answered > 0), 6) AS ah FROM br GROUP BY ALL) USING (holdout_fraction, method, rank)
    WHERE split='test' GROUP BY ALL""",
    **(METHOD_SQL | {k: v.replace("s_preds", "q_preds") for k, v in _BOOT.items()}),
)
def h18_benchmark(spark, sf_dir):
    """All four methods over barcodes with intervals."""
    out = E.benchmark_job(four_methods(spark, sf_dir))
    return out.select(*KEYS, "n", r9("coverage").alias("coverage"), r9("accuracy_among_answered").alias("accuracy_among_answered"),
                      *[r6(c).alias(c) for c in ("coverage_low", "coverage_high", "accuracy_low", "accuracy_high")])


@query("h18_head_to_head_job", _TABLE, sc=_SCORES)
def h18_head(spark, sf_dir):
    table, _ = E.head_to_head_job(specimen_long(spark, sf_dir), scratch(spark, "head-to-head"))
    return rounded_table(table)


@query("h18_head_to_head_barcodes", _TABLE, **(METHOD_SQL | {"sc": _SCORES.replace("s_subsets", "q_subsets")}))
def h18_head_barcodes(spark, sf_dir):
    return rounded_table(E.head_to_head_job(four_methods(spark, sf_dir))[0])


# --- result sinks (A8, A9) ------------------------------------------------------------------------


@query("a8_prediction_dump", "SELECT process_id, holdout_fraction, split, rank, nearest, round(confidence, 6) AS confidence FROM s_ours")
def a8(spark, sf_dir):
    path = scratch(spark, "predictions")
    T.write_predictions(specimen_long(spark, sf_dir).where("method = 'ours'"), path)
    saved = spark.read.parquet(path)
    return saved.select("process_id", "holdout_fraction", "split", "rank", "nearest", r6("confidence").alias("confidence"))


@query("a9_result_sinks", _TABLE, sc=_SCORES)
def a9(spark, sf_dir):
    """The comparison table through its CSV sink, the scores through their JSON sink."""
    path = scratch(spark, "results")
    E.head_to_head_job(specimen_long(spark, sf_dir), path)
    schema = "method string, rank string, " + ", ".join(f"{c} double" for c in TABLE_COLUMNS)
    return rounded_table(spark.read.schema(schema).option("header", True).csv(f"{path}/table"))


# --- I -----------------------------------------------------------------------------------------


@query("i1_correctness_dump", """SELECT process_id, holdout_fraction, split, predicted_rank, is_novel, max(nearest) FILTER (rank='family') AS nearest_family, max(truth) FILTER (rank='family') AS true_family,
    round(max(confidence) FILTER (rank='family'), 6) AS confidence_family, max(correct) FILTER (rank='family') AS correct_family, max(correct) FILTER (rank='species') AS correct_species FROM s_correct GROUP BY ALL""")
def i1(spark, sf_dir):
    wide = calibration.held_out_table(specimen_predictions(spark, sf_dir))
    return wide.select("process_id", "holdout_fraction", "split", "predicted_rank", "is_novel", "nearest_family", "true_family",
                       r6("confidence_family").alias("confidence_family"), "correct_family", "correct_species")


_BIN_COLUMNS = "rank, bin_index, round(conf_low, 6) AS conf_low, round(conf_high, 6) AS conf_high, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 9) AS accuracy, count"


def rounded_bins(b, *keys):
    return b.select(*keys, "bin_index", r6("conf_low").alias("conf_low"), r6("conf_high").alias("conf_high"),
                    r6("mean_confidence").alias("mean_confidence"), r9("accuracy").alias("accuracy"), "count")


@query("i2_reliability_bins", f"SELECT {_BIN_COLUMNS} FROM s_bins")
def i2(spark, sf_dir):
    return rounded_bins(calibration.reliability_bins(specimen_test(spark, sf_dir), ["rank"]), "rank")


@query("i3_calibration_error", "SELECT rank, n, round(ece, 6) AS ece FROM s_ece")
def i3(spark, sf_dir):
    return calibration.calibration_error(specimen_test(spark, sf_dir), ["rank"]).withColumn("ece", r6("ece"))


@query(
    "i4_rank_reports",
    "SELECT b.holdout_fraction, b.rank, bin_index, round(conf_low, 6) AS conf_low, round(conf_high, 6) AS conf_high, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 9) AS accuracy, count, e.n, round(e.ece, 6) AS ece FROM pf_bins b JOIN pf_ece e USING (holdout_fraction, rank)",
    pf_bins=bins("s_test", "holdout_fraction, rank"),
    pf_ece="SELECT holdout_fraction, rank, sum(count)::BIGINT AS n, sum(count*abs(accuracy-mean_confidence))/sum(count) AS ece FROM (SELECT * REPLACE (coalesce(accuracy, 0) AS accuracy, coalesce(mean_confidence, 0) AS mean_confidence) FROM pf_bins) GROUP BY ALL",
)
def i4(spark, sf_dir):
    keys = ["holdout_fraction", "rank"]
    out = calibration.report(specimen_test(spark, sf_dir), keys)
    return rounded_bins(out, *keys).join(out.select(*keys, "bin_index", "n", r6("ece").alias("ece")), [*keys, "bin_index"])


_ISO = {
    "iso_x": "SELECT rank, confidence AS x, avg(correct) AS y, count(*) AS w, row_number() OVER (PARTITION BY rank ORDER BY confidence) AS i FROM s_test GROUP BY rank, confidence",
    "iso_p": "SELECT rank, i, x, sum(w) OVER (PARTITION BY rank ORDER BY i) AS cw, sum(w*y) OVER (PARTITION BY rank ORDER BY i) AS cy, w, w*y AS wy FROM iso_x",
    "iso_ab": "SELECT a.rank, a.i AS a, b.i AS b, (b.cy-a.cy+a.wy)/(b.cw-a.cw+a.w) AS m FROM iso_p a JOIN iso_p b ON b.rank=a.rank AND b.i>=a.i",
    "iso_min": "SELECT rank, a, b, min(m) OVER (PARTITION BY rank, a ORDER BY b DESC) AS m FROM iso_ab",
    "iso_fit": "SELECT rank, b AS i, max(m) AS fit FROM iso_min GROUP BY rank, b",
}
_ISO_SQL = "SELECT t.holdout_fraction, t.process_id, t.rank, round(f.fit, 6) AS confidence FROM s_test t JOIN iso_x x ON t.confidence=x.x AND t.rank=x.rank JOIN iso_fit f ON f.rank=x.rank AND f.i=x.i"


@query("i5_isotonic_map", _ISO_SQL, **_ISO)
def i5(spark, sf_dir):
    """Isotonic fits of every rank on the pooled held-out scores, applied to the same rows (max-min formula in SQL)."""
    out = isotonic.recalibrated(specimen_test(spark, sf_dir), ["rank"])
    return out.select("holdout_fraction", "process_id", "rank", r6("confidence").alias("confidence"))


_NEWTON = """SELECT t.holdout_fraction, t.process_id, round(1/(1+exp(-(f.a*t.confidence+f.b))), 4) AS confidence FROM s_test t, (
    WITH RECURSIVE n(k, a, b) AS (
        SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
        UNION ALL
        SELECT k+1, a-(h22*g1-h12*g2)/(h11*h22-h12*h12), b-(h11*g2-h12*g1)/(h11*h22-h12*h12) FROM (
            SELECT k, a, b, sum((p-y)*x)+a AS g1, sum(p-y) AS g2, sum(p*(1-p)*x*x)+1 AS h11, sum(p*(1-p)*x) AS h12, sum(p*(1-p)) AS h22
            FROM (SELECT n.*, d.confidence AS x, d.correct AS y, 1/(1+exp(-(n.a*d.confidence+n.b))) AS p FROM n, s_test d WHERE d.rank='family' AND n.k < 30) GROUP BY k, a, b))
    SELECT a, b FROM n WHERE k=30) f WHERE t.rank='family'"""


@query("i6_platt_map", _NEWTON)
def i6(spark, sf_dir):
    rows = specimen_test(spark, sf_dir).where("rank = 'family'")
    fitted = calibration.fit_map(rows, "platt")
    return rows.select("holdout_fraction", "process_id", r6(fitted.column(F.col("confidence")), 4).alias("confidence"))


@query("i7_constant_map", "SELECT rank, avg(correct) AS constant, count(*) AS n FROM s_test GROUP BY rank HAVING min(correct)=max(correct)")
def i7(spark, sf_dir):
    """Ranks whose held-out rows are all right or all wrong get a constant map."""
    rows = specimen_test(spark, sf_dir)
    maps = calibration.fit_rank_maps(rows)
    constant = {r: m.constant for r, m in maps.items() if m.constant is not None}
    table = spark.createDataFrame(list(constant.items()), "rank string, constant double")
    return rows.groupBy("rank").agg(F.count("*").alias("n")).join(table, "rank")


LOHO = {
    "l_f": "SELECT DISTINCT holdout_fraction AS f FROM s_test",
    "l_x": "SELECT rank, f, confidence AS x, avg(correct) AS y, count(*) AS w, row_number() OVER (PARTITION BY rank, f ORDER BY confidence) AS i FROM s_test JOIN l_f ON holdout_fraction<>f GROUP BY rank, f, confidence",
    "l_p": "SELECT rank, f, i, x, sum(w) OVER (PARTITION BY rank, f ORDER BY i) AS cw, sum(w*y) OVER (PARTITION BY rank, f ORDER BY i) AS cy, w, w*y AS wy FROM l_x",
    "l_ab": "SELECT a.rank, a.f, a.i AS a, b.i AS b, (b.cy-a.cy+a.wy)/(b.cw-a.cw+a.w) AS m FROM l_p a JOIN l_p b ON b.rank=a.rank AND b.f=a.f AND b.i>=a.i",
    "l_min": "SELECT rank, f, a, b, min(m) OVER (PARTITION BY rank, f, a ORDER BY b DESC) AS m FROM l_ab",
    "l_fit": "SELECT rank, f, b AS i, max(m) AS fit FROM l_min GROUP BY rank, f, b",
    "l_pts": "SELECT x.rank, x.f, x.x, t.fit FROM l_x x JOIN l_fit t ON t.rank=x.rank AND t.f=x.f AND t.i=x.i",
    "l_low": "SELECT t.*, p.x AS x0, p.fit AS y0 FROM s_test t ASOF LEFT JOIN l_pts p ON t.rank=p.rank AND t.holdout_fraction=p.f AND t.confidence>=p.x",
    "l_both": "SELECT t.*, p.x AS x1, p.fit AS y1 FROM l_low t ASOF LEFT JOIN l_pts p ON t.rank=p.rank AND t.holdout_fraction=p.f AND t.confidence<=p.x",
    "l_new": "SELECT holdout_fraction, process_id, rank, correct, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x1=x0 THEN y0 ELSE y0+(y1-y0)*(confidence-x0)/(x1-x0) END AS confidence FROM l_both",
    "l_bad": "SELECT rank FROM s_ece WHERE ece > 0.1",
    "l_mix": "SELECT rank, correct, confidence FROM l_new SEMI JOIN l_bad USING (rank) UNION ALL SELECT rank, correct, confidence FROM s_test ANTI JOIN l_bad USING (rank)",
    "l_bins": bins("l_mix", "rank"),
    "l_ece": "SELECT rank, sum(count*abs(accuracy-mean_confidence))/sum(count) AS ece FROM l_bins WHERE count > 0 GROUP BY ALL",
}


@query("i8_leave_one_holdout", "SELECT holdout_fraction, process_id, rank, round(confidence, 6) AS confidence, correct FROM l_new", **LOHO)
def i8(spark, sf_dir):
    out = calibration.leave_one_holdout(specimen_test(spark, sf_dir), by=("rank",))
    return out.select("holdout_fraction", "process_id", "rank", r6("confidence").alias("confidence"), "correct")


@query("i9_rank_maps", _ISO_SQL, **_ISO)
def i9(spark, sf_dir):
    """Maps fitted per rank, saved as a table, read back and applied."""
    rows = specimen_test(spark, sf_dir)
    path = scratch(spark, "maps")
    calibration.maps_table(spark, calibration.fit_rank_maps(rows)).write.parquet(path)
    out = calibration.apply_rank_maps(rows, calibration.maps_from_table(spark.read.parquet(path)))
    return out.select("holdout_fraction", "process_id", "rank", r6("confidence").alias("confidence"))


@query("i10_ece_gate", "SELECT rank, n, round(ece, 6) AS ece, ece > 0.1 AS failed FROM s_ece")
def i10(spark, sf_dir):
    return calibration.raw_gate(specimen_test(spark, sf_dir)).withColumn("ece", r6("ece"))


def calibrated(spark, sf_dir):
    return shared(spark, sf_dir, "calibrated", lambda: E.calibration_job(specimen_predictions(spark, sf_dir), scratch(spark, "calibration")))


@query(
    "i11_calibration_job",
    """SELECT s.rank, s.n, round(s.ece, 6) AS raw_ece, round(l.ece, 6) AS new_ece, CASE WHEN (SELECT max(ece) FROM l_ece) > 0.1 THEN 'fail_after_recalibrate' ELSE 'pass_after_recalibrate' END AS decision
    FROM s_ece s JOIN l_ece l USING (rank)""",
    **LOHO,
)
def i11(spark, sf_dir):
    """Raw and recalibrated error per rank with the job's decision."""
    job = calibrated(spark, sf_dir)
    raw = job["raw"].select("rank", "n", r6("ece").alias("raw_ece")).distinct()
    fixed = job["recalibrated"]
    if fixed is None:
        return raw.withColumns({"new_ece": F.lit(None).cast("double"), "decision": F.lit(job["decision"])})
    return raw.join(fixed.select("rank", r6("ece").alias("new_ece")).distinct(), "rank").withColumn("decision", F.lit(job["decision"]))
