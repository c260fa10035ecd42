import random

import pytest
from pyspark.sql import functions as F

from helpers import RANKS, random_sequence
from taxaspark.operators import nearest
from taxaspark.operators import splits as P
from taxaspark.operators.cleaning import marker_filter, project_records
from taxaspark.plans import deployment
from taxaspark.plans import evaluation as E
from taxaspark.sources import raw as R
from taxaspark.streaming import streams

ROW = "process_id string, species string, genus string, family string, `order` string, lat double, lon double, sequence string"


def corpus(spark, genera=6, species=2, rows=8, length=80):
    """Species drift from a genus parent, so that nearby rows are related."""
    data = []
    for g in range(genera):
        for s in range(species):
            parent = random_sequence(100 * g + s, length)
            for r in range(rows):
                rng = random.Random(g * 1000 + s * 100 + r)
                seq = "".join(c if rng.random() > 0.03 else rng.choice("ACGT") for c in parent)
                data.append((f"P{g}_{s}_{r}", f"G{g} s{s}", f"G{g}", f"F{g % 2}", "O", 10.0 + g, 20.0 + s, seq))
    return spark.createDataFrame(data, ROW)


@pytest.fixture(scope="module")
def split(spark):
    from taxaspark.session import stage

    df = corpus(spark)
    return stage(E.split_table(df, P.make_splits(df, (0.3, 0.5), val_fraction=0.3)), "corpus")


def test_all_methods_run_and_are_scored(spark, split, tmp_path):
    long = E.system_predictions(E.encode_splits(split, "kmer", k=3, n_components=6), nb_k=3, min_pident=90.0)
    n = split.where("split <> 'train'").count()
    per_method = {r.method: r["count"] for r in long.groupBy("method").count().collect()}
    assert per_method == dict.fromkeys(("ours", "naive_bayes", "nearest_neighbor", "blast"), 4 * n)
    scores = E.benchmark_job(long, str(tmp_path / "benchmark"), n_bootstrap=50).collect()
    assert len(scores) == 2 * 4 * 4
    answered = {(r.method, r["rank"]): r.coverage for r in scores if r.holdout_fraction == 0.5}
    assert answered["naive_bayes", "species"] == answered["nearest_neighbor", "species"] == 1.0
    table, curves = E.head_to_head_job(long, str(tmp_path / "h2h"))
    assert table.count() == 16 and spark.read.option("header", True).csv(str(tmp_path / "h2h" / "table")).count() == 16
    novel = {(r.method, r["rank"]): r.accuracy_novel for r in table.collect()}
    assert novel["naive_bayes", "species"] == 0.0  # held-out genera cannot be named
    assert curves.count() == 2 * 2 * 4 * 4 * 21


def test_a_method_that_did_not_run_has_null_rows(spark, split):
    encoded = E.encode_splits(split, "kmer", k=2, n_components=4)
    long = E.system_predictions(encoded, methods=("ours",))
    rows = {(r.method, r["rank"]): r for r in E.benchmark_job(long, n_bootstrap=20).where("holdout_fraction = 0.3").collect()}
    assert len(rows) == 16 and rows["blast", "order"].coverage is None and rows["ours", "order"].coverage is not None


def test_encoder_comparison_table(spark, split, tmp_path):
    conv = {"embedding_dim": 6, "n_filters": 4, "kernel_size": 3, "max_len": 80, "epochs": 1}
    rows = E.compare_encoders_job(split, {"kmer": {"k": 2, "n_components": 4}, "cnn": conv}, str(tmp_path / "encoders")).collect()
    assert len(rows) == 2 * 2 * 4
    assert {r.encoder for r in rows} == {"kmer_pca", "conv_triplet"}
    assert {(r.encoder, r.dimensions) for r in rows} == {("kmer_pca", 4), ("conv_triplet", 6)}
    assert all(r.n_novel > 0 and r.n_val > 0 and 0.0 <= r.accuracy_val <= 1.0 for r in rows)
    assert all(0.0 <= r.ece_novel <= 1.0 and 0.0 <= r.novelty_detection_recall <= 1.0 for r in rows)


def test_calibration_job_saves_and_decides(spark, split, tmp_path):
    encoded = E.encode_splits(split, "kmer", k=3, n_components=6)
    predictions = E.fallback_predictions(encoded)
    job = E.calibration_job(predictions, str(tmp_path / "cal"))
    assert job["decision"] in ("pass", "pass_after_recalibrate", "fail_after_recalibrate")
    assert (job["decision"] == "pass") == (not job["bad_ranks"])
    saved = spark.read.parquet(str(tmp_path / "cal" / "heldout_predictions"))
    assert saved.count() == predictions.count()
    assert {r.split for r in saved.select("split").distinct().collect()} == {"val", "test"}
    strict = E.calibration_job(predictions, ece_threshold=-1.0, recalibrate=False)
    assert strict["decision"] == "fail" and strict["bad_ranks"] == list(RANKS)


def test_base_classifier_never_names_a_held_out_genus(spark, split):
    scores = E.base_classifier_job(E.encode_splits(split, "kmer", k=3, n_components=6)).collect()
    novel = {(r.holdout_fraction, r["rank"]): r.accuracy for r in scores if r.split == "test"}
    assert novel[0.5, "species"] == novel[0.5, "genus"] == 0.0 and novel[0.5, "order"] == 1.0


@pytest.fixture(scope="module")
def deployed(spark):
    return deployment.deploy(corpus(spark), "kmer", 0.25, k=3, n_components=5)


def test_deployment_counts_and_classifies(spark, deployed):
    df = corpus(spark)
    assert deployed.counts["n_train"] + deployed.counts["n_val"] == df.count()
    assert deployed.counts["n_val"] == 24 and deployed.counts["n_species"] == 12
    known = df.where("process_id = 'P0_0_0'").select("process_id", "lat", "lon", "sequence")
    p = deployment.classify(deployed, known).first()
    assert p.predicted_rank in RANKS and p.nearest_species[0].label == p.closest_relative_species
    half = deployment.classify(deployed, known.withColumn("lat", F.lit(None).cast("double"))).first()
    none = deployment.classify(deployed, known.withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon")})).first()
    assert half.distance == none.distance != p.distance  # one coordinate is no location


def test_pasted_reads_keep_their_errors(spark, deployed):
    good = random_sequence(0, 80)
    reads = spark.createDataFrame(
        [("a", f">x\n{good.lower()}", 1.0, 2.0), ("b", ">x\n", None, None), ("c", "ACGU", None, None), ("d", good, 1.0, None)],
        "process_id string, raw string, lat double, lon double",
    )
    out = {r.process_id: r for r in deployment.classify_pasted(deployed, reads).collect()}
    assert out["a"].closest_relative_species and out["a"].error is None
    assert (out["b"].error, out["c"].error, out["d"].error) == ("empty", "invalid_chars", "half_coordinates")
    assert out["c"].invalid == "U" and out["b"].closest_relative_species is None


def test_stream_of_reads_equals_the_batch(spark, deployed, tmp_path):
    reads = corpus(spark).select("process_id", "lat", "lon", "sequence")
    reads.repartition(3).write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    streams.classify_stream(deployed, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.process_id: (r.predicted_rank, r.confidence) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.process_id: (r.predicted_rank, r.confidence) for r in deployment.classify(deployed, reads).collect()}
    assert got.keys() == want.keys()
    for i in got:
        assert got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1])


def test_a_stream_measures_its_labels_once(spark, deployed, tmp_path, monkeypatch):
    reads = corpus(spark).select("process_id", "lat", "lon", "sequence").limit(12)
    source = str(tmp_path / "reads")
    for i in range(3):
        reads.where(F.pmod(F.xxhash64("process_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(source)
    counted, plain = [], nearest.label_count
    monkeypatch.setattr(nearest, "label_count", lambda labels: counted.append(1) or plain(labels))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.classify_stream(deployed, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() > 1 and out.count() == 12 and len(counted) == 1
    model = deployed.model.prepared()
    want = sorted(map(str, deployment.classify(deployed, reads).select("process_id", "predicted_rank", "confidence").collect()))
    assert sorted(map(str, out.select("process_id", "predicted_rank", "confidence").collect())) == want
    assert model.shared.data is not None and nearest.share_labels(model.centroids, 0).data is None


def test_landing_stream_reads_each_file_once(spark, tmp_path):
    landing, out, cp = (str(tmp_path / n) for n in ("landing", "out", "cp"))

    def land(prefix):
        rows = spark.createDataFrame([(f"{prefix}{i}", "COI-5P" if i % 2 else "16S") for i in range(10)], "processid string, marker_code string")
        rows.coalesce(1).write.mode("append").json(landing)

    land("a")
    streams.ingest(spark, landing, out, cp).awaitTermination()
    land("b")
    streams.ingest(spark, landing, out, cp).awaitTermination()
    batch = project_records(marker_filter(R.read_ndjson(spark, landing), "COI-5P"))
    assert sorted(r.process_id for r in spark.read.parquet(out).collect()) == sorted(r.process_id for r in batch.collect())
    assert spark.read.parquet(out).count() == 10
