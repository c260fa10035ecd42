"""Base classifier (E) and the calibrated cascade (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.catalog.features import K2
from taxaspark.catalog.registry import query, r6, r9, shared, vec_key
from taxaspark.catalog.sql import fallback_of, geo, vec_key as sql_vec_key
from taxaspark.catalog.tables_and_cleaning import cleaned_barcodes
from taxaspark.functions import scores
from taxaspark.operators import calibration, classifier, fallback
from taxaspark.operators import splits as P
from taxaspark.operators.kmers import kmer_vectors
from taxaspark.operators.nearest import distance_profiles, nearest_hits
from taxaspark.operators.predictions import long_form
from taxaspark.plans import deployment
from taxaspark.plans import evaluation as E
from taxaspark.session import stage
from taxaspark.sources import derived as D


def specimen_rows(spark, sf_dir):
    """Specimens under every fraction's split."""

    def build():
        rows = D.specimens(spark, sf_dir)
        return stage(P.assign_roles(rows).withColumnRenamed("role", "split"), "specimen-rows")

    return shared(spark, sf_dir, "specimen-rows", build)


def specimen_classifier(spark, sf_dir):
    return shared(spark, sf_dir, "classifier", lambda: classifier.fit(E.train_rows(specimen_rows(spark, sf_dir))))


def specimen_model(spark, sf_dir):
    return shared(spark, sf_dir, "fallback", lambda: E.fit_fallback(specimen_rows(spark, sf_dir)))


def specimen_predictions(spark, sf_dir):
    def build():
        return stage(fallback.predict(specimen_model(spark, sf_dir), E.query_rows(specimen_rows(spark, sf_dir))), "specimen-pred")

    return shared(spark, sf_dir, "specimen-predictions", build)


# --- E: nearest centroid under min-max normalised distances ------------------------------------

_MM = "CASE WHEN {hi}-{lo} < 1e-12 THEN 0 ELSE ({v}-{lo})/({hi}-{lo}) END"
CLASSIFIER = {
    "e_raw": f"""SELECT q.holdout_fraction, q.split, q.process_id, c.label, c.lin, list_distance(q.vec, c.vec) AS sd,
        CASE WHEN q.lat IS NOT NULL AND q.lon IS NOT NULL AND c.lat IS NOT NULL THEN {geo('q.lat', 'q.lon', 'c.lat', 'c.lon')} END AS gd
        FROM s_rows q JOIN s_cent c ON q.holdout_fraction=c.holdout_fraction AND c.rank='species' WHERE q.split<>'train'""",
    "e_span": "SELECT *, min(sd) OVER w AS slo, max(sd) OVER w AS shi, min(gd) OVER w AS glo, max(gd) OVER w AS ghi FROM e_raw WINDOW w AS (PARTITION BY holdout_fraction, process_id)",
    "e_dist": f"""SELECT *, {_MM.format(v='sd', lo='slo', hi='shi')} AS sn, {_MM.format(v='gd', lo='glo', hi='ghi')} AS gn,
        CASE WHEN gd IS NULL THEN {_MM.format(v='sd', lo='slo', hi='shi')} ELSE 0.8::DOUBLE*{_MM.format(v='sd', lo='slo', hi='shi')}+0.2::DOUBLE*{_MM.format(v='gd', lo='glo', hi='ghi')} END AS d FROM e_span""",
    "e_best": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY holdout_fraction, process_id ORDER BY d, label) AS rn FROM e_dist) WHERE rn=1",
}


@query(
    "e3_min_max_normalise",
    "SELECT holdout_fraction, process_id, round(min(sn), 6) AS lowest, round(max(sn), 6) AS highest, round(avg(sn), 6) AS middle FROM e_dist GROUP BY ALL",
    **CLASSIFIER,
)
def e3(spark, sf_dir):
    """Normalised sequence distances of each query: geography is switched off by dropping it."""
    model = specimen_classifier(spark, sf_dir)
    empty = F.lit(None).cast("double")
    queries = E.query_rows(specimen_rows(spark, sf_dir)).withColumns({"lat": empty, "lon": empty})
    out = classifier.predict(model, queries, distances=True)
    total = F.aggregate("distances", F.lit(0.0), lambda a, x: a + x)
    return out.select("holdout_fraction", "process_id", r6(F.array_min("distances")).alias("lowest"),
                      r6(F.array_max("distances")).alias("highest"), r6(total / F.size("distances")).alias("middle"))


@query("e4_species_centroid", f"SELECT holdout_fraction, label, support, {sql_vec_key('vec')} AS vec FROM s_cent WHERE rank='species'")
def e4(spark, sf_dir):
    c = specimen_classifier(spark, sf_dir).centroids
    return c.select("holdout_fraction", "label", "support", vec_key("vec").alias("vec"))


@query("e5_species_geo_centroid", "SELECT holdout_fraction, label, round(lat, 6) AS lat, round(lon, 6) AS lon FROM s_cent WHERE rank='species'")
def e5(spark, sf_dir):
    return specimen_classifier(spark, sf_dir).centroids.select("holdout_fraction", "label", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query(
    "e6_species_taxonomy",
    'SELECT species, arg_min(genus, process_id) AS genus, arg_min(family, process_id) AS family, arg_min("order", process_id) AS "order" FROM clean GROUP BY ALL',
)
def e6(spark, sf_dir):
    return fallback.taxonomy_lookup(cleaned_barcodes(spark, sf_dir), "species")


@query(
    "e7_combined_distance",
    "SELECT holdout_fraction, process_id, label AS species, round(d, 6) AS d FROM e_best",
    **CLASSIFIER,
)
def e7(spark, sf_dir):
    out = classifier.predict(specimen_classifier(spark, sf_dir), E.query_rows(specimen_rows(spark, sf_dir)))
    return out.select("holdout_fraction", "process_id", "species", r6("nearest_distance").alias("d"))


@query(
    "e8_nearest_species",
    'SELECT holdout_fraction, split, process_id, lin.species AS species, lin.genus AS genus, lin.family AS family, lin."order" AS "order", round(d, 6) AS nearest_distance FROM e_best',
    **CLASSIFIER,
)
def e8(spark, sf_dir):
    out = classifier.predict(specimen_classifier(spark, sf_dir), E.query_rows(specimen_rows(spark, sf_dir)))
    return out.select("holdout_fraction", "split", "process_id", *RANKS, r6("nearest_distance").alias("nearest_distance"))


@query(
    "e9_distance_vector",
    f"SELECT holdout_fraction, process_id, {sql_vec_key('list(d ORDER BY label)')} AS distances FROM e_dist GROUP BY ALL",
    **CLASSIFIER,
)
def e9(spark, sf_dir):
    out = classifier.predict(specimen_classifier(spark, sf_dir), E.query_rows(specimen_rows(spark, sf_dir)), distances=True)
    return out.select("holdout_fraction", "process_id", vec_key("distances").alias("distances"))


# --- F -----------------------------------------------------------------------------------------


@query("f1_rank_centroids", f"SELECT holdout_fraction, rank, label, support, round(lat, 6) AS lat, round(lon, 6) AS lon, {sql_vec_key('vec')} AS vec FROM s_cent")
def f1(spark, sf_dir):
    c = specimen_model(spark, sf_dir).centroids
    return c.select("holdout_fraction", "rank", "label", "support", r6("lat").alias("lat"), r6("lon").alias("lon"), vec_key("vec").alias("vec"))


def _per_rank_table(spark, values, name):
    rows = [(f, r, None if v is None else float(v)) for (f, r), v in values.items()]
    return spark.createDataFrame(rows, f"holdout_fraction double, rank string, {name} double").withColumn(name, r6(name))


@query("f2_sequence_scale", "SELECT holdout_fraction, rank, round(seq_scale, 6) AS seq_scale FROM s_seqscale")
def f2(spark, sf_dir):
    return _per_rank_table(spark, {k: v[0] for k, v in specimen_model(spark, sf_dir).spacing.items()}, "seq_scale")


@query("f3_geo_scale", "SELECT s.holdout_fraction, s.rank, round(geo_scale, 6) AS geo_scale FROM s_seqscale s LEFT JOIN s_geoscale USING (holdout_fraction, rank)")
def f3(spark, sf_dir):
    return _per_rank_table(spark, {k: v[1] for k, v in specimen_model(spark, sf_dir).spacing.items()}, "geo_scale")


def _hit_rows(found):
    return found.select("holdout_fraction", "process_id", F.explode("hits").alias("h")).select(
        "holdout_fraction", "process_id", F.col("h.rank").alias("rank"), F.col("h.label").alias("label"),
        r6("h.distance").alias("distance"), F.col("h.support").alias("support"),
        *[F.col(f"h.{r}").alias(r) for r in RANKS[1:]],
    )


def _specimen_hits(spark, sf_dir, k):
    model = specimen_model(spark, sf_dir)
    queries = E.query_rows(specimen_rows(spark, sf_dir)).select("holdout_fraction", "split", "process_id", "lat", "lon", "vec")
    return nearest_hits(queries, model.centroids, {r: k for r in RANKS} if isinstance(k, int) else k, model.metric)


@query("f4_scaled_distance", "SELECT holdout_fraction, process_id, rank, label, round(d, 6) AS distance FROM s_place")
def f4(spark, sf_dir):
    """To every label of every rank; where that is too much, the next query adds them up."""
    labels = specimen_model(spark, sf_dir).centroids.count()
    return _hit_rows(_specimen_hits(spark, sf_dir, labels)).select("holdout_fraction", "process_id", "rank", "label", "distance")


@query(
    "f4_distance_profile",
    "SELECT holdout_fraction, process_id, rank, count(*) AS n_labels, round(sum(d), 6) AS total, round(sum(d*d), 6) AS squares, round(min(d), 6) AS least, round(max(d), 6) AS most FROM s_dist GROUP BY ALL",
)
def f4_profile(spark, sf_dir):
    model = specimen_model(spark, sf_dir)
    out = distance_profiles(E.query_rows(specimen_rows(spark, sf_dir)), model.centroids, RANKS, model.metric)
    return out.select("holdout_fraction", "process_id", "rank", "n_labels", *[r6(c).alias(c) for c in ("total", "squares", "least", "most")])


@query("f5_nearest_label", "SELECT holdout_fraction, process_id, rank, label, round(d, 6) AS distance, support FROM s_near")
def f5(spark, sf_dir):
    return _hit_rows(_specimen_hits(spark, sf_dir, 1)).select("holdout_fraction", "process_id", "rank", "label", "distance", "support")


@query("f6_top_relatives", "SELECT holdout_fraction, process_id, rank, rn AS place, label FROM s_place WHERE rn <= 5 AND rank IN ('species','genus')")
def f6(spark, sf_dir):
    found = _specimen_hits(spark, sf_dir, {"species": 5, "genus": 5})

    def placed(rank):
        return F.transform(F.filter("hits", lambda h: h["rank"] == rank), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("place")))

    place = F.explode(F.concat(placed("species"), placed("genus")))
    return found.select("holdout_fraction", "process_id", place.alias("p")).select(
        "holdout_fraction", "process_id", F.col("p.h.rank").alias("rank"), "p.place", F.col("p.h.label").alias("label"))


@query(
    "f7_hit_taxonomy",
    'SELECT holdout_fraction, process_id, rank, label, lin.genus AS genus, lin.family AS family, lin."order" AS "order" FROM s_near',
)
def f7(spark, sf_dir):
    return _hit_rows(_specimen_hits(spark, sf_dir, 1)).select("holdout_fraction", "process_id", "rank", "label", *RANKS[1:])


@query(
    "f8_taxonomy_lookups",
    """SELECT 'species' AS rank, species AS label, arg_min(genus, process_id) AS genus, arg_min(family, process_id) AS family, arg_min("order", process_id) AS "order" FROM clean GROUP BY ALL
    UNION ALL SELECT 'genus', genus, NULL, arg_min(family, process_id), arg_min("order", process_id) FROM clean GROUP BY ALL
    UNION ALL SELECT 'family', family, NULL, NULL, arg_min("order", process_id) FROM clean GROUP BY ALL""",
)
def f8(spark, sf_dir):
    rows = cleaned_barcodes(spark, sf_dir)
    parts = [fallback.taxonomy_lookup(rows, r).withColumn("rank", F.lit(r)).withColumnRenamed(r, "label") for r in RANKS[:3]]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query("f9_thresholds", "SELECT holdout_fraction, rank, round(t, 6) AS threshold FROM s_cut")
def f9(spark, sf_dir):
    return _per_rank_table(spark, specimen_model(spark, sf_dir).thresholds, "threshold")


@query("f10_cascade", "SELECT holdout_fraction, process_id, predicted_rank FROM s_pred")
def f10(spark, sf_dir):
    return specimen_predictions(spark, sf_dir).select("holdout_fraction", "process_id", "predicted_rank")


@query(
    "f11_distance_confidence",
    "SELECT holdout_fraction, process_id, rank, round(CASE WHEN t <= 1e-12 THEN (CASE WHEN d <= 1e-12 THEN 1.0 ELSE 0.0 END) ELSE least(1.0, greatest(0.0, 1.0-d/t)) END, 6) AS confidence FROM s_conf",
)
def f11(spark, sf_dir):
    model = specimen_model(spark, sf_dir)
    cut = _per_rank_exact(spark, model.thresholds)
    rows = fallback.long_hits(_specimen_hits(spark, sf_dir, 1)).join(F.broadcast(cut), ["holdout_fraction", "rank"])  # four rows per fraction
    return rows.select("holdout_fraction", "process_id", "rank", r6(scores.distance_confidence(F.col("distance"), F.col("t"))).alias("confidence"))


def _per_rank_exact(spark, values):
    return spark.createDataFrame([(f, r, float(v)) for (f, r), v in values.items()], "holdout_fraction double, rank string, t double")


@query("f12_support_reliability", "SELECT holdout_fraction, rank, label, round(support::DOUBLE/(support+5.0::DOUBLE), 9) AS reliability FROM s_cent")
def f12(spark, sf_dir):
    c = specimen_model(spark, sf_dir).centroids
    return c.select("holdout_fraction", "rank", "label", r9(scores.support_reliability(F.col("support"), 5.0)).alias("reliability"))


@query(
    "f13_mapped_confidence",
    """SELECT holdout_fraction, process_id, rank, round(CASE WHEN rank='order' THEN m.acc ELSE confidence END, 6) AS confidence FROM s_ours
    LEFT JOIN (SELECT 'order' AS rank, avg((nearest=truth)::INT) AS acc FROM s_ours WHERE split='val' AND rank='order' HAVING min(nearest=truth) = max(nearest=truth)) m USING (rank)""",
)
def f13(spark, sf_dir):
    """Attach a map for one rank (all validation rows are right there, so it is constant); others keep raw scores."""
    val = calibration.correctness(long_form(specimen_predictions(spark, sf_dir), "ours")).where("split = 'val' AND rank = 'order'")
    model = specimen_model(spark, sf_dir).with_calibrators({"order": calibration.fit_map(val)})
    mapped = fallback.predict(model, E.query_rows(specimen_rows(spark, sf_dir)))
    return long_form(mapped, "ours").select("holdout_fraction", "process_id", "rank", r6("confidence").alias("confidence"))


@query("f14_taxonomy_fill", 'SELECT holdout_fraction, process_id, predicted_rank, species, genus, family, "order" FROM s_pred')
def f14(spark, sf_dir):
    return specimen_predictions(spark, sf_dir).select("holdout_fraction", "process_id", "predicted_rank", *RANKS)


_RECORD = """SELECT p.holdout_fraction, p.process_id, p.predicted_rank, p.is_novel, p.closest AS closest_relative, p.species, p.genus, p.family, p."order",
    string_agg(f.rank||'='||f.label||':'||CAST(round(f.confidence*1e6) AS BIGINT)||':'||f.support, ',' ORDER BY f.rank) AS per_rank,
    any_value(t.sp) AS nearest_species, any_value(t.ge) AS nearest_genera
    FROM {p}pred p JOIN {p}conf f USING (holdout_fraction, process_id)
    JOIN (SELECT holdout_fraction, process_id, string_agg(label, ',' ORDER BY rn) FILTER (rank='species') AS sp, string_agg(label, ',' ORDER BY rn) FILTER (rank='genus') AS ge FROM {p}place WHERE rn<=5 GROUP BY ALL) t USING (holdout_fraction, process_id)
    GROUP BY ALL"""


def prediction_records(predictions):
    """A prediction flattened to scalars and short texts."""
    per_rank = F.array_join(
        F.array(*[
            F.concat(F.lit(f"{r}="), F.col("nearest")[r], F.lit(":"), F.round(F.col("confidence")[r] * 1e6).cast("long"), F.lit(":"), F.col("support")[r])
            for r in sorted(RANKS)
        ]),
        ",",
    )
    return predictions.select(
        "holdout_fraction", "process_id", "predicted_rank", "is_novel", F.col("closest_relative_species").alias("closest_relative"), *RANKS,
        per_rank.alias("per_rank"),
        F.array_join(F.transform("nearest_species", lambda h: h["label"]), ",").alias("nearest_species"),
        F.array_join(F.transform("nearest_genera", lambda h: h["label"]), ",").alias("nearest_genera"),
    )


@query("f15_prediction_record", _RECORD.format(p="s_"))
def f15(spark, sf_dir):
    return prediction_records(specimen_predictions(spark, sf_dir))


# one random split, everything classified
DEPLOYED = {
    "w_role": "SELECT *, 0.0::DOUBLE AS holdout_fraction, CASE WHEN rn <= ceil(n*0.15::DOUBLE) THEN 'val' ELSE 'train' END AS role FROM (SELECT *, row_number() OVER (ORDER BY md5('42|'||process_id), process_id) rn, count(*) OVER () n FROM specimens)",
    "w_rows": "SELECT * EXCLUDE (rn, n, role), role AS split FROM w_role UNION ALL BY NAME SELECT * REPLACE ('R'||process_id AS process_id) , 'read' AS split FROM (SELECT *, 0.0::DOUBLE AS holdout_fraction FROM specimens)",
} | fallback_of("w_rows", 64, "w_")
DEPLOYED["w_read"] = "SELECT * FROM w_pred WHERE split='read'"
DEPLOYED_SQL = _RECORD.format(p="w_").replace("FROM w_pred p", "FROM w_read p")


def deployed(spark, sf_dir):
    return shared(spark, sf_dir, "deployed", lambda: deployment.deploy(D.specimens(spark, sf_dir), encoder=None))


def reads(spark, sf_dir):
    return D.specimens(spark, sf_dir).select(F.concat(F.lit("R"), "process_id").alias("process_id"), "lat", "lon", "vec")


@query("f16_deployed_scoring", DEPLOYED_SQL, **DEPLOYED)
def f16(spark, sf_dir):
    return prediction_records(deployment.classify(deployed(spark, sf_dir), reads(spark, sf_dir)))


# the same for barcodes, encoded by the deployment itself
SEQUENCES = K2 | {
    "v_known": "SELECT * FROM clean JOIN dense2 USING (process_id)",
    "v_role": DEPLOYED["w_role"].replace("specimens", "v_known"),
    "v_rows": DEPLOYED["w_rows"].replace("w_role", "v_role").replace("specimens", "v_known"),
} | fallback_of("v_rows", 16, "v_")
SEQUENCES["v_read"] = "SELECT * FROM v_pred WHERE split='read'"
SEQUENCES_SQL = _RECORD.format(p="v_").replace("FROM v_pred p", "FROM v_read p")


def deployed_sequences(spark, sf_dir):
    def build():
        return deployment.deploy(cleaned_barcodes(spark, sf_dir), encoder="kmer_pca", k=2, n_components=16)

    return shared(spark, sf_dir, "deployed-sequences", build)


def sequence_reads(spark, sf_dir):
    return cleaned_barcodes(spark, sf_dir).select(F.concat(F.lit("R"), "process_id").alias("process_id"), "lat", "lon", "sequence")


@query("f16_sequence_deployment", SEQUENCES_SQL, **SEQUENCES)
def f16_sequences(spark, sf_dir):
    """Reads come as sequences; the deployment's own encoder makes their vectors."""
    return prediction_records(deployment.classify(deployed_sequences(spark, sf_dir), sequence_reads(spark, sf_dir)))


CASCADE = K2 | {"k_rows": "SELECT r.*, d.vec FROM k2_rows r JOIN dense2 d USING (process_id)"}


def barcode_vectors(spark, sf_dir):
    """Cleaned barcodes under every fraction's split (half of the seen rows validate) with 2-mer frequencies."""

    def build():
        rows = cleaned_barcodes(spark, sf_dir)
        split = P.assign_roles(rows, val_fraction=0.5).withColumnRenamed("role", "split")
        return stage(kmer_vectors(split, 2), "barcode-vectors")

    return shared(spark, sf_dir, "barcode-vectors", build)


def _cascade_sql():
    from taxaspark.catalog.sql import splits_of

    return CASCADE | splits_of("clean", val="0.5", prefix="k2_") | fallback_of("k_rows", 16, "k_")


@query(
    "f10_barcode_cascade",
    "SELECT holdout_fraction, split, predicted_rank, count(*) AS n, count(*) FILTER (is_novel) AS n_novel FROM k_pred GROUP BY ALL",
    **_cascade_sql(),
)
def f10_barcodes(spark, sf_dir):
    """Clean → split → k-mer vectors → centroids → thresholds → cascade, counted per committed rank."""
    predictions = E.fallback_predictions(barcode_vectors(spark, sf_dir))
    return predictions.groupBy("holdout_fraction", "split", "predicted_rank").agg(
        F.count("*").alias("n"), F.count_if("is_novel").alias("n_novel")
    )
