"""Comparison methods (G): naive Bayes, single nearest neighbour, similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaspark import RANKS
from taxaspark.catalog.classification import specimen_rows
from taxaspark.catalog.features import FREQ, TOKENS
from taxaspark.catalog.registry import query, r6, shared
from taxaspark.catalog.tables_and_cleaning import cleaned_barcodes
from taxaspark.operators import naive_bayes, nearest_neighbor, similarity
from taxaspark.operators import splits as P
from taxaspark.operators.kmers import kmer_alphabet, kmer_vectors
from taxaspark.plans import evaluation as E
from taxaspark.session import stage


def barcode_split(spark, sf_dir):
    """Cleaned barcodes with 30, 50 and 70 % of the genera held out."""

    def build():
        rows = cleaned_barcodes(spark, sf_dir)
        return stage(P.assign_roles(rows).withColumnRenamed("role", "split"), "barcode-split")

    return shared(spark, sf_dir, "barcode-split", build)


NB_K = 3
NB = {
    "nb_tokens": TOKENS.format(k=NB_K, src="clean"),
    "nb_freq": FREQ.format(tokens="nb_tokens"),
    "nb_train": "SELECT f.*, r.holdout_fraction, r.species FROM nb_freq f JOIN b_rows r USING (process_id) WHERE r.split='train'",
    "nb_size": "SELECT holdout_fraction, count(*) AS n FROM b_rows WHERE split='train' GROUP BY ALL",
    "nb_class": "SELECT holdout_fraction, species, count(*) AS support, ln(count(*)::DOUBLE/any_value(n)) AS log_prior, "
    'arg_min(genus, process_id) AS genus, arg_min(family, process_id) AS family, arg_min("order", process_id) AS "order" '
    "FROM b_rows JOIN nb_size USING (holdout_fraction) WHERE split='train' GROUP BY holdout_fraction, species",
    "nb_sum": "SELECT holdout_fraction, species, kmer, sum(freq) AS s FROM nb_train GROUP BY ALL",
    "nb_mass": "SELECT holdout_fraction, species, sum(s) AS mass FROM nb_sum GROUP BY ALL",
    "nb_words": "SELECT a||b||c AS kmer FROM (SELECT unnest(['A','C','G','T']) a), (SELECT unnest(['A','C','G','T']) b), (SELECT unnest(['A','C','G','T']) c)",
    "nb_theta": f"SELECT c.holdout_fraction, c.species, w.kmer, ln((coalesce(s, 0)+1.0::DOUBLE)/(coalesce(mass, 0)+{4**NB_K})) AS log_theta, c.log_prior FROM nb_class c CROSS JOIN nb_words w "
    "LEFT JOIN nb_sum USING (holdout_fraction, species, kmer) LEFT JOIN nb_mass m ON m.holdout_fraction=c.holdout_fraction AND m.species=c.species",
    "nb_query": "SELECT q.holdout_fraction, q.process_id, t.species, sum(f.freq*t.log_theta)+any_value(t.log_prior) AS joint FROM b_rows q JOIN nb_freq f USING (process_id) "
    "JOIN nb_theta t ON t.holdout_fraction=q.holdout_fraction AND t.kmer=f.kmer WHERE q.split<>'train' GROUP BY ALL",
    "nb_post": "SELECT holdout_fraction, process_id, species, genus, family, \"order\", joint, exp(joint-top)/sum(exp(joint-top)) OVER (PARTITION BY holdout_fraction, process_id) AS p "
    "FROM (SELECT *, max(joint) OVER (PARTITION BY holdout_fraction, process_id) AS top FROM nb_query) JOIN nb_class USING (holdout_fraction, species)",
    "nb_call": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY holdout_fraction, process_id ORDER BY joint DESC, species) AS rn FROM nb_post) WHERE rn=1",
}


def nb_rows(spark, sf_dir):
    return shared(spark, sf_dir, "nb-rows", lambda: stage(kmer_vectors(barcode_split(spark, sf_dir), NB_K), "nb-rows"))


def nb_model(spark, sf_dir):
    return shared(spark, sf_dir, "nb-model", lambda: naive_bayes.fit(E.train_rows(nb_rows(spark, sf_dir))))


@query("g1_bayes_fit", "SELECT holdout_fraction, species, kmer, round(log_theta, 6) AS log_theta, round(log_prior, 6) AS log_prior FROM nb_theta", **NB)
def g1(spark, sf_dir):
    p = naive_bayes.parameters(nb_model(spark, sf_dir), kmer_alphabet(NB_K))
    return p.select("holdout_fraction", "species", "kmer", r6("log_theta").alias("log_theta"), r6("log_prior").alias("log_prior"))


@query("g2_bayes_predict", 'SELECT holdout_fraction, process_id, species, genus, family, "order", round(p, 6) AS posterior FROM nb_call', **NB)
def g2(spark, sf_dir):
    out = naive_bayes.predict(nb_model(spark, sf_dir), E.query_rows(nb_rows(spark, sf_dir)))
    return out.select("holdout_fraction", "process_id", *RANKS, r6(F.col("confidence")["species"]).alias("posterior"))


@query(
    "g3_bayes_rank_confidence",
    """SELECT c.holdout_fraction, c.process_id, round(sum(p.p) FILTER (p.species=c.species), 6) AS species, round(sum(p.p) FILTER (p.genus=c.genus), 6) AS genus,
    round(sum(p.p) FILTER (p.family=c.family), 6) AS family, round(sum(p.p) FILTER (p."order"=c."order"), 6) AS "order" FROM nb_call c JOIN nb_post p USING (holdout_fraction, process_id) GROUP BY ALL""",
    **NB,
)
def g3(spark, sf_dir):
    out = naive_bayes.predict(nb_model(spark, sf_dir), E.query_rows(nb_rows(spark, sf_dir)))
    return out.select("holdout_fraction", "process_id", *[r6(F.col("confidence")[r]).alias(r) for r in RANKS])


def specimen_neighbors(spark, sf_dir):
    return shared(spark, sf_dir, "nn-model", lambda: nearest_neighbor.fit(E.train_rows(specimen_rows(spark, sf_dir))))


def specimen_neighbor_calls(spark, sf_dir):
    def build():
        model = specimen_neighbors(spark, sf_dir)
        return stage(nearest_neighbor.predict(model, E.query_rows(specimen_rows(spark, sf_dir))), "nn-pred")

    return shared(spark, sf_dir, "nn-predictions", build)


@query(
    "g4_nearest_row",
    'SELECT holdout_fraction, process_id, nearest_id, round(d, 6) AS distance, species, genus, family, "order" FROM s_nncall',
)
def g4(spark, sf_dir):
    out = specimen_neighbor_calls(spark, sf_dir)
    return out.select("holdout_fraction", "process_id", "nearest_id", r6("nearest_distance").alias("distance"), *RANKS)


@query("g5_distance_scale", "SELECT holdout_fraction, round(scale, 6) AS scale FROM s_nnscale")
def g5(spark, sf_dir):
    scales = specimen_neighbors(spark, sf_dir).scales
    return spark.createDataFrame(list(scales.items()), "holdout_fraction double, scale double").withColumn("scale", r6("scale"))


@query("g6_neighbour_confidence", "SELECT holdout_fraction, process_id, round(confidence, 6) AS confidence FROM s_nncall")
def g6(spark, sf_dir):
    out = specimen_neighbor_calls(spark, sf_dir)
    return out.select("holdout_fraction", "process_id", r6(F.col("confidence")["species"]).alias("confidence"))


def indexed_neighbors(spark, sf_dir):
    """The same model through the metric index, whatever share of the pairs it leaves."""

    def build():
        return nearest_neighbor.fit(E.train_rows(specimen_rows(spark, sf_dir)), by_index=True, most_pairs=None)

    return shared(spark, sf_dir, "nn-indexed", build)


@query(
    "g4_indexed_nearest_row",
    'SELECT holdout_fraction, process_id, nearest_id, round(d, 6) AS distance, species, genus, family, "order", round(confidence, 6) AS confidence FROM s_nncall',
)
def g4_indexed(spark, sf_dir):
    out = nearest_neighbor.predict(indexed_neighbors(spark, sf_dir), E.query_rows(specimen_rows(spark, sf_dir)), most_pairs=None)
    score = r6(F.col("confidence")["species"]).alias("confidence")
    return out.select("holdout_fraction", "process_id", "nearest_id", r6("nearest_distance").alias("distance"), *RANKS, score)


@query("g5_indexed_distance_scale", "SELECT holdout_fraction, round(scale, 6) AS scale FROM s_nnscale")
def g5_indexed(spark, sf_dir):
    scales = indexed_neighbors(spark, sf_dir).scales
    return spark.createDataFrame(list(scales.items()), "holdout_fraction double, scale double").withColumn("scale", r6("scale"))


W = similarity.WORD
SEGMENTS = {
    # A pair of sequences is scored once for all fractions in which they are a query and a subject.
    "w_text": "SELECT sequence, row_number() OVER (ORDER BY sequence) AS no FROM (SELECT DISTINCT sequence FROM b_rows)",
    "w_role": "SELECT r.holdout_fraction, r.split='train' AS is_s, t.no, min(process_id) AS id FROM b_rows r JOIN w_text t USING (sequence) GROUP BY ALL",
    "w_word": f"SELECT no, i, substr(sequence, i+1, {W}) AS seed, CASE WHEN i>0 AND substr(sequence, i, 1) IN ('A','C','G','T') THEN substr(sequence, i, 1) ELSE '' END AS prev "
    f"FROM (SELECT *, unnest(range(0, length(sequence)-{W}+1)) AS i FROM w_text) WHERE regexp_full_match(substr(sequence, i+1, {W}), '[ACGT]+')",
    "w_near": "SELECT DISTINCT q.no AS q, s.no AS s, q.i-s.i AS diag FROM w_word q JOIN w_word s USING (seed) WHERE q.prev='' OR q.prev<>s.prev",
    "w_pair": "SELECT DISTINCT n.q, n.s, n.diag FROM w_near n JOIN w_role a ON a.no=n.q AND NOT a.is_s JOIN w_role b ON b.no=n.s AND b.is_s AND b.holdout_fraction=a.holdout_fraction",
    "w_base": """SELECT p.q, p.s, p.diag, j, CASE WHEN substr(p.a, j+1, 1)=substr(p.b, j-p.diag+1, 1) AND substr(p.a, j+1, 1) IN ('A','C','G','T') THEN 1 ELSE -2 END AS step
        FROM (SELECT p.*, a.sequence AS a, b.sequence AS b, unnest(range(greatest(diag, 0), least(length(a.sequence), length(b.sequence)+diag))) AS j
          FROM w_pair p JOIN w_text a ON a.no=p.q JOIN w_text b ON b.no=p.s) p""",
    "w_sum": "SELECT q, s, diag, j, sum(step) OVER w AS total, sum(step) OVER w - step AS before FROM w_base WINDOW w AS (PARTITION BY q, s, diag ORDER BY j)",
    "w_low": "SELECT q, s, diag, j, total, min(before*100000-j) OVER (PARTITION BY q, s, diag ORDER BY j) AS low FROM w_sum",
    "w_gain": "SELECT q, s, diag, j, (-low)%100000 AS start, CASE WHEN (-low)%100000 < 0 THEN (-low)%100000+100000 ELSE (-low)%100000 END AS st, total, low FROM w_low",
    "w_seg": "SELECT q, s, diag, j, st, total-(low+st)//100000 AS score FROM w_gain",
    "w_top": "SELECT q, s, diag, max(score) AS score, arg_max(j-st+1, {'a': score, 'b': -j}) AS length FROM w_seg GROUP BY ALL",
    "w_best": """SELECT holdout_fraction, q, s, score, length, (2*length+score)//3 AS matches FROM (
        SELECT a.holdout_fraction, t.q, b.id AS s, t.score, t.length, row_number() OVER (PARTITION BY a.holdout_fraction, t.q ORDER BY t.score DESC, b.id, t.length) AS rn
        FROM w_top t JOIN w_role a ON a.no=t.q AND NOT a.is_s JOIN w_role b ON b.no=t.s AND b.is_s AND b.holdout_fraction=a.holdout_fraction) WHERE rn=1""",
    "w_db": "SELECT holdout_fraction, sum(length(sequence)) AS db_length FROM b_rows WHERE split='train' GROUP BY ALL",
    "w_hit": f"""SELECT r.holdout_fraction, r.process_id AS qseqid, b.s AS sseqid, b.score, b.length, 100.0::DOUBLE*matches/b.length AS pident, ({similarity.LAMBDA}*b.score-ln({similarity.K}))/ln(2.0::DOUBLE) AS bitscore,
        length(r.sequence)::DOUBLE*d.db_length*power(2.0::DOUBLE, -(({similarity.LAMBDA}*b.score-ln({similarity.K}))/ln(2.0::DOUBLE))) AS evalue
        FROM b_rows r JOIN w_text t USING (sequence) JOIN w_best b ON b.q=t.no AND b.holdout_fraction=r.holdout_fraction JOIN w_db d ON d.holdout_fraction=r.holdout_fraction WHERE r.split<>'train'""",
    "w_call": """SELECT r.holdout_fraction, r.process_id, h.sseqid, h.pident, h.bitscore, h.evalue, CASE WHEN h.pident>=97 THEN t.species END AS species, CASE WHEN h.pident>=97 THEN t."order" END AS "order",
        t.species AS nearest_species, CASE WHEN h.bitscore>0 THEN h.bitscore/(h.bitscore+50.0::DOUBLE) WHEN h.evalue>=0 THEN 1/(1+h.evalue) ELSE 0 END AS confidence
        FROM b_rows r LEFT JOIN (SELECT * FROM w_hit WHERE evalue<=1e-10) h ON h.holdout_fraction=r.holdout_fraction AND h.qseqid=r.process_id
        LEFT JOIN b_rows t ON t.holdout_fraction=r.holdout_fraction AND t.process_id=h.sseqid WHERE r.split<>'train'""",
}


def barcode_hits(spark, sf_dir):
    def build():
        rows = barcode_split(spark, sf_dir)
        return stage(similarity.best_hits(E.query_rows(rows), E.train_rows(rows)), "similarity")

    return shared(spark, sf_dir, "similarity", build)


@query("g7_similarity_search", "SELECT holdout_fraction, qseqid, sseqid, score, length, round(pident, 6) AS pident, round(bitscore, 6) AS bitscore FROM w_hit", **SEGMENTS)
def g7(spark, sf_dir):
    hits = barcode_hits(spark, sf_dir)
    return hits.select("holdout_fraction", "qseqid", "sseqid", "score", "length", r6("pident").alias("pident"), r6("bitscore").alias("bitscore"))


@query("g8_significant_hit", "SELECT holdout_fraction, qseqid, sseqid, round(log10(greatest(evalue, 1e-300::DOUBLE)), 6) AS log_evalue FROM w_hit WHERE evalue<=1e-10", **SEGMENTS)
def g8(spark, sf_dir):
    kept = similarity.significant(barcode_hits(spark, sf_dir))
    return kept.select("holdout_fraction", "qseqid", "sseqid", r6(F.log10(F.greatest(F.col("evalue"), F.lit(1e-300)))).alias("log_evalue"))


def barcode_calls(spark, sf_dir):
    rows = barcode_split(spark, sf_dir)
    return similarity.calls(E.query_rows(rows), similarity.significant(barcode_hits(spark, sf_dir)), E.train_rows(rows))


@query("g9_identity_gate", 'SELECT holdout_fraction, process_id, sseqid, species, "order", nearest_species FROM w_call', **SEGMENTS)
def g9(spark, sf_dir):
    out = barcode_calls(spark, sf_dir)
    return out.select("holdout_fraction", "process_id", "sseqid", "species", "order", F.col("nearest")["species"].alias("nearest_species"))


@query("g10_alignment_confidence", "SELECT holdout_fraction, process_id, round(confidence, 6) AS confidence FROM w_call", **SEGMENTS)
def g10(spark, sf_dir):
    return barcode_calls(spark, sf_dir).select("holdout_fraction", "process_id", r6(F.col("confidence")["species"]).alias("confidence"))
