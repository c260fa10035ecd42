"""Sequence features (D) and distance expressions (E1–E3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from taxaspark.catalog.registry import query, r6, r9, shared, vec_key
from taxaspark.catalog.sql import geo, vec_key as sql_vec_key
from taxaspark.catalog.tables_and_cleaning import cleaned_barcodes
from taxaspark.functions.geo import haversine_km
from taxaspark.functions.vectors import euclidean, l2_normalise, triplet_hinge
from taxaspark.operators import conv, kmers
from taxaspark.operators.encoders import ALIASES, encoder_name, fit_encoder
from taxaspark.sources import derived as D

TOKENS = "SELECT process_id, species, i AS pos, substr(sequence, i+1, {k}) AS kmer FROM (SELECT *, unnest(range(0, length(sequence)-{k}+1)) AS i FROM {src}) WHERE regexp_full_match(substr(sequence, i+1, {k}), '[ACGT]+')"
FREQ = "SELECT process_id, kmer, count(*)::DOUBLE/sum(count(*)) OVER (PARTITION BY process_id) AS freq FROM {tokens} GROUP BY process_id, kmer"
ALPHABET2 = "SELECT a||b AS kmer FROM (SELECT unnest(['A','C','G','T']) a), (SELECT unnest(['A','C','G','T']) b)"
DENSE2 = "SELECT c.process_id, list(coalesce(f.freq, 0) ORDER BY c.kmer) AS vec FROM (SELECT process_id, kmer FROM {src}, alphabet2) c LEFT JOIN freq2 f USING (process_id, kmer) GROUP BY ALL"
K2 = {"tokens2": TOKENS.format(k=2, src="clean"), "freq2": FREQ.format(tokens="tokens2"), "alphabet2": ALPHABET2, "dense2": DENSE2.format(src="clean")}


@query(
    "d1_kmer_tokens",
    "SELECT kmer, species, count(*) AS n FROM tokens4 GROUP BY ALL",
    tokens4=TOKENS.format(k=4, src="barcodes"),
)
def d1(spark, sf_dir):
    tokens = kmers.kmer_tokens(D.barcodes(spark, sf_dir), 4, ["species"])
    return tokens.groupBy("kmer", "species").agg(F.count("*").alias("n"))


@query("d2_kmer_frequencies", "SELECT process_id, kmer, round(freq, 9) AS freq FROM freq2", tokens2=TOKENS.format(k=2, src="barcodes"), freq2=K2["freq2"])
def d2(spark, sf_dir):
    freqs = kmers.kmer_frequencies(D.barcodes(spark, sf_dir), 2, ["process_id"])
    return freqs.withColumn("freq", r9("freq"))


@query("d3_dense_vector", f"SELECT process_id, {sql_vec_key('vec')} AS vec FROM dense2", **{**K2, "tokens2": TOKENS.format(k=2, src="barcodes"), "dense2": DENSE2.format(src="barcodes")})
def d3(spark, sf_dir):
    return kmers.kmer_vectors(D.barcodes(spark, sf_dir), 2).select("process_id", vec_key("vec").alias("vec"))


def _pca(spark, sf_dir):
    return shared(spark, sf_dir, "pca", lambda: kmers.fit_kmer_pca(cleaned_barcodes(spark, sf_dir), 2, 16))


@query(
    "d4_pca_fit",
    "SELECT 16 AS dimensions, count(DISTINCT process_id) AS n, round(sum((f-m)*(f-m))/count(DISTINCT process_id), 6) AS total_variance FROM centred",
    **K2,
    flat="SELECT process_id, unnest(vec) AS f, generate_subscripts(vec, 1) AS pos FROM dense2",
    centred="SELECT *, avg(f) OVER (PARTITION BY pos) AS m FROM flat",
)
def d4(spark, sf_dir):
    """A full-rank fit keeps the total variance; component signs are arbitrary and not compared."""
    model = _pca(spark, sf_dir)
    out = model.transform(cleaned_barcodes(spark, sf_dir).select("process_id", "sequence"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return out.agg(F.lit(model.dimensions).alias("dimensions"), F.count("*").alias("n"), r6(F.avg(square)).alias("total_variance"))


@query(
    "d5_pca_transform",
    "SELECT process_id, round(sqrt(sum((f-m)*(f-m))), 6) AS distance_to_mean FROM centred GROUP BY ALL",
    **K2,
    flat="SELECT process_id, unnest(vec) AS f, generate_subscripts(vec, 1) AS pos FROM dense2",
    centred="SELECT *, avg(f) OVER (PARTITION BY pos) AS m FROM flat",
)
def d5(spark, sf_dir):
    """Full-rank projection keeps distances: each row's distance to the mean is that of its raw frequencies."""
    out = _pca(spark, sf_dir).transform(cleaned_barcodes(spark, sf_dir).select("process_id", "sequence"))
    return out.select("process_id", r6(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).alias("distance_to_mean"))


@query(
    "d6_one_hot",
    "SELECT channel, pos, count(*) AS n FROM (SELECT process_id, i AS pos, CASE substr(sequence, i+1, 1) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 END AS channel FROM (SELECT *, unnest(range(0, least(length(sequence), 800))) AS i FROM barcodes)) WHERE channel IS NOT NULL GROUP BY ALL",
)
def d6(spark, sf_dir):
    rows = conv.one_hot_long(D.barcodes(spark, sf_dir), ["process_id"], 800)
    return rows.groupBy("channel", "pos").agg(F.count("*").alias("n"))


CONV = {"embedding_dim": 8, "n_filters": 8, "kernel_size": 5, "epochs": 2, "batch_size": 128}


def _conv(spark, sf_dir):
    return shared(spark, sf_dir, "conv", lambda: conv.fit_conv(cleaned_barcodes(spark, sf_dir), **CONV))


def _convolution(src: str, width: str, prefix: str) -> dict[str, str]:
    """The encoder's forward pass with its first weights as relations: taps join the ones of the one-hot form.

    ``width`` is the padded length; biases are zero, so places without a one add nothing.
    """
    w = conv.initial_weights(CONV["n_filters"], CONV["kernel_size"], CONV["embedding_dim"], 42)
    p, k = prefix, CONV["kernel_size"]
    taps = ", ".join(f"({f}, {c}, {t}, {w.conv_w[f, c, t]!r}::DOUBLE)" for f, c, t in np.ndindex(*w.conv_w.shape)).replace("np.float64", "")
    dense = ", ".join(f"({f}, {d}, {w.dense_w[f, d]!r}::DOUBLE)" for f, d in np.ndindex(*w.dense_w.shape)).replace("np.float64", "")
    return {
        f"{p}taps": f"SELECT * FROM (VALUES {taps}) t(f, channel, tap, w)",
        f"{p}dense": f"SELECT * FROM (VALUES {dense}) t(f, dim, w)",
        f"{p}hot": f"SELECT process_id, i AS pos, strpos('ACGT', substr(sequence, i+1, 1))-1 AS channel FROM (SELECT *, unnest(range(0, length(sequence))) AS i FROM {src}) WHERE strpos('ACGT', substr(sequence, i+1, 1)) > 0",
        f"{p}active": f"SELECT process_id, f, pos-tap AS place, greatest(sum(w), 0) AS a FROM {p}hot JOIN {p}taps USING (channel) WHERE pos-tap BETWEEN 0 AND ({width})-{k} GROUP BY ALL",
        f"{p}pooled": f"SELECT process_id, f, sum(a)/(({width})-{k}+1) AS a FROM {p}active GROUP BY ALL",
        f"{p}pre": f"SELECT process_id, dim, sum(a*w) AS x FROM {p}pooled JOIN {p}dense USING (f) GROUP BY ALL",
        f"{p}vec": f"SELECT process_id, list(x/norm ORDER BY dim) AS vec FROM {p}pre JOIN (SELECT process_id, greatest(sqrt(sum(x*x)), 1e-9) AS norm FROM {p}pre GROUP BY ALL) USING (process_id) GROUP BY ALL",
    }


@query("d7_conv_embedding", f"SELECT process_id, {sql_vec_key('vec')} AS vec FROM d7_vec", **_convolution("clean", "750", "d7_"))
def d7(spark, sf_dir):
    """Unit vectors of the encoder with its first weights."""
    model = conv.ConvModel(conv.initial_weights(CONV["n_filters"], CONV["kernel_size"], CONV["embedding_dim"], 42), 750)
    out = model.transform(cleaned_barcodes(spark, sf_dir).select("process_id", "sequence"))
    return out.select("process_id", vec_key("vec").alias("vec"))


def _u(draw):
    return f"(('0x'||substr(md5('42|{draw}|'||triplet),1,8))::BIGINT/4294967296.0::DOUBLE)"


TRIPLETS = {
    "numbered": "SELECT process_id, species, row_number() OVER (PARTITION BY species ORDER BY md5('42|'||process_id), process_id)-1 AS row_no FROM {src}",
    "sp": "SELECT species, size, row_number() OVER (ORDER BY md5('42|'||species), species)-1 AS species_no FROM (SELECT species, count(*) AS size FROM numbered GROUP BY ALL)",
    "paired": "SELECT species, size, species_no, row_number() OVER (ORDER BY md5('42|'||species), species)-1 AS pair_no FROM sp WHERE size>=2",
    "d0": "SELECT range AS triplet, (SELECT count(*) FROM sp) AS ns, (SELECT count(*) FROM paired) AS np FROM range({n})",
    "d1x": f"SELECT d0.*, p.species_no AS a_no, p.size AS a_size FROM d0 JOIN paired p ON p.pair_no=least(floor({_u(1)}*np), np-1)",
    "d2x": f"SELECT *, least(floor({_u(2)}*a_size), a_size-1)::BIGINT AS a_row, least(floor({_u(3)}*(a_size-1)), a_size-2)::BIGINT AS b0, least(floor({_u(4)}*(ns-1)), ns-2)::BIGINT AS n0 FROM d1x",
    "d3x": "SELECT *, b0+(b0>=a_row)::INT AS b_row, n0+(n0>=a_no)::INT AS n_no FROM d2x",
    "d4x": f"SELECT d3x.*, least(floor({_u(5)}*s.size), s.size-1)::BIGINT AS n_row FROM d3x JOIN sp s ON s.species_no=d3x.n_no",
    "mem": "SELECT n.process_id, n.row_no, s.species_no FROM numbered n JOIN sp s USING (species)",
    "mined": "SELECT triplet, a.process_id AS anchor, p.process_id AS positive, n.process_id AS negative FROM d4x JOIN mem a ON a.species_no=a_no AND a.row_no=a_row "
    "JOIN mem p ON p.species_no=a_no AND p.row_no=b_row JOIN mem n ON n.species_no=n_no AND n.row_no=n_row",
}


def _triplet_sql(src: str, n: str) -> dict[str, str]:
    return TRIPLETS | {"numbered": TRIPLETS["numbered"].format(src=src), "d0": TRIPLETS["d0"].format(n=n)}


@query("d8_triplets", "SELECT triplet, anchor, positive, negative FROM mined", **_triplet_sql("clean", "2000"))
def d8(spark, sf_dir):
    return conv.mine_triplets(cleaned_barcodes(spark, sf_dir), 2000, 42)


@query(
    "d9_triplet_hinge",
    "SELECT triplet, round(greatest(g, 0), 6) AS hinge, g > 0 AS active FROM hinge",
    **_triplet_sql("specimens", "1000"),
    hinge="SELECT triplet, power(list_distance(a.vec, p.vec), 2)-power(list_distance(a.vec, n.vec), 2)+0.4 AS g FROM mined JOIN specimens a ON a.process_id=anchor JOIN specimens p ON p.process_id=positive JOIN specimens n ON n.process_id=negative",
)
def d9(spark, sf_dir):
    rows = D.specimens(spark, sf_dir)
    out = conv.mine_triplets(rows, 1000, 42)
    for side in ("anchor", "positive", "negative"):
        out = out.join(rows.select(F.col("process_id").alias(side), F.col("vec").alias(f"v_{side}")), side)
    loss = triplet_hinge(F.col("v_anchor"), F.col("v_positive"), F.col("v_negative"), 0.4)
    return out.select("triplet", r6(loss).alias("hinge"), (loss > 0).alias("active"))


@query("d10_conv_training")
def d10(spark, sf_dir):
    """Mean hinge before each data-parallel step."""
    model = _conv(spark, sf_dir)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.losses)], "step int, mean_hinge double")


@query(
    "d10_first_step",
    "SELECT 0 AS step, round(avg(greatest(power(list_distance(a.vec, p.vec), 2)-power(list_distance(a.vec, n.vec), 2)+0.4, 0)), 6) AS mean_hinge "
    "FROM mined JOIN d10_vec a ON a.process_id=anchor JOIN d10_vec p ON p.process_id=positive JOIN d10_vec n ON n.process_id=negative",
    **_triplet_sql("clean", str(CONV["batch_size"])),
    **_convolution("clean", "(SELECT max(length(sequence)) FROM clean)", "d10_"),
)
def d10_first(spark, sf_dir):
    """Mean hinge of the first step's triplets, before any weight has moved."""
    return spark.createDataFrame([(0, float(_conv(spark, sf_dir).losses[0]))], "step int, mean_hinge double").withColumn("mean_hinge", r6("mean_hinge"))


@query(
    "d11_l2_normalise",
    f"SELECT process_id, {sql_vec_key('list_transform(vec, lambda x: x/greatest(norm, 1e-9))')} AS vec FROM normed",
    normed="SELECT process_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x*x))) AS norm FROM specimens",
)
def d11(spark, sf_dir):
    return D.specimens(spark, sf_dir).select("process_id", vec_key(l2_normalise(F.col("vec"))).alias("vec"))


@query(
    "d12_encoder_choice",
    "SELECT unnest(['cnn','conv_triplet','kmer','kmer_pca','pca','triplet']) AS alias, unnest(['conv_triplet','conv_triplet','kmer_pca','kmer_pca','kmer_pca','conv_triplet']) AS encoder, "
    "unnest([8,8,4,4,4,8]) AS dimensions, (SELECT count(*) FROM clean) AS rows_encoded",
)
def d12(spark, sf_dir):
    """Rows each alias encodes, and how wide, over the cleaned table."""
    rows = cleaned_barcodes(spark, sf_dir)
    settings = {"kmer_pca": {"k": 2, "n_components": 4}, "conv_triplet": CONV | {"epochs": 1}}
    out = []
    for encoder in sorted(settings):
        model = fit_encoder(encoder, rows, **settings[encoder])
        vec = model.transform(rows.select("sequence")).agg(F.max(F.size("vec")).alias("dimensions"), F.count("*").alias("rows_encoded"))
        aliases = F.array(*[F.lit(a) for a in sorted(ALIASES) if encoder_name(a) == encoder])
        out.append(vec.select(F.explode(aliases).alias("alias"), F.lit(encoder).alias("encoder"), "dimensions", "rows_encoded"))
    return out[0].unionByName(out[1])


# --- distance expressions ----------------------------------------------------------------------


@query("e1_haversine", f"SELECT process_id, round({geo('lat', 'lon', '0.0::DOUBLE', '90.0::DOUBLE')}, 6) AS km FROM specimens")
def e1(spark, sf_dir):
    km = haversine_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(90.0))
    return D.specimens(spark, sf_dir).select("process_id", r6(km).alias("km"))


@query(
    "e2_euclidean",
    "SELECT s.process_id, round(list_distance(s.vec, c.vec), 6) AS d FROM specimens s JOIN means c USING (species)",
    cm="SELECT species, pos, avg(vec[pos]) AS m FROM specimens, range(1, 65) t(pos) GROUP BY ALL",
    means="SELECT species, list(m ORDER BY pos) AS vec FROM cm GROUP BY ALL",
)
def e2(spark, sf_dir):
    """Distance of each row to its own species' centroid."""
    from taxaspark.operators.centroids import fit_centroids

    rows = D.specimens(spark, sf_dir).withColumn("holdout_fraction", F.lit(0.0))
    means = fit_centroids(rows, ("species",)).select(F.col("label").alias("species"), F.col("vec").alias("mean"))
    return rows.join(means, "species").select("process_id", r6(euclidean(F.col("vec"), F.col("mean"))).alias("d"))
