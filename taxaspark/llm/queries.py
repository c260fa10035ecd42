"""The registered queries of this package, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from taxaspark.llm import chat, embedding_dups, langid, mixing, ngram_join, packing, pattern_packing, pii, quality, repair, secrets, token_alignment, tree_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIXING_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS words FROM sources),
steps AS (
  SELECT 0 AS step, 0.0::DOUBLE AS per_weight, -1::BIGINT AS cut
  UNION ALL
  SELECT step + 1, CASE WHEN free > 0 AND now_cut <> cut THEN (words - held) / free ELSE per_weight END, now_cut
  FROM (SELECT any_value(step) AS step, any_value(per_weight) AS per_weight, any_value(cut) AS cut, any_value(words) AS words,
          count(*) FILTER (2.0::DOUBLE * source_size <= per_weight * weight) AS now_cut,
          coalesce(sum(2.0::DOUBLE * source_size) FILTER (2.0::DOUBLE * source_size <= per_weight * weight), 0) AS held,
          coalesce(sum(weight) FILTER (NOT 2.0::DOUBLE * source_size <= per_weight * weight), 0) AS free
        FROM steps, sources, total) WHERE now_cut <> cut),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT per_weight FROM steps ORDER BY step DESC LIMIT 1)) AS target FROM sources),
placed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS place,
    ('0x' || substr(md5('mix|' || coalesce(s.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * least(greatest(floor((place + 1)::DOUBLE * rate + start) - floor(place::DOUBLE * rate + start), floor(rate)), ceil(rate))::BIGINT AS taken FROM placed
"""


@query("op1_pii_surrogates")
def op1(spark, sf_dir):
    made = pii.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), secret="corpus")
    return made.select("doc.doc_id", "doc.text", F.size("kinds").cast("long").alias("n_entities"), F.array_join("kinds", ",").alias("kinds"))


@query("op2_mix_sources", MIXING_SQL)
def op2(spark, sf_dir):
    rows = mixing.sized(table(spark, sf_dir, "documents"), "doc_id")
    taken = mixing.sample_copies(rows, mixing.targets_of(rows))
    return taken.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _of_kind(kind: str):
    return F.size(F.filter("found", lambda s: s["kind"] == kind))


@query("op3_secrets")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.secret_spans("text", words=secrets.corpus_words(docs), whole=True).alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "guess")
    counts = [_of_kind(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_digest(base), 256).alias("base_sha256"), secrets.spans_digest(F.col("found")).alias("spans"))


EMBEDDING_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM named
"""


@query("op4_embedding_dups", EMBEDDING_SQL)
def op4(spark, sf_dir):
    found = embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs, ~held_out)
    said = docs.select("doc_id", held_out.alias("held_out"), langid.predict(model, "text").alias("said"))
    return said.select("doc_id", "held_out", F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"))


@query("op6_harmonic_packing")
def op6(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_json())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT id, n, unnest(s) AS item FROM classes),
ranked AS (SELECT id, n, item, row_number() OVER (PARTITION BY id ORDER BY freq, item) AS place
  FROM items JOIN (SELECT item, count(*) AS freq FROM items GROUP BY item) USING (item)),
prefixes AS (SELECT * FROM ranked WHERE place <= n - (9 * n + 9) // 10 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefixes a JOIN prefixes b ON a.item = b.item AND a.id < b.id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
links AS (SELECT p.a, p.b FROM pairs p JOIN classes x ON x.id = p.a JOIN classes y ON y.id = p.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 90 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
named AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(n.component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN named n ON n.id = c.id
"""


@query("op7_ngram_join", NGRAM_SQL)
def op7(spark, sf_dir):
    groups = ngram_join.linked_groups(table(spark, sf_dir, "documents"), words=3, num=9, den=10)
    return groups.select("doc_id", "n_shingles", F.col("group").alias("component_id"))


@query("op8_tree_search")
def op8(spark, sf_dir):
    found = tree_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
    + length(regexp_replace(replace(replace(role, '~', '~0'), chr(10), '~1'), '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + CASE WHEN role = 'assistant' THEN 8 ELSE 14 END AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed)
SELECT conv_id, any_value(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


@query("op9_chat_prefix_targets", CHAT_SQL)
def op9(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema))
    made = chat.examples(turns).select(
        "conv_id", "target", F.length("formatted").alias("chars"), chat.trainable_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.when(F.col("last"), chat.parsed_turns(F.col("formatted"))).alias("turns"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    made = made.select("*", F.size("turns").cast("long").alias("n"), F.sha2(told, 256).alias("told")).withColumn("n", F.when(F.col("turns").isNotNull(), F.col("n")))
    one = made.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("told").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("target", "loss")))).alias("losses"),
    )
    loss = F.array_join(F.col("losses.loss"), "")
    return one.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@query("op10_quality")
def op10(spark, sf_dir):
    made = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.select("doc.doc_id", "doc.lang", "log_perplexity", "threshold", "word_score", "word_threshold", "keep")


@query("op11_pattern_packing")
def op11(spark, sf_dir):
    pieces = pattern_packing.pack(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_json())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


REPAIR_SQL = r"""
WITH RECURSIVE
-- crc32 byte by byte, from its table of 256 remainders
remainders AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS damage FROM keyed, remainders),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS again
  FROM hashed WHERE damage <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, left(role, 1) AS initial FROM damaged),
rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS two FROM placed),
-- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
inserted(q, to_q, cost, told, lines) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'),
  (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (3, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 4, 'II', chr(10) || 'assistant:' || chr(10) || 'user:')),
edited(edit, initial, q, to_q, cost, role) AS (VALUES
  ('D', NULL, 0, 0, 3, NULL), ('D', NULL, 1, 1, 3, NULL), ('D', NULL, 2, 2, 3, NULL), ('D', NULL, 3, 3, 3, NULL),
  ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL),
  ('R', NULL, 0, 2, 2, 'user'), ('R', NULL, 1, 2, 2, 'user'), ('R', NULL, 3, 2, 2, 'user'), ('R', NULL, 2, 3, 2, 'assistant')),
dp(conv_id, place, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0, 'told': '', 'lines': ''} FROM conversations
  UNION ALL
  SELECT r.conv_id, r.place, e.to_q, min({'cost': best.cost + i.cost + e.cost + CASE WHEN r.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END,
    'told': best.told || i.told || e.edit, 'lines': best.lines || i.lines || CASE WHEN e.edit = 'D' THEN '' ELSE chr(10) || coalesce(e.role, r.role) || ':' || r.text END})
  FROM dp JOIN rows r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.place = dp.place + 1 JOIN inserted i ON i.q = dp.q JOIN edited e ON e.q = i.to_q
  WHERE (e.initial IS NULL OR e.initial = r.initial) AND (e.edit = 'D' OR r.fault IS NULL OR r.fault = 'truncated')
  GROUP BY r.conv_id, r.place, e.to_q),
sizes AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (place > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
ended AS (
  SELECT dp.conv_id, min({'cost': best.cost + i.cost, 'told': best.told || i.told, 'lines': best.lines || i.lines}) AS best
  FROM dp LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN inserted i ON i.q = dp.q
  WHERE dp.place = coalesce(s.n, 0) AND i.to_q IN (0, 3) GROUP BY dp.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.told AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
FROM ended e LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Rows lost, emptied, cut, repeated or given to the user, by a hash of conversation and turn."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    turns = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = turns.where("damage <> 0").withColumn("copy", F.explode(copies))
    return kept.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = repair.faults(damaged(turns))
    edits, costs = repair.cheapest_edits(rows)
    hashes = repair.transcripts_sha256(repair.repaired(rows, edits))
    found = repair.report(rows, edits, costs).join(hashes.withColumnRenamed("conv", "__conv"), F.col("conv").eqNullSafe(F.col("__conv")), "left")
    every = turns.select("conv_id").distinct()
    made = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return made.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@lru_cache(maxsize=1)
def piece_model(path: str = public_tokenizers.path("piece_bpe_32k.model")) -> bytes:
    return Path(path).read_bytes()


@query("op13_token_alignment")
def op13(spark, sf_dir):
    byte_json = corpus_pipeline.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_alignment.align(table(spark, sf_dir, "documents"), byte_json, public_tokenizers.PATTERN, piece_model(), with_overlaps=False)
    n_a, n_b = F.size("a_ids").cast("long"), F.size("b_ids").cast("long")
    told = rows.select("doc_id", n_a.alias("n_a"), n_b.alias("n_b"), "n_groups", F.when(n_a > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "pairs", "times")
    return token_alignment.with_link_scores(told).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def load():
    return QUERIES, ORACLES
