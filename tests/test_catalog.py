"""The driver's contract, and a sample of queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")

SAMPLE = (
    "a2_ndjson_scan", "b8_dedupe", "b11_funnel_counts", "b13_pasted_text", "c4_split_metadata", "c5_all_splits", "d2_kmer_frequencies",
    "d8_triplets", "e8_nearest_species", "f9_thresholds", "f15_prediction_record", "f16_deployed_scoring", "g3_bayes_rank_confidence",
    "g4_nearest_row", "g7_similarity_search", "g9_identity_gate", "h3_bootstrap_interval", "h11_method_table", "i4_rank_reports",
    "i5_isotonic_map", "j5_curve_at", "j10_rank_states", "k1_stream_ingest",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["holdout_fraction", "split", "predicted_rank", "n", "n_novel"]
    assert out.count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.oracle_sql()) >= 0.8 * len(contract.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_statement(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    want = duck.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())
