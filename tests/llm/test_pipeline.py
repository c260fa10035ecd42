import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, rows_of
from taxaspark.llm import packing, secrets
from taxaspark.llm.queries import load
from test_ngram_join import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, FOLDER).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return out


def test_stages_in_order_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(df.columns == COLUMNS for df in kept[:-1])


def test_quality_keeps_what_is_labelled_good(spark, kept):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    ids = {r["doc_id"] for r in kept[0].select("doc_id").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & ids) >= 0.95 * len(good) and len(ids) < spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_one_of_each_group_stays(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept[0].collect()]
    want = {g if n else rows[i][0] for i, (n, g) in brute(rows, 5, 8, 10).items()}
    assert sorted(r["doc_id"] for r in kept[1].collect()) == sorted(want)


def test_secrets_are_masked(kept):
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in kept[1:3])
    assert before.keys() == after.keys()
    for k, r in before.items():
        text, at = "", 0
        for start, _, end in secrets.all_spans(r["text"]):
            if start >= at:
                text += r["text"][at:start] + secrets.MASK
            at = max(at, end)
        assert after[k]["text"] == text + r["text"][at:]
        assert after[k]["n_chars"] == len(after[k]["text"])


def test_sources_near_their_targets(kept):
    count = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    before, after = count(kept[2]), count(kept[3])
    assert sum(after.values()) == pytest.approx(1.5 * sum(before.values()), rel=0.2)
    assert set(map(tuple, kept[3].collect())) <= set(map(tuple, kept[2].collect()))


def test_packed_ids_are_those_of_the_texts(kept):
    encode = packing.WordEncoder(corpus_pipeline.tokenizer_json())
    want = {r["doc_id"]: encode(r["text"]) + b"\x02\x00\x00\x00" for r in kept[3].collect()}
    total = sum(len(want[r["doc_id"]]) // 4 for r in kept[3].collect())
    pieces = kept[4].collect()
    assert sum(p["length"] for p in pieces) == total
    for p in pieces:
        assert bytes(p["ids"]) == want[p["doc_id"]][4 * p["start"] : 4 * (p["start"] + p["length"])]


def test_run_gives_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == kept[-1].columns and got.count() == kept[-1].count()


def test_queries_equal_their_statements(spark):
    queries, oracles = load()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries if q != "pipeline"}
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in oracles.items():
        df, want = queries[name](spark, FOLDER), duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns), name
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall()), name


def test_nothing_else_needs_this_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['taxaspark.llm'] = None; import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()); print(len(e.queries()))"
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) >= 129


