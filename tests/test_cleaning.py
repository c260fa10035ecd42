import json
import re

import pytest
from pyspark.sql import functions as F

from helpers import RANKS, random_sequence
from taxaspark.functions import text as X
from taxaspark.operators import cleaning as C
from taxaspark.plans import ingest
from taxaspark.sources import raw as R
from taxaspark.sources import tables as T

LONG_ENOUGH = random_sequence(17, 611)
BASE = {"species": "Salmo trutta", "genus": "Salmo", "family": "Salmonidae", "order": "Salmoniformes", "nuc": LONG_ENOUGH}
REQUIRED = ("species", "genus", "family", "order", "nuc")


@pytest.fixture
def land(spark, tmp_path):
    """Write one array batch and its manifest; return the cleaned rows as dicts."""

    def run(records):
        batch = tmp_path / "raw" / "part-7.json"
        batch.parent.mkdir(exist_ok=True)
        batch.write_text(json.dumps(records))
        manifest = tmp_path / "manifest.json"
        manifest.write_text(json.dumps({"batch_files": ["raw\\part-7.json"]}, indent=2))
        out = ingest.clean(spark, str(manifest), str(tmp_path / "sequences"), root=str(tmp_path))
        return out, [r.asDict() for r in out.collect()]

    return run


def test_rows_without_a_required_field_go(land):
    broken = [dict(BASE, processid=f"{field}{i}", **{field: value}) for field in REQUIRED for i, value in enumerate(("", None))]
    _, rows = land([*broken[:5], dict(BASE, processid="whole"), *broken[5:]])
    assert [r["process_id"] for r in rows] == ["whole"]


def test_of_equal_pairs_the_smallest_id_stays(land):
    spellings = [LONG_ENOUGH, LONG_ENOUGH.lower(), f" {LONG_ENOUGH}\n", f"{LONG_ENOUGH[:300]}\t{LONG_ENOUGH[300:]}"]
    ids = ["Q7", "Q10", None, "Q3"]
    other = dict(BASE, species="Salmo salar", processid="Q0")
    _, rows = land([*(dict(BASE, nuc=n, processid=i) for n, i in zip(spellings, ids, strict=True)), other])
    kept = {r["species"]: r["process_id"] for r in rows}
    assert kept["Salmo salar"] == "Q0" and kept["Salmo trutta"] in ("Q10", "Q3") and len(rows) <= 3


def test_length_band_and_ambiguity_share(land):
    cases = {length: random_sequence(length, length) for length in (499, 500, 750, 751)}
    records = [dict(BASE, species=f"len {n}", nuc=s) for n, s in cases.items()]
    for n in (6, 7):
        records.append(dict(BASE, species=f"amb {n}", nuc="R" * n + random_sequence(n, 600 - n)))
    _, rows = land(records)
    assert {r["species"] for r in rows} == {"len 500", "len 750", "amb 6"}


def test_table_columns_and_coordinates(land):
    out, rows = land([dict(BASE, coord=[-33.25, 151.75], processid="K1", bin_uri="BIN:77"), dict(BASE, nuc=random_sequence(3, 640), lat=8.5, lon=-2.0, processid="K2")])
    assert out.columns == [*RANKS, "sequence", "lat", "lon", "process_id", "bin_uri"]
    got = {r["process_id"]: (r["lat"], r["lon"], r["bin_uri"]) for r in rows}
    assert got["K1"] == (-33.25, 151.75, "BIN:77") and got["K2"][:2] == (8.5, -2.0)


def test_missing_manifest_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.read_manifest(spark, str(tmp_path / "none.json"))


def test_null_pair_does_not_fall_back_to_scalars(spark):
    rows = spark.createDataFrame(
        [([None, None], 1.0, 2.0), (None, 1.0, 2.0), ([3.0], 1.0, 2.0)], "coord array<double>, lat double, lon double"
    )
    lat, lon = X.coordinates()
    assert [tuple(r) for r in rows.select(lat, lon).collect()] == [(None, None), (1.0, 2.0), (1.0, 2.0)]


def test_marker_and_cap(spark):
    rows = spark.createDataFrame(
        [("b", "", "COI-5P"), ("a", "COI-5P", "16S"), ("c", "16S", "COI-5P"), ("d", None, None)],
        "process_id string, marker_code string, marker string",
    )
    kept = C.marker_filter(rows, "COI-5P")
    assert sorted(r.process_id for r in kept.collect()) == ["a", "b"]
    assert [r.process_id for r in C.cap_records(kept, 1).collect()] == ["a"]
    assert C.marker_filter(rows, None).count() == 4
    assert C.cap_records(kept, None).count() == 2


def test_ambiguous_fraction(spark):
    rows = spark.createDataFrame([("",), ("acgt",), ("ACGN",), ("NN",)], "s string")
    assert [r[0] for r in rows.select(X.ambiguous_fraction(F.col("s"))).collect()] == [1.0, 0.0, 0.25, 1.0]


def pasted(text):
    """Header lines and white space go, letters go upper; what is left is empty, has strange signs, or is fine."""
    sequence = "".join("".join(line.split()) for line in re.split(r"[\r\n]", text.strip()) if not line.strip().startswith(">")).upper()
    strange = "".join(sorted(set(sequence) - set("ACGTN")))
    return sequence, "empty" if not sequence else "invalid_chars" if strange else None, strange


@pytest.mark.parametrize("text", ["ttga\r\nCCAG", ">seq 9 | locus\n\tgattaca\n>second\nTTT", "> only", "\n\t \r", "GATTAQA-Z", "nnnGAT", "GA TT\tACA\n", "7"])
def test_pasted_text(spark, text):
    row = C.clean_pasted_text(spark.createDataFrame([(text,)], "raw string"), "raw").first()
    sequence, error, strange = pasted(text)
    assert (row["sequence"], row.error, "".join(sorted(row.invalid))) == (sequence, error, strange)


def test_ndjson_skips_blank_lines_and_fails_on_a_bad_one(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.json").write_text('{"species": "A a"}\n\n{"species": "B b"}\n')
    assert R.read_ndjson(spark, str(good)).count() == 2
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.json").write_text('{"species": "A a"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_ndjson(spark, str(bad)).collect()


def test_pull_writes_bounded_array_batches_and_a_manifest(spark, tmp_path):
    records = spark.createDataFrame([(f"P{i:03d}", "COI-5P") for i in range(25)], "processid string, marker_code string")
    full = records.select(*[
        F.col(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in R.RAW_SCHEMA
    ])
    manifest = ingest.pull(full, str(tmp_path / "batches"), str(tmp_path / "manifest"), max_records=20, batch_size=4).first()
    assert manifest.total_records_kept == 20
    assert manifest.stopped_early_due_to_max_records is True  # also when the count is exactly the cap
    stored = R.read_raw_batches(spark, str(tmp_path / "manifest"))
    per_file = stored.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in per_file) <= 4
    assert sorted(r.processid for r in stored.collect()) == [f"P{i:03d}" for i in range(20)]


def test_sinks_write_null_for_non_finite(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 1.5)], "k string, v double")
    T.write_json_documents(df, str(tmp_path / "j"))
    back = spark.read.schema("k string, v double").json(str(tmp_path / "j"))
    assert {r.k: r.v for r in back.collect()} == {"a": None, "b": None, "c": 1.5}


def test_split_store_misses_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.read_splits(spark, str(tmp_path / "nothing"))
    rows = spark.createDataFrame([("P1", "train", 0.3)], "process_id string, role string, holdout_fraction double")
    T.write_splits(rows, str(tmp_path / "splits"))
    assert T.read_splits(spark, str(tmp_path / "splits"), 0.3).count() == 1
    with pytest.raises(FileNotFoundError):
        T.read_splits(spark, str(tmp_path / "splits"), 0.5)


def test_landed_batches_are_compressed(spark, tmp_path):
    """Long repetitive records take a fraction of their letters, and read back as they were."""
    rows = spark.createDataFrame([(f"p{i}", "ACGT" * 500 if i % 7 else None) for i in range(60)], "process_id string, sequence string").repartition(2)
    R.write_batches(rows, str(tmp_path / "lines"), 10)
    R.write_array_batches(rows, str(tmp_path / "arrays"), 10)
    for folder, read in (("lines", R.read_ndjson), ("arrays", lambda s, p: R.read_array_batches(s, [p]))):
        files = list((tmp_path / folder).glob("part-*"))
        assert len(files) >= 6 and sum(f.stat().st_size for f in files) < 51 * 2000 / 10
        assert sorted(map(tuple, read(spark, str(tmp_path / folder)).select("process_id", "sequence").collect())) == sorted(map(tuple, rows.collect()))


def test_a_sequence_is_normalised_once(spark):
    fields = ["species", "genus", "family", "order", "sequence", "lat", "lon", "process_id", "bin_uri"]
    texts = [" " + "acgt" * 130 + "\n", "ACGT" * 130, "ACGT" * 10, "N" * 60 + "ACGT" * 135, "", "   ", None, "ACGT" * 187 + "AC", "ACGT" * 187 + "ACG"]
    rows = [("s", "g", "f", "o", t, None, 1.0, f"p{i}", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(f"`{f}` {'double' if f in ('lat', 'lon') else 'string'}" for f in fields))
    out = C.clean_rows(df)
    assert out.columns == fields
    assert sorted((r.process_id, len(r.sequence)) for r in out.collect()) == [("p0", 520), ("p7", 750)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(r"(?U)^\s+|\s+$") == 1
