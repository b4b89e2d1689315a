"""Streams against their batch forms, contract parsing, declared sources, registry rules."""

import gzip
import hashlib
import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspan.sources import tables as ST
from wardspan.streaming import observations as O
from wardspan.streaming import state as SS
from wardspan.streaming.run import drain_to_table

ROOT = pathlib.Path(__file__).resolve().parent.parent


def stream_of(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


OBS = "patient_ref string, code string, event_us long, value double, ingest_us long"


def test_window_keeps_the_last_arrivals(spark, tmp_path):
    rows = [("p", "c", (i * 37 % 50) * 60_000_000, float(i), i) for i in range(50)]
    out = drain_to_table(SS.rolling_state(stream_of(spark, tmp_path, rows, OBS), maxlen=8), "t").collect()
    got = {r["arrival"]: r for r in out}
    vals = [r[3] for r in rows]
    for i in (0, 5, 20, 49):
        w = vals[max(0, i - 7) : i + 1]
        assert got[i]["n_samples"] == len(w)
        assert got[i]["mean"] == pytest.approx(np.mean(w)) and got[i]["std"] == pytest.approx(np.std(w))


def test_throttle_ignores_late_rows(spark, tmp_path):
    minute = 60_000_000
    rows = [("p", "c", m * minute, 1.0, i) for i, m in enumerate([0, 14, 15, 3, 29, 30, 90])]
    out = drain_to_table(SS.throttle(stream_of(spark, tmp_path, rows, OBS)), "t").collect()
    assert sorted(r["event_us"] // minute for r in out) == [0, 15, 30, 90]


def test_throttle_batch_equals_greedy(spark):
    rng = np.random.default_rng(2)
    us = np.sort(rng.choice(5 * 86_400, 700, replace=False)) * 1_000_000
    d = spark.createDataFrame([(1, int(x)) for x in us], "k int, us long").select("k", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))
    got = SS.throttle_batch(d, "k", "ts", 40, 6 * 3600).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("u")).collect()
    want, last = [], None
    for x in us:
        if last is None or x - last >= 40 * 60_000_000:
            want.append(int(x))
            last = x
    assert sorted(r["u"] for r in got) == want


def test_scoring_points_use_newest_by_event_time(spark, tmp_path):
    h = 3_600_000_000
    rows = [("p", "8867-4", 0, 60.0, 0), ("p", "9269-2", 0, 15.0, 1), ("p", "9269-2", h, 7.0, 2), ("p", "8867-4", -h, 200.0, 3), ("p", "bvp", 2 * h, 1.0, 4), ("p", "8867-4", 2 * h, 80.0, 5)]
    codes = {"8867-4": "hr", "9269-2": "gcs_total"}
    out = drain_to_table(SS.scoring_points(stream_of(spark, tmp_path, rows, OBS), codes), "t").orderBy("arrival").collect()
    assert [(r["event_us"] // h, r["hr"], r["gcs_total"], r["gcs_prev_max"]) for r in out] == [(0, 60.0, None, None), (1, 60.0, 7.0, 15.0), (2, 80.0, 7.0, 15.0)]
    th = spark.createDataFrame([("__pooled__", 5, 7)], "dx_group string, icu_medium int, icu_high int")
    points = spark.createDataFrame([r.asDict() for r in out], "patient_ref string, arrival long, event_us long, hr double, gcs_total double, gcs_prev_max double")
    scored = SS.score_points(points, th).orderBy("arrival").collect()
    assert [r["escalates"] for r in scored] == [False, True, True]


def test_malformed_records_are_set_aside(spark):
    ok = {"patient_ref": "ICUStay/1", "device_id": "d", "source": "lab", "code": "c", "unit": "u", "value": 1.5, "effective_time": "2024-01-01T00:00:00", "ingest_time": "2024-01-01T00:00:01"}
    bad = [{**ok, "source": "tv"}, {**ok, "value": None}, {**ok, "quality_flags": ["odd"]}]
    raw = spark.createDataFrame([(json.dumps(ok),), ("{oops",), *[(json.dumps(b),) for b in bad]], "value string")
    good, rejected = O.parse_observations(raw)
    row = good.collect()
    assert len(row) == 1 and row[0]["code_system"] == O.LOINC and row[0]["quality_flags"] == []
    assert rejected.count() == 4


def test_grid_to_observations(spark):
    g = spark.createDataFrame([(1, "2024-01-01", 80.0, True, None, False)], "stay_id int, ts string, hr double, hr_was_imputed boolean, spo2 double, spo2_was_imputed boolean")
    out = O.wide_to_observations(g, ["hr", "spo2"], "stay_id", "ts").collect()
    assert len(out) == 1 and out[0]["code"] == "8867-4" and out[0]["quality_flags"] == ["imputed"]


def test_csv_by_name_with_missing_and_extra_columns(spark, tmp_path):
    folder = tmp_path / "hosp"
    folder.mkdir()
    with gzip.open(folder / "patients.csv.gz", "wt") as f:
        f.write('anchor_age,subject_id,note\n61,7,"a ""quoted"", text"\n,8,x\n')
    (folder / "admissions.csv").write_text("subject_id\n1\n")
    cat = ST.load_catalog(spark, str(tmp_path))
    assert set(cat) == {"patients"}
    rows = sorted((r["subject_id"], r["anchor_age"], r["gender"]) for r in cat["patients"].collect())
    assert rows == [(7, 61, None), (8, None, None)]
    digest = hashlib.sha256((folder / "patients.csv.gz").read_bytes()).hexdigest()
    man = spark.createDataFrame([("hosp/patients.csv.gz", digest), ("gone.csv.gz", "00")], "file string, sha256 string")
    assert {r["file"]: r["status"] for r in ST.verify_checksums(spark, str(tmp_path), man).collect()} == {"hosp/patients.csv.gz": "ok", "gone.csv.gz": "missing"}
    assert {r["table_name"]: r["status"] for r in ST.survey_files(spark, str(tmp_path), ["patients", "poe"]).collect()} == {"patients": "present", "poe": "missing"}


def test_export_refuses_shared_subjects(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0, "train"), (1, 3.0, "test")], "s int, x double, split string")
    with pytest.raises(ValueError, match="more than one part"):
        ST.write_training_export(d, str(tmp_path / "o"), "split", "s", ["s", "x"])
    with pytest.raises(ValueError, match="manifest"):
        ST.write_training_export(d, str(tmp_path / "o"), "split", "s", ["s"])


def test_every_oracle_has_a_query():
    from wardspan.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 250


def test_source_rules():
    """No cross joins, no local checkpoints, no row-at-a-time Python functions."""
    for p in (ROOT / "wardspan").rglob("*.py"):
        text = p.read_text()
        assert "crossJoin(" not in text and "localCheckpoint(" not in text and "F.udf(" not in text, p


def test_a_table_in_two_folders_is_read_whole(spark, tmp_path):
    for name, ids in (("hosp", "1\n2\n"), ("icu", "3\n")):
        (tmp_path / name).mkdir()
        with gzip.open(tmp_path / name / "d_items.csv.gz", "wt") as f:
            f.write("itemid\n" + ids)
    got = ST.load_catalog(spark, str(tmp_path))["d_items"].collect()
    assert sorted(r["itemid"] for r in got) == [1, 2, 3]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from wardspan.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_no_query_plans_a_cartesian_product(spark):
    """The bootstrap joins rows with the size of their stratum, also where the stratum is a literal."""
    from wardspan.operators.sampling import bootstrap_counts

    units = spark.range(50).withColumn("g", F.lit(1))
    for strata in ([], ["g"]):
        df = bootstrap_counts(units, "id", strata, 20, 3)
        assert "CartesianProduct" not in df._jdf.queryExecution().toString()
        assert df.agg(F.sum("times")).first()[0] == 50 * 20


def test_blanked_hash_breaks_the_chain(spark):
    from wardspan.operators import quality as Q

    prev, rows = Q.GENESIS, []
    for i in range(3):
        own = hashlib.sha256(f"v{i}|{prev}".encode()).hexdigest()
        rows.append((1, i, f"v{i}", prev, own))
        prev = own
    schema = "k int, seq int, v string, prev_hash string, row_hash string"
    check = lambda rs: Q.verify_hash_chain(spark.createDataFrame(rs, schema), ["k"], "seq", ["v"]).first()
    assert check(rows)["intact"] and check(rows)["first_broken"] is None
    assert check([*rows[:2], (*rows[2][:4], None)])["first_broken"] == 2
    assert check([rows[0], (*rows[1][:3], None, rows[1][4]), rows[2]])["first_broken"] == 1
