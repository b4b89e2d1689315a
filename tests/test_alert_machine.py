"""The alert state machine of a stream against a plain one, its state's expiry, late rows, and counters over many batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wardspan.streaming import alert_machine as AM
from wardspan.streaming.run import counters_of, drain_to_table

SCHEMA = "patient string, alert string, ts timestamp, kind string, severity string"
START = dt.datetime(2024, 1, 1)


def files_stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def plain(rows, hours=4, escalate_after=3):
    """Alerts by applying one row after the other."""
    held, out = {}, []
    for patient, alert, ts, kind, severity in rows:
        bucket = ts.replace(hour=ts.hour // hours * hours, minute=0, second=0)
        a = held.setdefault((patient, alert, bucket), {"n": 0, "suppressed": None})
        if kind == "raise":
            if not a["n"]:
                a.update(raised=ts, severity=severity)
            a.update(n=a["n"] + 1, seen=ts)
        elif kind == "suppress":
            a["suppressed"] = a["suppressed"] or ts
        else:
            del held[patient, alert, bucket]
            if a["n"]:
                out.append((patient, alert, a["raised"], a["seen"], a["n"], a["severity"], "acknowledged"))
    for (patient, alert, _), a in held.items():
        if a["n"]:
            status = "suppressed" if a["suppressed"] else "escalated" if a["n"] >= escalate_after else "active"
            out.append((patient, alert, a["raised"], a["seen"], a["n"], a["severity"], status))
    return sorted(out)


def present(changes):
    rows = AM.present_alerts(changes).collect()
    return sorted((r.patient_ref, r.alert_type, r.raised_at, r.last_seen_at, r.repeat_count, r.severity, r.status) for r in rows)


def test_machine_equals_a_plain_one(spark, tmp_path):
    AM.use_rocksdb(spark)
    rng = random.Random(3)
    kinds = ["raise"] * 6 + ["acknowledge", "suppress"]
    rows = []
    for i in range(500):
        rows.append((rng.choice("pqr"), rng.choice("ab"), START + dt.timedelta(minutes=4 * i), rng.choice(kinds), rng.choice(["high", "medium"])))
    # borders between batches lie inside of buckets
    stream = files_stream(spark, str(tmp_path / "in"), [rows[:130], rows[130:260], rows[260:]])
    changes = drain_to_table(AM.alert_changes(stream, "patient", "alert", "ts", "kind", "severity"), "machine")
    assert present(changes) == plain(rows)


def test_state_goes_and_late_rows_are_dropped(spark, tmp_path):
    AM.use_rocksdb(spark)
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    row = lambda p, t, kind="raise": (p, "a", t, kind, "high")
    batches = [
        [row("p", at(1)), row("q", at(3))],
        # less than an hour behind the newest row of the batch before: still counted
        [row("p", at(2, 30)), row("q", at(9))],
        # the watermark is at eight hours: the first bucket is closed
        [row("p", at(1, 30)), row("p", at(2), "acknowledge"), row("q", at(9, 30))],
        [row("z", at(40))],
        [row("z", at(40, 10))],
    ]
    stream = AM.alert_changes(files_stream(spark, str(tmp_path / "in"), batches), "patient", "alert", "ts", "kind", "severity")
    q = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    progress = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    got = present(spark.read.parquet(str(tmp_path / "out")))
    assert [(p, n, s) for p, _, _, _, n, _, s in got] == [("p", 2, "active"), ("q", 1, "active"), ("q", 2, "active"), ("z", 2, "active")]
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 2
    # three buckets were closed by their timers, the last one is still open
    assert sum(p["numRowsRemoved"] for p in progress) == 3 and progress[-1]["numRowsTotal"] == 1


def test_needs_the_right_state_store(spark, tmp_path):
    stream = files_stream(spark, str(tmp_path / "in"), [[("p", "a", START, "raise", "high")]])
    old = spark.conf.get(AM.PROVIDER)
    spark.conf.set(AM.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="use_rocksdb"):
            AM.alert_changes(stream, "patient", "alert", "ts", "kind", "severity")
    finally:
        spark.conf.set(AM.PROVIDER, old)


def test_counters_of_more_than_a_hundred_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(130).repartition(130, "id").write.option("maxRecordsPerFile", 1).parquet(folder)
    files = len(list((tmp_path / "in").glob("*.parquet")))
    assert files == 130
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    drain_to_table(stream, "many", counters={"rows": F.count(F.lit(1)), "total": F.sum("id")})
    assert counters_of("many") == {"rows": 130, "total": 129 * 65}


def test_machine_reads_plain_rows():
    """One key's rows are applied as they come, without a frame per key."""
    class Held:
        value = None
        get = lambda self: self.value
        exists = lambda self: self.value is not None
        update = lambda self, v: setattr(self, "value", v)

    class Handle:
        timers, held = [], Held()
        getValueState = lambda self, *a: self.held
        registerTimer = lambda self, ms: self.timers.append(ms)

    m, h = AM.AlertMachine(4 * 3_600_000_000, 3), Handle()
    m.init(h)
    rows = [Row(us=7, kind="raise", severity="low"), Row(us=5, kind="raise", severity="high"), Row(us=6, kind="acknowledge", severity=None)]
    out = list(m.handleInputRows(("p", "a", 0), iter(rows), None))
    assert [(r.generation, r.raised_us, r.severity, r.acknowledged_us, r.status, r.version) for r in out] == [
        (0, 5, "high", 6, "acknowledged", 2), (1, 7, "low", None, "active", 3)]
    assert h.timers == [4 * 3_600_000] and h.held.value == (1, 7, 7, 1, "low", None, 3)
