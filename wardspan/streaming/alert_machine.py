"""Alerts with acknowledgement and suppression as a stream: a state machine per (patient, type, calendar bucket).

Raised conditions and status changes arrive as one keyed stream. The state of a key is one typed row, the open alert; an event-time
timer at the bucket's end, after the watermark has passed it, removes the row, so state does not grow with time. Rows later than the
watermark are dropped by Spark. Rows of one micro-batch are applied by time, micro-batches in the order they come.

Needs the state store that holds state outside of the JVM's memory, which ``alert_changes`` checks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardspan.functions.compat import epoch_us, from_epoch_us
from wardspan.plans.alerts import BUCKET_HOURS, ESCALATE_AFTER, bucket_start

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["patient_ref", "alert_type", "bucket_us"]
OPEN = "generation long, raised_us long, seen_us long, repeat_count long, severity string, suppressed_us long, version long"
CHANGE = (
    "patient_ref string, alert_type string, bucket_us long, generation long, raised_us long, seen_us long, repeat_count long, "
    "severity string, acknowledged_us long, suppressed_us long, status string, version long"
)
_CHANGE = Row(*[c.split()[0] for c in CHANGE.split(", ")])


def use_rocksdb(spark: SparkSession) -> None:
    """Choose the state store that typed state and timers need, for streams started afterwards."""
    spark.conf.set(PROVIDER, ROCKSDB)


@contextmanager
def rocksdb_for(spark: SparkSession) -> Iterator[None]:
    """That state store for the streams started inside, the session's own afterwards."""
    old = spark.conf.get(PROVIDER)
    use_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


class AlertMachine(StatefulProcessor):
    """Changes of the alerts of one key; an acknowledgement closes the open alert, and the next condition opens another.

    A micro-batch gives one change per alert that it touches, with the alert as it is then. ``version`` grows with every row applied,
    so the change with the highest version is the alert's present form.
    """

    def __init__(self, bucket_us: int, escalate_after: int) -> None:
        self.bucket_us, self.escalate_after = bucket_us, escalate_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def _status(self, n: int, acknowledged: int | None, suppressed: int | None) -> str:
        if acknowledged is not None:
            return "acknowledged"
        if suppressed is not None:
            return "suppressed"
        return "escalated" if n >= self.escalate_after else "active"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.open.get()
        gen, raised, seen, n, severity, suppressed, version = held if held is not None else (0, None, None, 0, None, None, 0)
        # of rows at one time acknowledgements come first and rows without a kind last, as they arrived otherwise
        log = sorted(((r.us, r.kind, r.severity) for r in rows), key=lambda r: (r[0], r[1] is None, r[1]))
        out = []
        for i, (us, kind, sev) in enumerate(log, 1):
            version += 1
            if kind == "raise":
                if raised is None:
                    raised, severity = us, sev
                seen, n = max(seen or 0, us), n + 1
            elif kind == "suppress":
                suppressed = us if suppressed is None else min(suppressed, us)
            # an acknowledgement belongs to the alert that it closes
            closed = kind == "acknowledge"
            if (closed or i == len(log)) and raised is not None:
                acknowledged = us if closed else None
                out.append(_CHANGE(*key, gen, raised, seen, n, severity, acknowledged, suppressed, self._status(n, acknowledged, suppressed), version))
            if closed:
                gen, raised, seen, n, severity, suppressed = gen + 1, None, None, 0, None, None
        self.open.update((gen, raised, seen, n, severity, suppressed, version))
        if held is None:
            self.handle.registerTimer((key[2] + self.bucket_us) // 1000)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def alert_changes(
    log: DataFrame, patient: str, alert_type: str, ts: str, kind: str, severity: str, hours: int = BUCKET_HOURS,
    escalate_after: int = ESCALATE_AFTER, late: str = "1 hour",
) -> DataFrame:
    """Stream of alert changes from a stream of ``raise``, ``acknowledge`` and ``suppress`` rows; ``ts`` is a timestamp."""
    spark = log.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"typed state needs {PROVIDER}={ROCKSDB}; call use_rocksdb(spark) first")
    d = log.select(
        F.col(patient).cast("string").alias("patient_ref"), F.col(alert_type).alias("alert_type"), epoch_us(bucket_start(ts, hours)).alias("bucket_us"),
        F.col(ts).alias("ts"), epoch_us(ts).alias("us"), F.col(kind).alias("kind"), F.col(severity).alias("severity"),
    ).withWatermark("ts", late)
    machine = AlertMachine(hours * 3_600_000_000, escalate_after)
    return d.groupBy(*KEYS).transformWithState(machine, CHANGE, "append", "eventTime")


def present_alerts(changes: DataFrame) -> DataFrame:
    """Each alert as its last change left it."""
    w = Window.partitionBy(*KEYS, "generation").orderBy(F.col("version").desc())
    last = changes.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    at = {"bucket": "bucket_us", "raised_at": "raised_us", "last_seen_at": "seen_us", "acknowledged_at": "acknowledged_us", "suppressed_at": "suppressed_us"}
    times = [from_epoch_us(F.col(c)).alias(n) for n, c in at.items()]
    return last.select("patient_ref", "alert_type", *times, "repeat_count", "severity", "status")
