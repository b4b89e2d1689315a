"""Alert records: calendar-bucket de-duplication, status folding, replay evaluation.

The batch form of the alert store: raised conditions are grouped by (patient, type, bucket) with
a map-side combined aggregate, so a noisy patient costs one partial row per task and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.compat import epoch_us, from_epoch_us
from wardspan.operators.joins import asof_latest
from wardspan.operators.scan import DAY, exact_percentiles, prefix_scan, row_numbers, time_bucket

# fixed values of the alert policy
BUCKET_HOURS, ESCALATE_AFTER = 4, 3


def bucket_start(ts: Column | str, hours: int = BUCKET_HOURS) -> Column:
    """Start of the calendar block (00, 04, 08, ...) a time falls in."""
    width = hours * 3_600_000_000
    return from_epoch_us(F.floor(epoch_us(ts) / F.lit(width)).cast("long") * F.lit(width))


def dedup_key(patient: Column, alert_type: Column, ts: Column | str) -> Column:
    return F.concat_ws(":", patient, alert_type, F.date_format(bucket_start(ts), "yyyy-MM-dd'T'HH:mm:ss"))


def dedup_alerts(
    raised: DataFrame, patient: str, alert_type: str, ts: str, severity: str, hours: int = BUCKET_HOURS,
    escalate_after: int = ESCALATE_AFTER,
) -> DataFrame:
    """One alert per (patient, type, calendar bucket): first and last time, count, status.

    The first condition in a bucket fixes the severity; from ``escalate_after`` on it escalates.
    """
    b = bucket_start(ts, hours).alias("bucket")
    g = raised.groupBy(patient, alert_type, b).agg(
        F.min(ts).alias("raised_at"),
        F.max(ts).alias("last_seen_at"),
        F.count(F.lit(1)).alias("repeat_count"),
        F.min_by(severity, ts).alias("severity"),
    )
    status = F.when(F.col("repeat_count") >= escalate_after, "escalated").otherwise("active")
    return g.withColumn("status", status)


def alert_history(
    log: DataFrame,
    patient: str,
    alert_type: str,
    ts: str,
    kind: str,
    severity: str,
    hours: int = BUCKET_HOURS,
    escalate_after: int = ESCALATE_AFTER,
) -> DataFrame:
    """Alerts with acknowledgements: ``kind`` is ``raise``, ``acknowledge`` or ``suppress``.

    Within a bucket an acknowledgement closes the open alert and the next condition opens a new
    one; a suppressed alert keeps absorbing repeats and never escalates by itself.
    """
    keys = [patient, alert_type, "bucket"]
    d = log.withColumn("bucket", bucket_start(ts, hours))
    b = time_bucket(ts, 60 * 5)
    ack = (F.col(kind) == "acknowledge").cast("int")
    d = prefix_scan(d, keys, [ts], b, {"__acks": ("sum", ack)})
    # the acknowledgement itself belongs to the alert it closes
    d = d.withColumn("__gen", F.col("__acks") - ack)
    is_raise = F.col(kind) == "raise"
    g = d.groupBy(*keys, "__gen").agg(
        F.min(F.when(is_raise, F.col(ts))).alias("raised_at"),
        F.max(F.when(is_raise, F.col(ts))).alias("last_seen_at"),
        F.count(F.when(is_raise, 1)).alias("repeat_count"),
        F.min_by(F.when(is_raise, F.col(severity)), F.when(is_raise, F.col(ts))).alias("severity"),
        F.max(F.when(F.col(kind) == "acknowledge", F.col(ts))).alias("acknowledged_at"),
        F.min(F.when(F.col(kind) == "suppress", F.col(ts))).alias("suppressed_at"),
    )
    status = (
        F.when(F.col("acknowledged_at").isNotNull(), "acknowledged")
        .when(F.col("suppressed_at").isNotNull(), "suppressed")
        .when(F.col("repeat_count") >= escalate_after, "escalated")
        .otherwise("active")
    )
    return g.filter(F.col("raised_at").isNotNull()).withColumn("status", status).drop("__gen")


def fold_status(events: DataFrame, alert_id: str, ts: str, field: str, value: str) -> DataFrame:
    """Current value per field from an update log: the latest update of each field wins."""
    at = F.col(ts)
    pick = lambda f, v: F.max_by(v, F.when(F.col(field) == f, at))
    return events.groupBy(alert_id).agg(
        F.coalesce(pick("status", F.col(value)), F.lit("active")).alias("status"),
        pick("severity", F.col(value)).alias("severity"),
        pick("acknowledged_by", F.col(value)).alias("acknowledged_by"),
        F.max(ts).alias("updated_at"),
    )


def regrade(severity: Column, assessable: Column, grade: Column, in_scope: Column) -> Column:
    """Model grade only for an assessable, graded and in-scope alert; otherwise as raised."""
    use = F.coalesce(assessable, F.lit(False)) & grade.isNotNull() & F.coalesce(in_scope, F.lit(False))
    return F.when(use, grade).otherwise(severity)


def inbox_order(severity: str, ts: str) -> list[Column]:
    rank = F.when(F.col(severity) == "high", 0).when(F.col(severity) == "medium", 1).otherwise(2)
    return [rank, F.col(ts).desc()]


def inbox(alerts: DataFrame, severity: str, ts: str, ident: str, status: str = "status", open_: tuple[str, ...] = ("active", "escalated")) -> DataFrame:
    """All open alerts with their ``position``: by severity, newest first. No limit; paging is up to the reader."""
    d = alerts.filter(F.col(status).isin(*open_))
    rank = F.when(F.col(severity) == "high", 0).when(F.col(severity) == "medium", 1).otherwise(2)
    # one slice per severity and day; an alert without a time comes last of its severity
    day = F.coalesce(-time_bucket(ts), F.lit(1 << 39))
    return row_numbers(d, [], [*inbox_order(severity, ts), ident], rank.cast("long") * (1 << 40) + day, "position")


def lead_time(alerts: DataFrame, events: DataFrame, key: str, raised: str, event: str) -> DataFrame:
    """Per event: the last alert strictly before it and the hours between (NULL if none)."""
    out = asof_latest(
        events, alerts.select(key, F.col(raised).alias("last_alert_at")), [key], event,
        "last_alert_at", ["last_alert_at"], strict=True,
    )
    hours = (epoch_us(event) - epoch_us("last_alert_at")) / F.lit(3.6e9)
    return out.withColumn("lead_h", hours)


def lead_time_summary(leads: DataFrame) -> DataFrame:
    d = leads.withColumn("__g", F.lit(1))
    med = exact_percentiles(d, ["__g"], "lead_h", {"median_lead_h": 0.5})
    n = d.groupBy("__g").agg(F.count("lead_h").alias("n_covered"), F.count(F.lit(1)).alias("n_events"))
    out = n.join(med, "__g", "left").drop("__g")
    return out.withColumn("coverage", F.col("n_covered") / F.col("n_events"))


def false_alarms_by_hour(
    alerts: DataFrame, first_events: DataFrame, key: str, raised: str, event: str, horizon_h: int = 12
) -> DataFrame:
    """Share of alerts per hour of day not followed by the entity's first event in time."""
    j = alerts.select(key, raised).join(first_events.select(key, event), key, "left")
    ahead = epoch_us(event) - epoch_us(raised)
    hit = F.coalesce((ahead >= 0) & (ahead <= horizon_h * 3_600_000_000), F.lit(False))
    g = j.groupBy(F.hour(F.col(raised)).alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("n_alerts"), F.count(F.when(hit, 1)).alias("n_true")
    )
    return g.withColumn("false_alarm_rate", 1 - F.col("n_true") / F.col("n_alerts"))


def normalized_rate(counts: DataFrame, baseline: DataFrame, family: str, n: str, hours: float) -> DataFrame:
    """Observed rate over the family's baseline; 0 where the baseline is not positive."""
    if hours <= 0:
        raise ValueError("window length must be positive")
    out = counts.join(baseline.select(family, "stationary_rate"), family, "left")
    base = F.col("stationary_rate")
    rate = F.when(base <= 0, F.lit(0.0)).otherwise(F.col(n) / F.lit(float(hours)) / base)
    return out.withColumn("normalized_rate", rate).drop("stationary_rate")


__all__ = [
    "DAY", "alert_history", "bucket_start", "dedup_alerts", "dedup_key", "false_alarms_by_hour",
    "fold_status", "inbox_order", "lead_time", "lead_time_summary", "normalized_rate", "regrade",
]
