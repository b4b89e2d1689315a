"""Outcome labels: component events, first event, at-risk censoring, return cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions.compat import date_diff_boundaries, epoch_us
from wardspan.operators.scan import DAY, prefix_scan, time_bucket
from wardspan.operators.windows import prior_counts


def death_events(stays: DataFrame, admissions: DataFrame) -> DataFrame:
    """A death in hospital belongs to the last stay of the admission."""
    dead = stays.filter(F.col("hospital_expire_flag") == 1)
    last = dead.groupBy("hadm_id").agg(F.max_by("stay_id", "icustay_seq").alias("stay_id"))
    j = last.join(admissions.select("hadm_id", "deathtime"), "hadm_id")
    return j.select("stay_id", F.col("deathtime").alias("event_time"))


def first_start(intervals: DataFrame, start: str = "starttime") -> DataFrame:
    return intervals.groupBy("stay_id").agg(F.min(start).alias("event_time"))


def bounce_backs(stays: DataFrame, hours: float = 72.0) -> DataFrame:
    """Next stay of the same admission within ``hours`` (minute marks), counted for the first."""
    rows = prefix_scan(
        stays.select("hadm_id", "stay_id", "icustay_seq", "icu_intime", "icu_outtime"),
        ["hadm_id"],
        ["icustay_seq", "stay_id"],
        F.floor(F.col("icustay_seq") / 1000).cast("long"),
        {"__in": ("next", "icu_intime"), "__sq": ("next", "icustay_seq")},
    )
    gap = date_diff_boundaries("minute", "icu_outtime", "__in") / F.lit(60.0)
    rows = rows.filter((F.col("__sq") == F.col("icustay_seq") + 1) & (gap <= hours))
    return rows.select("stay_id", F.col("__in").alias("event_time"))


def first_event(tables: Mapping[str, DataFrame], key: str = "stay_id") -> DataFrame:
    """Earliest event per entity over all tables and its type (alphabetical on equal times)."""
    parts = [df.select(key, "event_time", F.lit(n).alias("event_type")) for n, df in tables.items()]
    u = reduce(DataFrame.unionByName, parts).filter(F.col("event_time").isNotNull())
    best = F.min(F.struct("event_time", "event_type")).alias("s")
    return u.groupBy(key).agg(best).select(key, "s.*")


def at_risk_labels(
    grid: DataFrame,
    anchors: DataFrame,
    events: DataFrame,
    horizons: Sequence[int],
    key: str = "stay_id",
    hour: str = "hour",
    t0: str = "icu_intime",
) -> DataFrame:
    """Grid rows that start before the first event, with one 0/1 label per horizon in hours."""
    g = grid.select(key, hour).join(anchors.select(key, t0), key, "left").join(events, key, "left")
    start = epoch_us(t0) + F.col(hour) * F.lit(3_600_000_000)
    ahead = epoch_us("event_time") - start
    g = g.withColumn("__us", ahead).filter(F.col("__us").isNull() | (F.col("__us") > 0))
    for h in horizons:
        within = F.coalesce(F.col("__us") <= h * 3_600_000_000, F.lit(False))
        g = g.withColumn(f"label_{h}h", within.cast("int"))
    return g.drop("__us", t0)


def label_summary(labels: DataFrame, horizons: Sequence[int], key: str = "stay_id") -> DataFrame:
    """Positives, rows, prevalence and positive entities per horizon, from one pass per entity."""
    per = labels.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"label_{h}h").alias(f"p{h}") for h in horizons]
    )
    one = per.agg(
        F.sum("n").alias("n"),
        *[F.sum(f"p{h}").alias(f"p{h}") for h in horizons],
        *[F.count(F.when(F.col(f"p{h}") > 0, 1)).alias(f"e{h}") for h in horizons],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_h"), F.col(f"p{h}").alias("positive_hours"),
                F.col("n").alias("total_hours"), F.col(f"e{h}").alias("positive_stays"),
            )
            for h in horizons
        ]
    )
    out = one.select(F.inline(cells))
    return out.withColumn("prevalence", F.try_divide(F.col("positive_hours"), F.col("total_hours")))


# fixed values: the return window, the utilisation window and the excluded disposition
RETURN_DAYS, UTILISATION_DAYS, HOSPICE = 30, 365, ("HOSPICE",)


def return_cohort(
    admissions: DataFrame,
    patients: DataFrame,
    strict: bool = True,
    return_days: int = RETURN_DAYS,
    utilisation_days: int = UTILISATION_DAYS,
    excluded: Sequence[str] = HOSPICE,
) -> DataFrame:
    """One row per live discharge with its return label, history and exclusion flags.

    History runs over all admissions, also those that ended in death.
    """
    a = admissions.join(patients.select("subject_id", "dod", "gender", "anchor_age"), "subject_id")
    a = prefix_scan(
        a, ["subject_id"], ["admittime", "hadm_id"], time_bucket("admittime", 365 * DAY),
        {"__n": ("sum", F.lit(1)), "prev_dischtime": ("prev", "dischtime"), "next_admittime": ("next", "admittime")},
    )
    a = prior_counts(a, ["subject_id"], "admittime", utilisation_days, "n_prior_admissions_365d")
    day = F.lit(86_400_000_000.0)
    to_next = (epoch_us("next_admittime") - epoch_us("dischtime")) / day
    to_death = (epoch_us("dod") - epoch_us("dischtime")) / day
    a = a.withColumns(
        {
            "n_prior_admissions": (F.col("__n") - 1).cast("long"),
            "days_since_last_discharge": (epoch_us("admittime") - epoch_us("prev_dischtime")) / day,
            "days_to_next": to_next,
            "days_to_death": to_death,
            "readmit_30d": F.coalesce(to_next <= return_days, F.lit(False)).cast("int"),
        }
    ).drop("__n")
    c = a.filter(F.col("hospital_expire_flag") == 0).withColumns(
        {
            "excluded_hospice": F.coalesce(F.col("discharge_location").isin(*excluded), F.lit(False)),
            "excluded_died_before_readmit": F.coalesce(F.col("days_to_death") <= return_days, F.lit(False))
            & (F.col("readmit_30d") == 0),
            "is_last_admission": F.col("next_admittime").isNull(),
        }
    )
    return c.filter(~F.col("excluded_hospice") & ~F.col("excluded_died_before_readmit")) if strict else c


def cohort_summary(naive: DataFrame) -> DataFrame:
    """How each exclusion moves the size and the return rate; ``naive`` keeps all rows."""
    keep = {
        "all live discharges": F.lit(True),
        "less hospice": ~F.col("excluded_hospice"),
        "less died before return": ~F.col("excluded_hospice") & ~F.col("excluded_died_before_readmit"),
    }
    one = naive.agg(
        *[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(keep.values())],
        *[F.sum(F.when(c, F.col("readmit_30d")).otherwise(0)).alias(f"p{i}") for i, c in enumerate(keep.values())],
    )
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("cohort"), F.col(f"n{i}").alias("admissions"), F.col(f"p{i}").alias("readmitted_30d"))
            for i, n in enumerate(keep)
        ]
    )
    out = one.select(F.inline(cells))
    return out.withColumn("rate", F.try_divide(F.col("readmitted_30d"), F.col("admissions")))


def censoring_summary(cohort: DataFrame) -> DataFrame:
    per = cohort.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("readmit_30d").alias("p"),
        F.count(F.when(F.col("is_last_admission"), 1)).alias("c"),
    )
    n = F.sum("n")
    return per.agg(
        n.alias("admissions"), F.sum("p").alias("positives"), (F.sum("p") / n).alias("rate"),
        F.count(F.lit(1)).alias("patients"), F.avg("n").alias("admissions_per_patient_mean"),
        F.max("n").alias("admissions_per_patient_max"), F.sum("c").alias("right_censored"),
        (F.sum("c") / n).alias("right_censored_fraction"),
    )
