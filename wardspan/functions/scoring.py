"""Banded scores, logistic links, tiers and the escalation rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspan.functions.compat import col, round_dec, sum_all

# --- Fixed values: early-warning bands ---------------------------------------
# Ordered (upper bound inclusive, score); the last entry has no bound.
EARLY_WARNING_BANDS: dict[str, list[tuple[float | None, int]]] = {
    "rr": [(8, 3), (11, 1), (20, 0), (24, 2), (None, 3)],
    "spo2": [(91, 3), (93, 2), (95, 1), (None, 0)],
    "sbp": [(90, 3), (100, 2), (110, 1), (219, 0), (None, 3)],
    "hr": [(40, 3), (50, 1), (90, 0), (110, 1), (130, 2), (None, 3)],
    "temp_c": [(35, 3), (36, 1), (38, 0), (39, 1), (None, 2)],
    "fio2": [(21, 0), (None, 2)],
}
# coma scale: 15 is alert (0 points), anything lower scores 3
GCS_ALERT = 15
GCS_BELOW_ALERT_SCORE = 3
RED_SCORE = 3
ESCALATION_PARAMS = ("rr", "spo2", "sbp", "hr", "temp_c", "fio2")
WARD_MEDIUM, WARD_HIGH = 5, 7
GCS_DROP_POINTS, GCS_DROP_LOOKBACK = 2, 4


def score_bands(
    c: Column | str,
    bands: Sequence[tuple[float | None, int | None]],
    op: str = "<=",
    null_score: int | None = None,
) -> Column:
    """First band whose comparison ``c op bound`` holds; a ``None`` bound catches the rest."""
    x = col(c)
    out = F.when(x.isNull(), F.lit(null_score).cast("int"))
    compare = {
        "<": lambda b: x < b,
        "<=": lambda b: x <= b,
        ">": lambda b: x > b,
        ">=": lambda b: x >= b,
    }[op]
    for bound, score in bands:
        if bound is None:
            return out.otherwise(F.lit(score).cast("int"))
        out = out.when(compare(bound), F.lit(score).cast("int"))
    return out


def cases(*branches: tuple[Column, int | None], otherwise: int | None = 0) -> Column:
    """First true branch wins."""
    out = None
    for cond, score in branches:
        v = F.lit(score).cast("int")
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(F.lit(otherwise).cast("int"))


def total(*cols: Column | str) -> Column:
    return sum_all([F.coalesce(col(c), F.lit(0)) for c in cols])


def logistic(c: Column | str, a: float, b: float, log_term: float = 0.0) -> Column:
    x = col(c)
    z = F.lit(a) + F.lit(b) * x
    if log_term:
        z = z + F.lit(log_term) * F.ln(x + 1)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tier(score: Column | str, medium: Column | float, high: Column | float) -> Column:
    s = col(score)
    return F.when(s >= high, "high").when(s >= medium, "medium").when(s.isNotNull(), "low")


def tier_rank(t: Column | str) -> Column:
    x = col(t)
    return F.when(x == "high", 2).when(x == "medium", 1).when(x == "low", 0)


def component_scores(names: dict[str, str] | None = None) -> dict[str, Column]:
    """Score column per early-warning parameter; ``names`` maps parameter to input column."""
    names = names or {}
    out = {
        p: score_bands(names.get(p, p), bands) for p, bands in EARLY_WARNING_BANDS.items()
    }
    g = F.col(names.get("gcs_total", "gcs_total"))
    out["gcs_total"] = F.when(g >= GCS_ALERT, 0).when(g.isNotNull(), GCS_BELOW_ALERT_SCORE)
    return out


def early_warning(df, names: dict[str, str] | None = None, red: int = RED_SCORE):
    """Adds the total, number of components, highest component and the red parameter list."""
    parts = component_scores(names)
    some = lambda cs: F.greatest(*[F.coalesce(c, F.lit(0)) for c in cs])
    red_names = F.array_sort(
        F.filter(
            F.array(*[F.when(c >= red, F.lit(p)) for p, c in parts.items()]),
            lambda x: x.isNotNull(),
        )
    )
    return df.withColumns(
        {
            "score": total(*parts.values()).cast("int"),
            "components": sum_all([c.isNotNull().cast("int") for c in parts.values()]),
            "max_component": some(list(parts.values())),
            "max_component_nongcs": some([parts[p] for p in ESCALATION_PARAMS]),
            "red_params": F.array_join(red_names, ","),
        }
    )


def escalates(tier_col: Column | str, max_nongcs: Column | str, gcs_drop: Column | str) -> Column:
    """High tier, or one red parameter other than the coma score, or a coma-score drop."""
    return (
        F.coalesce(col(tier_col) == "high", F.lit(False))
        | (F.coalesce(col(max_nongcs), F.lit(0)) >= RED_SCORE)
        | F.coalesce(col(gcs_drop), F.lit(False))
    )


def escalation_reason(
    tier_col: Column | str, max_nongcs: Column | str, red: Column | str, gcs_drop: Column | str
) -> Column:
    """Text naming the limbs of the rule that fired."""
    t, m, d = col(tier_col), F.coalesce(col(max_nongcs), F.lit(0)), col(gcs_drop)
    others = F.array_join(
        F.filter(F.split(F.coalesce(col(red), F.lit("")), ","), lambda p: (p != "") & (p != "gcs_total")),
        ", ",
    )
    limbs = F.concat_ws(
        " AND ",
        F.when(t == "high", "tier is high"),
        F.when(m >= RED_SCORE, F.concat(F.lit("red parameter: "), others)),
        F.when(d, "coma score fell without sedation"),
    )
    return F.when(limbs == "", F.concat(F.lit("tier is "), t)).otherwise(limbs)


def meld(
    creatinine: Column, bilirubin: Column, inr: Column, sodium: Column, dialysis: Column
) -> tuple[Column, Column]:
    """Initial liver score and its sodium-adjusted form."""
    ln1 = lambda c: F.coalesce(F.when(c < 1, F.lit(0.0)).otherwise(F.ln(c)), F.lit(0.0))
    cr = F.when((dialysis == 1) | (creatinine > 4.0), F.ln(F.lit(4.0))).otherwise(ln1(creatinine))
    raw = 0.957 * cr + 0.378 * ln1(bilirubin) + (1.120 * ln1(inr) + 0.643)
    initial = F.when(raw > 4, F.lit(40.0)).otherwise((round_dec(raw, 1) * 10).cast("double"))
    na = (
        F.when(sodium.isNull() | (sodium > 137), F.lit(0.0))
        .when(sodium < 125, F.lit(12.0))
        .otherwise(F.lit(137.0) - sodium)
    )
    adjusted = F.when(initial > 11, initial + 1.32 * na - 0.033 * initial * na).otherwise(initial)
    return initial, adjusted


def gas_ratios(po2: Column, pco2: Column, fio2: Column) -> tuple[Column, Column]:
    """Alveolar-arterial gradient (4 decimals) and oxygen ratio for an inspired share in percent."""
    gradient = fio2 / 100 * (760 - 47) - pco2 / 0.8 - po2
    return round_dec(gradient, 4), F.try_divide(F.lit(100) * po2, fio2)


def mdrd_creatinine(age: Column, female: Column) -> Column:
    """Creatinine that the kidney-function formula gives at a rate of 75."""
    base = F.lit(75.0 / 186.0) / F.pow(age.cast("double"), F.lit(-0.203))
    base = F.when(female, base / F.lit(0.742)).otherwise(base)
    return F.pow(base, F.lit(-1 / 1.154))


# fixed values: quiet hours of the notification policy, [start, 24) and [0, end)
OVERNIGHT_START, OVERNIGHT_END = 22, 7


def overnight(ts: Column | str) -> Column:
    h = F.hour(col(ts))
    return (h >= OVERNIGHT_START) | (h < OVERNIGHT_END)


def route_channels(severity: Column | str, ts: Column | str) -> Column:
    """Channels of a notification: a push by day from medium up and always at night; the
    on-call contact only for high severity at night."""
    sev, night = col(severity), overnight(ts)
    picks = F.array(
        F.lit("dashboard"),
        F.when(sev.isin("medium", "high") | night, "push"),
        F.when((sev == "high") & night, "oncall_escalation"),
    )
    return F.filter(picks, lambda c: c.isNotNull())


# fixed values: half-open bands [lo, hi) of the subgroup audit
AGE_BANDS = [(0, 50, "<50"), (50, 65, "50-64"), (65, 80, "65-79"), (80, 200, "80+")]
TIME_BANDS = [(0, 6, "hour 0-5"), (6, 24, "hour 6-23"), (24, 1_000_000, "hour 24+")]


def band_label(c: Column | str, bands: Sequence[tuple[float, float, str]]) -> Column:
    x = col(c)
    out = F.when(F.lit(False), F.lit(""))
    for lo, hi, label in bands:
        out = out.when((x >= lo) & (x < hi), label)
    return out.otherwise("unknown")


def contributions(parts: dict[str, Column]) -> Column:
    """Array of (name, score) for the parameters that add to the total."""
    arr = F.array(
        *[F.struct(F.lit(p).alias("name"), c.cast("int").alias("score")) for p, c in parts.items()]
    )
    return F.filter(arr, lambda s: s["score"] > 0)


def rms_activity(x: str, y: str, z: str) -> Column:
    """Aggregate: root mean square deviation of a three-axis magnitude from 1."""
    mag = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
    return F.sqrt(F.avg(F.pow(mag - 1, 2)))
