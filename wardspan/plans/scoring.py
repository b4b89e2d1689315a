"""Hourly grid, early-warning scores with percentile cut-points, disease context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions.codes import UNKNOWN, chapter
from wardspan.functions.compat import epoch_us
from wardspan.functions.scoring import GCS_DROP_LOOKBACK, GCS_DROP_POINTS, WARD_HIGH, WARD_MEDIUM, early_warning, escalates, tier
from wardspan.operators.joins import overlap_flag, with_fallback
from wardspan.operators.pivot import hourly_grid, unify_vitals
from wardspan.operators.sampling import drawn_weights
from wardspan.operators.scan import exact_percentiles
from wardspan.operators.windows import ffill_flagged, trailing_drop
from wardspan.plans.concepts import Catalog
from wardspan.plans.features import CORE
from wardspan.session import stored

# Charted items of the grid, sedating drugs, guard and percentiles of the cut-points
GRID_ITEMS = {
    220045: "hr", 220210: "rr", 220277: "spo2", 220179: "sbp_ni", 220181: "map_ni", 220050: "sbp_art", 220052: "map_art", 223761: "temp_f",
    223762: "temp_c", 220739: "gcs_eye", 223900: "gcs_verbal", 223901: "gcs_motor", 223835: "fio2", 225664: "glucose",
}
SEDATION_ITEMS = (222168, 227210, 226224, 221668, 229420, 225150, 221744, 225942, 225972)
POOLED, MIN_STAYS, P_MEDIUM, P_HIGH, N_BOOT = "__pooled__", 20, 0.75, 0.90, 500


def raw_grid(c: Catalog) -> DataFrame:
    ev = c("chartevents").withColumn("valuenum", F.col("valuenum").cast("double"))
    g = hourly_grid(ev, c("icustays"), "stay_id", "charttime", "intime", "itemid", "valuenum", GRID_ITEMS)
    return unify_vitals(g)


def filled_grid(c: Catalog) -> DataFrame:
    return ffill_flagged(raw_grid(c), ["stay_id"], "hour", CORE)


def disease_context(c: Catalog) -> DataFrame:
    """Primary diagnosis chapter and comorbidity index per stay; unknown history stays NULL."""
    d = c("diagnoses_icd").filter(F.col("seq_num") == 1)
    d = d.select("hadm_id", F.col("icd_code").alias("dx_icd_code"), chapter(F.col("icd_code"), F.col("icd_version")).alias("dx_chapter"))
    first = F.min(F.struct("dx_icd_code", "dx_chapter")).alias("__dx")
    d = d.groupBy("hadm_id").agg(first).select("hadm_id", "__dx.dx_icd_code", "__dx.dx_chapter")
    stays = c("icustays").select("subject_id", "hadm_id", "stay_id")
    out = stays.join(d, "hadm_id", "left").join(c("charlson").drop("subject_id", "age_score"), "hadm_id", "left")
    return out.withColumns({"dx_chapter": F.coalesce("dx_chapter", F.lit(UNKNOWN)), "dx_icd_code": F.coalesce("dx_icd_code", F.lit(""))})


def chapter_counts(disease: DataFrame) -> DataFrame:
    return disease.groupBy("dx_chapter").agg(
        F.countDistinct("stay_id").alias("stays"), F.countDistinct("subject_id").alias("subjects"), F.countDistinct("dx_icd_code").alias("distinct_codes")
    )


def cut_points(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Truncated percentiles, the upper at least one above the lower."""
    p = exact_percentiles(df, by, score, {"__m": P_MEDIUM, "__h": P_HIGH})
    m = F.floor("__m").cast("int")
    return p.select(*by, m.alias("icu_medium"), F.greatest(F.floor("__h").cast("int"), m + 1).alias("icu_high"))


def group_cut_points(
    df: DataFrame, unit: str, group: str, score: str = "score", min_units: int = MIN_STAYS, n_boot: int = N_BOOT, seed: int = 0
) -> DataFrame:
    """Cut-points per group with a bootstrap over whole units, and whether the group may use them."""
    base = cut_points(df, [group], score)
    n = df.groupBy(group).agg(F.countDistinct(unit).alias("stays"), F.count(F.lit(1)).alias("patient_hours"))
    per = stored(drawn_weights(df.where(F.col(score).isNotNull()), [group], unit, score, n_boot, seed), "drawn-scores")
    p = exact_percentiles(per, [group, "replicate"], score, {"__m": P_MEDIUM, "__h": P_HIGH}, F.col("weight"))
    high = F.greatest(F.floor("__h"), F.floor("__m") + 1).cast("double")
    ci = exact_percentiles(p.withColumn("__x", high), [group], "__x", {"high_ci_lo": 0.025, "high_ci_hi": 0.975})
    out = base.join(n, group).join(ci, group, "left")
    return out.withColumn("own_threshold", F.col("stays") >= min_units)


def news2(c: Catalog, grid: DataFrame, disease: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored grid and threshold table."""
    # sedation and drop need few columns; the grid has one row per stay and hour, and its other columns meet them once
    g = grid.select("stay_id", "hour", "gcs_total").join(c("icustays").select("stay_id", "intime"), "stay_id")
    start = F.col("intime") + F.expr("make_dt_interval(0, hour)")
    g = g.withColumns({"__s": start, "__e": start + F.expr("interval 1 hour")})
    sed = c("inputevents").filter(F.col("itemid").isin(*SEDATION_ITEMS)).select("stay_id", "starttime", "endtime")
    g = overlap_flag(g, sed.filter(F.col("starttime") <= F.col("endtime")), ["stay_id"], ("__s", "__e"), ("starttime", "endtime"), "sedated")
    g = g.select("stay_id", "hour", "gcs_total", "sedated")
    g = trailing_drop(g, ["stay_id"], "hour", "gcs_total", GCS_DROP_LOOKBACK, GCS_DROP_POINTS, F.col("sedated"), "gcs_drop").drop("gcs_total")
    g = g.join(disease.select("stay_id", F.col("dx_chapter").alias("dx_group")), "stay_id", "left")
    flags = g.select(F.col("stay_id").alias("__id"), F.col("hour").alias("__hour"), "sedated", "gcs_drop", "dx_group")
    g = early_warning(grid).join(flags, (F.col("stay_id") == F.col("__id")) & F.col("hour").eqNullSafe(F.col("__hour"))).drop("__id", "__hour")
    # the cut-points read the scored hours several times, and the tiers once more
    g = stored(g, "scored-hours")
    pooled = cut_points(g.withColumn("dx_group", F.lit(POOLED)), ["dx_group"])
    own = cut_points(g, ["dx_group"]).join(
        g.groupBy("dx_group").agg(F.countDistinct("stay_id").alias("__n")).filter(F.col("__n") >= MIN_STAYS).drop("__n"), "dx_group"
    )
    thresholds = own.unionByName(pooled).withColumns({"ward_medium": F.lit(WARD_MEDIUM), "ward_high": F.lit(WARD_HIGH)})
    thresholds = stored(thresholds, "thresholds")
    g = with_fallback(g, thresholds, "dx_group", POOLED, ["icu_medium", "icu_high"])
    g = g.withColumns(
        {"tier_ward": tier("score", WARD_MEDIUM, WARD_HIGH), "tier_icu": tier("score", F.col("icu_medium"), F.col("icu_high"))}
    )
    g = g.withColumn("escalates", escalates("tier_icu", "max_component_nongcs", "gcs_drop")).withColumnRenamed("score", "news2")
    return g, thresholds


def row_start(g: DataFrame) -> DataFrame:
    return g.withColumn("row_start_us", epoch_us("icu_intime") + F.col("hour") * F.lit(3_600_000_000))
