"""Scalar functions, scores, predicates and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.functions import codes, compat, scoring
from wardspan.queries.analytics import r
from wardspan.queries.grid import TYPES, SCORE_SQL, filled_grid, points_sql
from wardspan.queries.registry import query

# how the driver tables stand in for the seven early-warning parameters
VITALS = {
    "rr": "l_quantity", "spo2": "70 + l_partkey % 31", "sbp": "60 + (l_extendedprice - floor(l_extendedprice / 200) * 200)",
    "hr": "30 + (l_partkey * 7 + l_suppkey) % 130", "temp_c": "33 + l_discount * 80", "gcs_total": "3 + l_linenumber * 2",
    "fio2": "case when l_tax > 0.03 then 21 + l_tax * 500 end",
}


def vital_rows(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(f"cast({e} as double)").alias(v) for v, e in VITALS.items()])


def _bands(c, cuts):
    return f"case when {c} is null then null " + " ".join(f"when {c} <= {b} then {s}" if b is not None else f"else {s}" for b, s in cuts) + " end"


_PARTS = {v: _bands(v, b) for v, b in scoring.EARLY_WARNING_BANDS.items()}
_PARTS["gcs_total"] = "case when gcs_total >= 15 then 0 when gcs_total is not null then 3 end"
VITAL_SQL = (
    "with v as (select l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"cast({e} as double) as {v}" for v, e in VITALS.items())
    + " from lineitem), s as (select *, "
    + ", ".join(f"{e} as s_{v}" for v, e in _PARTS.items())
    + " from v)"
)
_SUM = " + ".join(f"coalesce(s_{v}, 0)" for v in _PARTS)
_RED = "array_to_string(list_sort(list_filter([" + ", ".join(f"case when s_{v} >= 3 then '{v}' end" for v in _PARTS) + "], lambda x: x is not null)), ',')"


@query(
    "early_warning",
    VITAL_SQL + f""" select l_orderkey, l_linenumber, l_partkey, cast({_SUM} as integer) as score,
      {' + '.join(f'(s_{v} is not null)::int' for v in _PARTS)} as components,
      greatest({', '.join(f'coalesce(s_{v}, 0)' for v in _PARTS)}) as max_component,
      greatest({', '.join(f'coalesce(s_{v}, 0)' for v in scoring.ESCALATION_PARAMS)}) as max_component_nongcs,
      {_RED} as red_params from s""",
)
def _(t):
    return scoring.early_warning(vital_rows(t)).drop(*VITALS)


@query(
    "escalation_limbs",
    VITAL_SQL + f""", e as (select {_SUM} >= 10 as hi, greatest({', '.join(f'coalesce(s_{v}, 0)' for v in scoring.ESCALATION_PARAMS)}) >= 3 as red,
       l_partkey % 11 = 0 as dropped, greatest({', '.join(f'coalesce(s_{v}, 0)' for v in _PARTS)}) >= 3 as any_red from s)
    select count(*) as n_hours, cast(sum(hi::int) as bigint) as aggregate_limb, cast(sum(red::int) as bigint) as red_limb,
      cast(sum(dropped::int) as bigint) as drop_limb, cast(sum((hi or red or dropped)::int) as bigint) as escalating,
      cast(sum((any_red and not (hi or red or dropped))::int) as bigint) as red_level_only from e""",
)
def _(t):
    d = scoring.early_warning(vital_rows(t))
    d = d.withColumn("tier", scoring.tier("score", 7, 10)).withColumn("gcs_drop", F.col("l_partkey") % 11 == 0)
    esc = scoring.escalates("tier", "max_component_nongcs", "gcs_drop")
    n = lambda c: F.count(F.when(c, 1))
    return d.agg(
        F.count(F.lit(1)).alias("n_hours"), n(F.col("tier") == "high").alias("aggregate_limb"),
        n(F.col("max_component_nongcs") >= 3).alias("red_limb"), n(F.col("gcs_drop")).alias("drop_limb"),
        n(esc).alias("escalating"), n((F.col("max_component") >= 3) & ~esc).alias("red_level_only"),
    )


@query(
    "escalation_reason",
    VITAL_SQL + f""", e as (select {_SUM} as score, greatest({', '.join(f'coalesce(s_{v}, 0)' for v in scoring.ESCALATION_PARAMS)}) >= 3 as red,
        {_RED} as red_params, l_partkey % 11 = 0 as dropped from s),
    w as (select case when score >= 10 then 'high' when score >= 7 then 'medium' else 'low' end as tier, red, dropped,
        array_to_string(list_filter(string_split(red_params, ','), lambda p: p <> '' and p <> 'gcs_total'), ', ') as others from e)
    select coalesce(nullif(concat_ws(' AND ', case when tier = 'high' then 'tier is high' end, case when red then 'red parameter: ' || others end,
        case when dropped then 'coma score fell without sedation' end), ''), 'tier is ' || tier) as reason, count(*) as n from w group by 1""",
)
def _(t):
    d = scoring.early_warning(vital_rows(t)).withColumn("tier", scoring.tier("score", 7, 10))
    reason = scoring.escalation_reason("tier", "max_component_nongcs", "red_params", F.col("l_partkey") % 11 == 0)
    return d.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "score_contributions",
    VITAL_SQL + " select name, cast(score as integer) as score, count(*) as n from (select unnest(["
    + ", ".join(f"{{'name': '{v}', 'score': s_{v}}}" for v in _PARTS) + "], recursive := true) from s) where score > 0 group by 1, 2",
)
def _(t):
    parts = scoring.component_scores()
    d = vital_rows(t).select(F.explode(scoring.contributions(parts)).alias("c"))
    return d.groupBy("c.name", "c.score").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unit_normalise",
    """select l_orderkey, l_linenumber, l_partkey,
      round(case when l_tax > 0.02 and l_tax <= 0.05 then l_tax * 100 when l_tax > 0.05 then l_tax * 1000 end, 6) as fio2,
      round(case when l_quantity > 70 / 2.0 then (l_quantity * 2 - 32) / 1.8 else l_quantity end, 6) as temp_c,
      cast(round(cast(l_quantity * 2.54 as decimal(38, 9)), 2) as double) as height_cm,
      round(case when l_returnflag = 'R' then l_extendedprice * 1000.0 when l_returnflag = 'A' then l_extendedprice * 60.0 else l_extendedprice / l_quantity end, 7) as rate
    from lineitem""",
)
def _(t):
    tax, q, flag, price = F.col("l_tax"), F.col("l_quantity"), F.col("l_returnflag"), F.col("l_extendedprice")
    fio2 = F.when((tax > 0.02) & (tax <= 0.05), tax * 100).when(tax > 0.05, tax * 1000)
    rate = F.when(flag == "R", price * 1000.0).when(flag == "A", price * 60.0).otherwise(F.try_divide(price, q))
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(fio2, 6).alias("fio2"),
        F.round(F.when(q > 35.0, (q * 2 - 32) / 1.8).otherwise(q), 6).alias("temp_c"),
        compat.round_dec(q * 2.54, 2).cast("double").alias("height_cm"), F.round(rate, 7).alias("rate"),
    )


@query(
    "plausibility_filter",
    """select event_type, count(value) as n, count(case when value > 1 and value < 150 then 1 end) as n_kept,
      round(avg(case when value > 1 and value < 150 then value end), 6) as mean_kept
    from events where event_type in ('view', 'error', 'click') group by 1""",
)
def _(t):
    e = t("events").filter(F.col("event_type").isin("view", "error", "click"))
    kept = compat.between_open(F.col("value"), 1, 150)
    return e.groupBy("event_type").agg(
        F.count("value").alias("n"), F.count(kept).alias("n_kept"), F.round(F.avg(kept), 6).alias("mean_kept")
    )


@query(
    "score_bands_total",
    """with s as (select p_partkey, case when p_size < 10 then 4 when p_size < 20 then 3 when p_size < 30 then 1 else 0 end as a,
        case when p_retailprice >= 1800 then 4 when p_retailprice >= 1200 then 2 when p_retailprice >= 1000 then 1 else 0 end as b,
        case when p_partkey % 7 <> 0 then case when p_partkey % 100 <= 20 then 5 when p_partkey % 100 <= 60 then 2 else 0 end end as c from part)
    select p_partkey, a, b, c, a + b + coalesce(c, 0) as total from s""",
)
def _(t):
    c = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 100)
    d = t("part").select(
        "p_partkey",
        scoring.score_bands("p_size", [(10, 4), (20, 3), (30, 1), (None, 0)], "<").alias("a"),
        scoring.score_bands("p_retailprice", [(1800, 4), (1200, 2), (1000, 1), (None, 0)], ">=").alias("b"),
        scoring.score_bands(c, [(20, 5), (60, 2), (None, 0)]).alias("c"),
    )
    return d.withColumn("total", scoring.total("a", "b", "c"))


@query(
    "logistic_link",
    """select p_partkey, round(1 / (1 + exp(-(-4.436 + 0.04726 * p_size))), 9) as p1,
       round(1 / (1 + exp(-(-7.7631 + 0.0737 * p_size + 0.9971 * ln(p_size + 1)))), 9) as p2 from part""",
)
def _(t):
    return t("part").select(
        "p_partkey", F.round(scoring.logistic("p_size", -4.436, 0.04726), 9).alias("p1"),
        F.round(scoring.logistic("p_size", -7.7631, 0.0737, 0.9971), 9).alias("p2"),
    )


@query(
    "strict_greatest",
    """select l_orderkey, l_linenumber, l_partkey,
      case when a is null or b is null or c is null then null else greatest(a, b, c) end as strict_max,
      case when a is null or b is null then null else least(a, b) end as strict_min, greatest(a, b, c) as loose_max
    from (select l_orderkey, l_linenumber, l_partkey, l_quantity as a, case when l_tax > 0.01 then l_discount * 500 end as b,
          case when l_returnflag <> 'A' then l_tax * 500 end as c from lineitem)""",
)
def _(t):
    a, b = F.col("l_quantity"), F.when(F.col("l_tax") > 0.01, F.col("l_discount") * 500)
    c = F.when(F.col("l_returnflag") != "A", F.col("l_tax") * 500)
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", compat.greatest_strict(a, b, c).alias("strict_max"),
        compat.least_strict(a, b).alias("strict_min"), F.greatest(a, b, c).alias("loose_max"),
    )


@query(
    "boundary_diff",
    "with e as (select event_id, ts, ts + to_microseconds(cast(round(value * 700000) as bigint) * 1000) as te from events) select event_id, "
    + ", ".join(f"date_diff('{u}', ts, te) as {u}s" for u in ("year", "month", "day", "hour", "minute", "second"))
    + " from e",
)
def _(t):
    us = F.round(F.col("value") * 700000).cast("long") * 1000
    e = t("events").withColumn("te", compat.from_epoch_us(compat.epoch_us("ts") + us))
    units = ("year", "month", "day", "hour", "minute", "second")
    return e.select("event_id", *[compat.date_diff_boundaries(u, "ts", "te").alias(f"{u}s") for u in units])


@query(
    "age_at_event",
    "select o_orderkey, 30 + o_custkey % 50 + date_diff('year', make_timestamp(1990 + o_custkey % 8, 1, 1, 0, 0, 0), o_orderdate) as age from orders",
)
def _(t):
    anchor = F.make_timestamp_ntz((1990 + F.col("o_custkey") % 8).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    age = 30 + F.col("o_custkey") % 50 + compat.date_diff_boundaries("year", anchor, "o_orderdate")
    return t("orders").select("o_orderkey", age.alias("age"))


MELD_SQL = """with x as (select l_orderkey, l_linenumber, l_partkey, l_quantity / 8 as cr, l_discount * 60 as bi, 0.5 + l_tax * 40 as inr,
      case when l_partkey % 9 <> 0 then 110 + l_partkey % 40 end as na, (l_partkey % 13 = 0)::int as rrt from lineitem),
    s as (select *, case when na is null or na > 137 then 0.0 when na < 125 then 12.0 else 137.0 - na end as nas,
       0.957 * case when rrt = 1 or cr > 4 then ln(4) when cr < 1 then 0 else ln(cr) end
       + 0.378 * case when bi < 1 then 0 else ln(bi) end + 1.12 * case when inr < 1 then 0 else ln(inr) end + 0.643 as raw from x),
    m as (select *, case when raw > 4 then 40.0 else cast(round(cast(raw as decimal(38, 9)), 1) * 10 as double) end as m0 from s)
    select l_orderkey, l_linenumber, l_partkey, round(m0, 4) as meld_initial,
      round(case when m0 > 11 then m0 + 1.32 * nas - 0.033 * m0 * nas else m0 end, 4) as meld from m"""


@query("meld_like", MELD_SQL)
def _(t):
    na = F.when(F.col("l_partkey") % 9 != 0, (110 + F.col("l_partkey") % 40).cast("double"))
    m0, m1 = scoring.meld(
        F.col("l_quantity") / 8, F.col("l_discount") * 60, 0.5 + F.col("l_tax") * 40, na, (F.col("l_partkey") % 13 == 0).cast("int")
    )
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(m0, 4).alias("meld_initial"), F.round(m1, 4).alias("meld"))


@query(
    "mdrd_baseline",
    """with x as (select c_custkey, 18 + c_custkey % 70 as age, c_nationkey % 2 = 0 as f, c_acctbal / 3989.0 as scr from customer),
    y as (select *, power(75.0 / 186.0 / power(age, -0.203) / case when f then 0.742 else 1 end, -1 / 1.154) as est from x)
    select c_custkey, round(est, 6) as mdrd, round(case when scr <= 1.1 or c_custkey % 11 = 0 then scr else est end, 6) as baseline from y""",
)
def _(t):
    est = scoring.mdrd_creatinine(18 + F.col("c_custkey") % 70, F.col("c_nationkey") % 2 == 0)
    scr = F.col("c_acctbal") / 3989.0
    base = F.when((scr <= 1.1) | (F.col("c_custkey") % 11 == 0), scr).otherwise(est)
    return t("customer").select("c_custkey", F.round(est, 6).alias("mdrd"), F.round(base, 6).alias("baseline"))


@query(
    "gas_ratios",
    """with x as (select l_orderkey, l_linenumber, l_partkey, 40 + l_quantity as po2, 20 + l_discount * 400 as pco2,
        case when l_tax > 0.02 then 21 + l_tax * 700 end as fio2, case when l_partkey % 3 > 0 then 30.0 + l_partkey % 60 end as fio2c from lineitem)
    select l_orderkey, l_linenumber, l_partkey,
      cast(round(cast(coalesce(fio2, fio2c) / 100 * 713 - pco2 / 0.8 - po2 as decimal(38, 9)), 4) as double) as aado2,
      round(100 * po2 / coalesce(fio2, fio2c), 6) as pf from x""",
)
def _(t):
    x = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (40 + F.col("l_quantity")).alias("po2"), (20 + F.col("l_discount") * 400).alias("pco2"),
        F.when(F.col("l_tax") > 0.02, 21 + F.col("l_tax") * 700).alias("fio2"),
        F.when(F.col("l_partkey") % 3 > 0, (30.0 + F.col("l_partkey") % 60).cast("double")).alias("fio2c"),
    )
    aado2, pf = scoring.gas_ratios(F.col("po2"), F.col("pco2"), F.coalesce("fio2", "fio2c"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", aado2.cast("double").alias("aado2"), F.round(pf, 6).alias("pf"))


# diagnosis-like codes made from the part table
CODE9 = "lpad(cast(p_partkey * 37 % 1000 as varchar), 3, '0') || cast(p_size % 10 as varchar)"
CODE10 = "chr(65 + cast(p_partkey % 26 as integer)) || lpad(cast(p_size as varchar), 2, '0') || cast(p_partkey % 10 as varchar)"
CODE_SQL = f"""codes as (select p_partkey, case when p_partkey % 5 = 4 then null else 9 + p_partkey % 2 end as version,
   case when p_partkey % 2 = 1 then {CODE10} when p_partkey % 17 = 0 then 'V' || p_size when p_partkey % 19 = 0 then 'E' || p_size
        when p_partkey % 23 = 0 then 'x?' else {CODE9} end as code from part)"""


def code_rows(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    c9 = F.concat(F.lpad((k * 37 % 1000).cast("string"), 3, "0"), (s % 10).cast("string"))
    c10 = F.concat(F.chr(65 + k % 26), F.lpad(s.cast("string"), 2, "0"), (k % 10).cast("string"))
    code = (
        F.when(k % 2 == 1, c10).when(k % 17 == 0, F.concat(F.lit("V"), s.cast("string")))
        .when(k % 19 == 0, F.concat(F.lit("E"), s.cast("string"))).when(k % 23 == 0, "x?").otherwise(c9)
    )
    return t("part").select("p_partkey", F.when(k % 5 != 4, 9 + k % 2).alias("version"), code.alias("code"))


def _c10_sql():
    return " ".join(f"when substr(u, 1, 1) in ({', '.join(repr(x) for x in ls)}) then '{n}'" for n, ls in codes.CHAPTERS_10.items())


def _c9_sql():
    return " ".join(f"when try_cast(substr(u, 1, 3) as integer) between 1 and {last} then '{n}'" for last, n in codes.CHAPTERS_9)


@query(
    "chapter_map",
    f"""with {CODE_SQL} select p_partkey, coalesce(case when version = 10 then case {_c10_sql()} end
      when version = 9 then case when u like 'V%' then 'Factors/Encounter' when u like 'E%' then 'External causes' {_c9_sql()} end end, 'Unknown') as chapter
    from (select *, upper(trim(code)) as u from codes)""",
)
def _(t):
    return code_rows(t).select("p_partkey", codes.chapter(F.col("code"), F.col("version")).alias("chapter"))


@query(
    "prefix_flags",
    f"""with {CODE_SQL} select p_partkey,
      (coalesce(version = 9 and (substr(code, 1, 3) between '430' and '438' or substr(code, 1, 4) in ('0930', '4371')), false)
       or coalesce(version = 10 and (substr(code, 1, 3) between 'I60' and 'K05' or substr(code, 1, 3) in ('G45', 'B20')), false))::int as vascular,
      coalesce(version = 9 and substr(code, 1, 3) in ('042', '043', '044'), false)::int as aids from codes""",
)
def _(t):
    d, c, v = code_rows(t), F.col("code"), F.col("version")
    return d.select(
        "p_partkey", codes.prefix_flag(c, v, "430-438 0930 4371", "I60-K05 G45 B20").alias("vascular"),
        codes.prefix_flag(c, v, "042 043 044", "").alias("aids"),
    )


@query(
    "like_classify",
    """select l_orderkey, l_linenumber, l_partkey, p_name from lineitem join part on l_partkey = p_partkey
    where lower(p_name) like '%gear%' or lower(p_name) like '%bolt%' or lower(p_name) like '%red%'""",
)
def _(t):
    # classify each distinct name once, then attach it to the rows
    names = t("part").select("p_name").distinct().filter(codes.contains_any(F.col("p_name"), ["gear", "bolt", "red"]))
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name").join(names, "p_name", "left_semi")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "p_name"
    )


@query(
    "harmonise_labels",
    """select p_partkey, case when p_type in ('SMALL', 'MEDIUM') then 'Modest' when p_type = 'ECONOMY' then 'Eco' else p_type end as type_label,
       coalesce(case when p_brand like 'Brand#1%' then 'First' end, p_brand) as brand_label from part""",
)
def _(t):
    mapping = {"SMALL": "Modest", "MEDIUM": "Modest", "ECONOMY": "Eco"}
    d = t("part").withColumn("label", codes.mapped(F.col("p_type"), mapping))
    brand = F.when(F.col("p_brand").like("Brand#1%"), "First").otherwise(F.col("p_brand"))
    return d.select("p_partkey", F.col("label").alias("type_label"), brand.alias("brand_label"))


@query(
    "regex_match",
    "select p_partkey, regexp_matches(lower(p_name), '(red|blue) (ring|gear)') as hit, p_type like '%A%' as has_a from part",
)
def _(t):
    return t("part").select(
        "p_partkey", F.lower("p_name").rlike("(red|blue) (ring|gear)").alias("hit"), F.col("p_type").like("%A%").alias("has_a")
    )


@query(
    "tristate_flags",
    """select o_orderkey, case when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 0 end as active,
      (o_orderpriority in ('1-URGENT', '2-HIGH'))::int as urgent from orders""",
)
def _(t):
    return t("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("active"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("urgent"),
    )


@query(
    "prefer_coalesce",
    """with d as (select user_id, date_trunc('day', ts) as day, """
    + ", ".join(f"avg(value) filter (event_type = '{c}') as {c}" for c in TYPES)
    + """ from events group by 1, 2)
    select user_id, day, round(coalesce(view, click), 6) as preferred,
      round(case when view is not null and click is not null and error is not null then view + click + error end, 6) as all_parts from d""",
)
def _(t):
    from wardspan.queries.analytics import daily

    d = daily(t)
    return d.select(
        "user_id", "day", F.round(F.coalesce("view", "click"), 6).alias("preferred"),
        F.round(F.col("view") + F.col("click") + F.col("error"), 6).alias("all_parts"),
    )


@query(
    "band_labels",
    """select event_id, case when hour(ts) >= 22 or hour(ts) < 7 then true else false end as overnight,
      case when user_id < 50 then '<50' when user_id < 65 then '50-64' when user_id < 80 then '65-79' when user_id < 200 then '80+' else 'unknown' end as age_band,
      list_filter(['dashboard', case when sev in ('medium', 'high') or hour(ts) >= 22 or hour(ts) < 7 then 'push' end,
         case when sev = 'high' and (hour(ts) >= 22 or hour(ts) < 7) then 'oncall_escalation' end], lambda x: x is not null) as channels
    from (select *, case when value > 100 then 'high' when value > 40 then 'medium' else 'low' end as sev from events)""",
)
def _(t):
    sev = F.when(F.col("value") > 100, "high").when(F.col("value") > 40, "medium").otherwise("low")
    return t("events").select(
        "event_id", scoring.overnight("ts").alias("overnight"),
        scoring.band_label("user_id", scoring.AGE_BANDS).alias("age_band"),
        scoring.route_channels(sev, F.col("ts")).alias("channels"),
    )


@query(
    "activity_index",
    """select user_id, date_trunc('day', ts) as day, round(sqrt(avg(power(sqrt(x * x + y * y + z * z) - 1, 2))), 6) as activity, round(avg(value), 6) as mean_hr
    from (select *, value / 100 as x, (event_id % 7) / 7.0::double as y, (event_id % 5) / 5.0::double as z from events) group by 1, 2""",
)
def _(t):
    e = t("events").withColumns(
        {"x": F.col("value") / 100, "y": (F.col("event_id") % 7) / F.lit(7.0), "z": (F.col("event_id") % 5) / F.lit(5.0)}
    )
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return e.groupBy("user_id", day).agg(
        F.round(scoring.rms_activity("x", "y", "z"), 6).alias("activity"), F.round(F.avg("value"), 6).alias("mean_hr")
    )
