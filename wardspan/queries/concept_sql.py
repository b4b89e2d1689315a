"""DuckDB counterparts of the derived clinical tables, over the same ICU-shaped tables.

Each body reads raw or other derived tables by name; ``oracle`` puts the needed ones in front.
"""

from __future__ import annotations

import re

from wardspan.plans.concepts import base as B
from wardspan.plans.concepts import care as C
from wardspan.plans.concepts import severity as S
from wardspan.queries.icu import duck_raw

SQL: dict[str, str] = {}


def _in(xs) -> str:
    return "(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in xs) + ")"


def _pick(codes, col="valuenum", extra="") -> str:
    codes = codes if isinstance(codes, (list, tuple)) else [codes]
    return f"max({col}) filter (itemid in {_in(codes)}{extra})"


def _specimen(cols: dict[str, str], where: str) -> str:
    body = ", ".join(f"{v} as {k}" for k, v in cols.items())
    return f"select max(subject_id) as subject_id, max(hadm_id) as hadm_id, max(charttime) as charttime, specimen_id, {body} from labevents where {where} group by specimen_id"


for _n, (_codes, _pos) in B.LAB_PIVOTS.items():
    _w = f"itemid in {_in(_codes.values())} and valuenum is not null" + (" and valuenum > 0" if _pos else "")
    SQL[_n] = _specimen({k: _pick(i) for k, i in _codes.items()}, _w)

SQL["chemistry"] = _specimen(
    {k: _pick(i, extra=f" and valuenum <= {cap}") for k, (i, cap) in B.CHEMISTRY.items()},
    f"itemid in {_in([i for i, _ in B.CHEMISTRY.values()])} and valuenum is not null and (valuenum > 0 or itemid = 50868)",
)

_dabs = {n: f"max(case when itemid in {_in(w)} then valuenum" + (f" when itemid in {_in(m)} then valuenum / 1000.0" if m else "") + " end)" for n, (w, m) in B.DIFF_ABSOLUTE.items()}
_pct = [i for p in B.DIFF_PERCENT.values() for i in p]
_all_diff = [*B.WBC_CODES, B.GRANULOCYTES, *B.DIFF_OTHER.values(), *_pct, *[i for w, m in B.DIFF_ABSOLUTE.values() for i in (*w, *m)]]
SQL["blood_differential"] = f"""with d as ({_specimen({'wbc': _pick(B.WBC_CODES)} | {f'{n}_a': e for n, e in _dabs.items()} | {n: _pick(p) for n, p in B.DIFF_PERCENT.items()} | {n: _pick(i) for n, i in B.DIFF_OTHER.items()} | {'pct': f'sum(valuenum) filter (itemid in {_in(_pct)})'}, f'itemid in {_in(_all_diff)} and valuenum >= 0')})
 select subject_id, hadm_id, charttime, specimen_id, wbc, {', '.join(f"round(cast(case when {n}_a is null and wbc > 0 and pct > 0 then {n} * wbc / 100 else {n}_a end as decimal(38, 9)), 4)::double as {n}_abs" for n in B.DIFF_ABSOLUTE)},
 {', '.join([*B.DIFF_PERCENT, *B.DIFF_OTHER])} from d"""

SQL["icustay_times"] = """select s.subject_id, s.hadm_id, s.stay_id, min(e.charttime) as intime_hr, max(e.charttime) as outtime_hr
 from icustays s left join chartevents e on e.stay_id = s.stay_id and e.itemid = 220045 group by 1, 2, 3"""
SQL["icustay_hourly"] = """with h as (select stay_id, date_trunc('hour', intime_hr) + case when date_trunc('hour', intime_hr) = intime_hr then interval 0 hour else interval 1 hour end as base,
   unnest(generate_series(-24, date_diff('hour', intime_hr, outtime_hr))) as hr from icustay_times where intime_hr is not null)
 select stay_id, hr, base + to_hours(hr) as endtime from h"""
SQL["age"] = """select a.subject_id, a.hadm_id, a.admittime, p.anchor_age, p.anchor_year, (p.anchor_age + year(a.admittime) - p.anchor_year)::bigint as age
 from admissions a join patients p using (subject_id)"""
SQL["icustay_detail"] = """with a as (select *, dense_rank() over (partition by subject_id order by admittime) as hospstay_seq from admissions where hadm_id in (select hadm_id from icustays))
 select i.subject_id, i.hadm_id, i.stay_id, gender, dod, admittime, dischtime, date_diff('day', admittime, dischtime) as los_hospital,
  (anchor_age + year(admittime) - anchor_year)::bigint as admission_age, race, hospital_expire_flag, hospstay_seq, hospstay_seq = 1 as first_hosp_stay, intime as icu_intime, outtime as icu_outtime,
  round(cast(date_diff('hour', intime, outtime) / 24.0 as decimal(38, 9)), 2)::double as los_icu, dense_rank() over (partition by i.hadm_id order by intime) as icustay_seq,
  dense_rank() over (partition by i.hadm_id order by intime) = 1 as first_icu_stay from icustays i join a using (hadm_id) join patients p on p.subject_id = i.subject_id"""
SQL["weight_durations"] = """with w0 as (select stay_id, charttime, case itemid when 226512 then 'admit' else 'daily' end as weight_type, round(cast(valuenum as decimal(38, 9)), 3)::double as weight
   from chartevents where itemid in (226512, 224639) and valuenum > 0 and valuenum < 1500),
 w1 as (select *, row_number() over (partition by stay_id, weight_type order by charttime, weight) as rn from w0),
 w2 as (select w1.stay_id, intime, outtime, case when weight_type = 'admit' and rn = 1 then intime - interval 2 hour else charttime end as starttime, weight, weight_type from w1 join icustays using (stay_id)),
 w3 as (select *, coalesce(lead(starttime) over o, outtime + interval 2 hour) as endtime, row_number() over o as k from w2 window o as (partition by stay_id order by starttime, weight_type, weight))
 select stay_id, starttime, endtime, weight, weight_type from w3 union all
 select stay_id, intime - interval 2 hour, starttime, weight, weight_type from w3 where k = 1 and intime < starttime"""
SQL["bg"] = f"""with g as (select max(subject_id) as subject_id, max(hadm_id) as hadm_id, max(charttime) as charttime, specimen_id, {_pick(52033, 'value')} as specimen,
   {', '.join(f'{_pick(i)} as {n}' for n, i in B.GAS_PLAIN.items())}, {', '.join(f'{_pick(i, extra=f" and valuenum <= {cap}")} as {n}' for n, (i, cap) in B.GAS_CAPPED.items())},
   max(case when itemid = 50816 then case when valuenum > 20 and valuenum <= 100 then valuenum when valuenum > 0.2 and valuenum <= 1.0 then valuenum * 100.0 end end) as fio2
   from labevents where itemid between 50801 and 50825 or itemid = 52033 group by specimen_id),
 f as (select subject_id, charttime as ft, max(case when valuenum > 0.2 and valuenum <= 1 then valuenum * 100 when valuenum >= 20 then valuenum end) as fc
   from chartevents where itemid = 223835 and valuenum > 0 and valuenum <= 100 group by 1, 2 having fc > 0),
 m as (select g.*, f.ft, f.fc from g asof left join f on g.subject_id = f.subject_id and g.charttime >= f.ft where po2 is not null),
 k as (select *, case when ft >= charttime - interval 4 hour then fc end as fio2_chartevents from m)
 select subject_id, hadm_id, charttime, specimen, so2, po2, pco2, fio2_chartevents, fio2, aado2,
  round(cast(coalesce(fio2, fio2_chartevents) / 100 * 713 - pco2 / 0.8 - po2 as decimal(38, 9)), 4)::double as aado2_calc, 100 * po2 / coalesce(fio2, fio2_chartevents) as pao2fio2ratio,
  ph, baseexcess, bicarbonate, totalco2, hematocrit, hemoglobin, carboxyhemoglobin, methemoglobin, chloride, calcium, temperature, potassium, sodium, lactate, glucose from k"""
SQL["creatinine_baseline"] = """with p as (select a.hadm_id, gender, age, power(75.0 / 186.0 / power(age::double, -0.203) / case when gender = 'F' then 0.742 else 1 end, -1 / 1.154) as est from age a left join patients using (subject_id) where age >= 18),
 l as (select hadm_id, min(creatinine) as scr_min from chemistry group by 1),
 k as (select distinct hadm_id, 1 as ckd from diagnoses_icd where (icd_version = 9 and icd_code like '585%') or (icd_version = 10 and icd_code like 'N18%'))
 select p.hadm_id, gender, age, scr_min, coalesce(ckd, 0) as ckd, round(est, 6) as mdrd_est, round(case when scr_min <= 1.1 or ckd = 1 then scr_min else est end, 6) as scr_baseline
 from p left join l using (hadm_id) left join k using (hadm_id)"""


def _avg(codes, lo, hi, closed=False):
    top = "" if hi is None else f" and valuenum {'<=' if closed else '<'} {hi}"
    return f"avg(valuenum) filter (itemid in {_in(codes)} and valuenum > {lo}{top})"


SQL["vitalsign"] = f"""select subject_id, stay_id, charttime, {_avg([220045], 0, 300)} as heart_rate, {_avg([220179, 220050, 225309], 0, 400)} as sbp, {_avg([220180, 220051, 225310], 0, 300)} as dbp,
 {_avg([220052, 220181, 225312], 0, 300)} as mbp, {_avg([220179], 0, 400)} as sbp_ni, {_avg([220180], 0, 300)} as dbp_ni, {_avg([220181], 0, 300)} as mbp_ni, {_avg([220210, 224690], 0, 70)} as resp_rate,
 round(cast(avg(case when itemid = 223761 and valuenum > 70 and valuenum < 120 then (valuenum - 32) / 1.8::double when itemid = 223762 and valuenum > 10 and valuenum < 50 then valuenum end) as decimal(38, 9)), 2)::double as temperature,
 max(value) filter (itemid = 224642) as temperature_site, {_avg([220277], 0, 100, True)} as spo2, {_avg([225664, 220621, 226537], 0, None)} as glucose from chartevents
 where itemid in (220045, 225309, 225310, 225312, 220050, 220051, 220052, 220179, 220180, 220181, 220210, 224690, 220277, 225664, 220621, 226537, 223762, 223761, 224642) group by 1, 2, 3"""
SQL["gcs"] = """with b as (select subject_id, stay_id, charttime, max(valuenum) filter (itemid = 223901) as m, max(case when value = 'No Response-ETT' then 0 else valuenum end) filter (itemid = 223900) as v,
   max(valuenum) filter (itemid = 220739) as e, max(coalesce(itemid = 223900 and value = 'No Response-ETT', false)::int) as u from chartevents where itemid in (223900, 223901, 220739) group by 1, 2, 3),
 p as (select *, lag(charttime) over w > charttime - interval 6 hour as near, lag(m) over w as m0, lag(v) over w as v0, lag(e) over w as e0 from b window w as (partition by stay_id order by charttime)),
 q as (select *, case when near then m0 end as pm, case when near then v0 end as pv, case when near then e0 end as pe from p)
 select subject_id, stay_id, charttime, case when v = 0 or (v is null and pv = 0) then 15.0 when pv = 0 then coalesce(m, 6) + coalesce(v, 5) + coalesce(e, 4) else coalesce(m, pm, 6) + coalesce(v, pv, 5) + coalesce(e, pe, 4) end::double as gcs,
  coalesce(m, pm) as gcs_motor, coalesce(v, pv)::double as gcs_verbal, coalesce(e, pe) as gcs_eyes, u as gcs_unable from q"""
SQL["height"] = """with c as (select subject_id, stay_id, charttime, itemid, round(cast(valuenum * case itemid when 226707 then 2.54::double else 1 end as decimal(38, 9)), 2)::double as h from chartevents where itemid in (226707, 226730) and valuenum is not null),
 a as (select * from c where itemid = 226730), b as (select * from c where itemid = 226707)
 select coalesce(a.subject_id, b.subject_id) as subject_id, coalesce(a.stay_id, b.stay_id) as stay_id, coalesce(a.charttime, b.charttime) as charttime, coalesce(a.h, b.h) as height
 from a full join b on a.subject_id = b.subject_id and a.charttime = b.charttime where coalesce(a.h, b.h) > 120 and coalesce(a.h, b.h) < 230"""
SQL["icp"] = "select subject_id, stay_id, charttime, max(valuenum) filter (valuenum > 0 and valuenum < 100) as icp from chartevents where itemid in (220765, 227989) group by 1, 2, 3"
SQL["oxygen_delivery"] = """with f as (select subject_id, stay_id, charttime, case when itemid = 227582 then 223834 else itemid end as item, valuenum from chartevents where itemid in (223834, 227582, 227287) and value is not null
   qualify row_number() over (partition by subject_id, charttime, item order by storetime desc, valuenum desc) = 1),
 g as (select subject_id, charttime, max(stay_id) as stay_id, max(valuenum) filter (item = 223834) as o2_flow, max(valuenum) filter (item = 227287) as o2_flow_additional from f group by 1, 2),
 d as (select subject_id, charttime, value, row_number() over (partition by subject_id, charttime order by storetime desc, value desc) as rn from chartevents where itemid = 226732),
 e as (select subject_id, charttime, """ + ", ".join(f"max(value) filter (rn = {i}) as o2_delivery_device_{i}" for i in range(1, 5)) + """ from d group by 1, 2)
 select * from g left join e using (subject_id, charttime)"""
SQL["rhythm"] = """select subject_id, charttime, string_agg(distinct value, '; ' order by value) filter (itemid = 220048) as heart_rhythm, max(value) filter (itemid = 224650) as ectopy_type, max(value) filter (itemid = 224651) as ectopy_frequency,
  max(value) filter (itemid = 226479) as ectopy_type_secondary, max(value) filter (itemid = 226480) as ectopy_frequency_secondary from chartevents where itemid in (220048, 224650, 224651, 226479, 226480) group by 1, 2"""
SQL["urine_output"] = f"select stay_id, charttime, sum(case when itemid = 227488 and value > 0 then -value else value end) as urineoutput from outputevents where itemid in {_in(B.URINE_ITEMS)} group by 1, 2"
_win = lambda c, s: f"sum({c}) over (partition by stay_id order by sec range between {s} preceding and current row)"
SQL["kdigo_uo"] = f"""with u as (select u.*, epoch(charttime)::bigint as sec, coalesce(date_diff('second', lag(charttime) over (partition by stay_id order by charttime), charttime) / 3600.0::double, 1.0::double) as h from urine_output u join icustays using (stay_id)),
 r as (select stay_id, charttime, {', '.join(f"{_win('urineoutput', h * 3600)} as urineoutput_{h}hr, round(cast({_win('h', h * 3600)} as decimal(38, 9)), 6)::double as uo_tm_{h}hr" for h in (6, 12, 24))} from u),
 j as (select r.*, weight from r left join weight_durations w on r.stay_id = w.stay_id and charttime >= starttime and charttime < endtime)
 select *, case when uo_tm_6hr >= 6 and uo_tm_6hr < 12 then round(cast(urineoutput_6hr / weight / uo_tm_6hr as decimal(38, 9)), 4)::double end as uo_rt_6hr,
  {', '.join(f"case when uo_tm_{h}hr >= {h} then round(cast(urineoutput_{h}hr / weight / uo_tm_{h}hr as decimal(38, 9)), 4)::double end as uo_rt_{h}hr" for h in (12, 24))} from j"""
SQL["urine_output_rate"] = f"""with t as (select e.stay_id, min(e.charttime) as hr0 from chartevents e join icustays i on e.stay_id = i.stay_id where itemid = 220045 and e.charttime > intime - interval 1 month and e.charttime < outtime + interval 1 month group by 1),
 u as (select u.stay_id, charttime, urineoutput, date_diff('minute', coalesce(lag(charttime) over (partition by u.stay_id order by charttime), hr0), charttime) as m from urine_output u join t on u.stay_id = t.stay_id),
 s as (select a.stay_id, a.charttime, any_value(a.urineoutput) as uo, {', '.join(f"sum(b.urineoutput) filter (date_diff('hour', b.charttime, a.charttime) <= {n}) as urineoutput_{h}hr, round(cast(sum(b.m) filter (date_diff('hour', b.charttime, a.charttime) <= {n}) / 60.0::double as decimal(38, 9)), 6)::double as h{h}" for h, n in ((6, 5), (12, 11), (24, 99)))}
   from u a join u b on a.stay_id = b.stay_id and a.charttime >= b.charttime and a.charttime <= b.charttime + interval 23 hour group by 1, 2)
 select s.stay_id, s.charttime, weight, uo, urineoutput_6hr, urineoutput_12hr, urineoutput_24hr,
  {', '.join(f"case when h{h} >= {h} then round(cast(urineoutput_{h}hr / weight / h{h} as decimal(38, 9)), 4)::double end as uo_mlkghr_{h}hr, round(h{h}::decimal(38, 9), 2)::double as uo_tm_{h}hr" for h in (6, 12, 24))}
 from s left join weight_durations w on s.stay_id = w.stay_id and s.charttime > w.starttime and s.charttime <= w.endtime and weight > 0"""
_vent_items = [i for v in B.VENT_NUMBERS.values() for i in v] + list(B.VENT_TEXTS.values()) + [220339, 224700, 223835]
SQL["ventilator_setting"] = f"""select subject_id, max(stay_id) as stay_id, charttime, {', '.join(f'{_pick(i)} as {n}' for n, i in B.VENT_NUMBERS.items())}, max(valuenum) filter (itemid in (220339, 224700) and valuenum between 0 and 100) as peep,
 round(max(case when itemid = 223835 then case when valuenum >= 0.2 and valuenum <= 1 then valuenum * 100 when valuenum >= 20 and valuenum <= 100 then valuenum end end), 6) as fio2,
 {', '.join(f"max(value) filter (itemid = {i}) as {n}" for n, i in B.VENT_TEXTS.items())} from chartevents where value is not null and itemid in {_in(_vent_items)} group by subject_id, charttime"""

_RATE = """case when itemid = 221906 and rateuom = 'mg/kg/min' and patientweight <> 1 then rate * 1000.0::double when itemid = 221749 and rateuom = 'mcg/min' then rate / patientweight when itemid = 222315 and rateuom = 'units/min' then rate * 60.0::double else rate end"""
for _n, _i in B.AGENT_CODES.items():
    SQL[_n] = f"select stay_id, linkorderid, {_RATE} as vaso_rate, amount as vaso_amount, starttime, endtime from inputevents where itemid = {_i}"
SQL["neuroblock"] = "select stay_id, orderid, rate as drug_rate, amount as drug_amount, starttime, endtime from inputevents where itemid in (222062, 221555) and rate is not null"


def _like(words, col="drug"):
    return "(" + " or ".join(f"lower({col}) like '%{w}%'" for w in words) + ")"


for _n, _w in (("acei", B.ACEI), ("arb", B.ARB), ("nsaid", B.NSAID)):
    SQL[_n] = f"select subject_id, hadm_id, drug as {_n}, starttime, stoptime from prescriptions where {_like(_w)}"
SQL["antibiotic"] = f"""with k as (select distinct drug, route from prescriptions where drug_type <> 'BASE' and route not in {_in(B.LOCAL_ROUTES)} and not {_like(['ear', 'eye'], 'route')} and not {_like(B.NOT_SYSTEMIC)} and {_like(B.ANTIBIOTIC)})
 select p.subject_id, p.hadm_id, stay_id, drug as antibiotic, route, starttime, stoptime from prescriptions p join k using (drug, route) left join icustays i on i.hadm_id = p.hadm_id and starttime >= intime and starttime < outtime"""
SQL["vasoactive_agent"] = f"""with r as (select stay_id, itemid, starttime as s, endtime as e, {_RATE} as rate from inputevents where itemid in {_in(B.AGENT_CODES.values())}),
 c as (select stay_id, s as mark from r union select stay_id, e from r), t as (select stay_id, mark as starttime, lead(mark) over (partition by stay_id order by mark) as endtime from c)
 select t.stay_id, t.starttime, t.endtime, {', '.join(f'r{i}.rate as {n}' for n, i in B.AGENT_CODES.items())} from t {' '.join(f'left join r r{i} on r{i}.itemid = {i} and t.stay_id = r{i}.stay_id and t.starttime >= r{i}.s and t.endtime <= r{i}.e' for i in B.AGENT_CODES.values())}
 where t.endtime is not null"""
SQL["norepinephrine_equivalent_dose"] = """select stay_id, starttime, endtime, round(cast(coalesce(norepinephrine, 0) + coalesce(epinephrine, 0) + coalesce(phenylephrine / 10, 0) + coalesce(dopamine / 100, 0) + coalesce(vasopressin * 2.5::double / 60, 0) as decimal(38, 9)), 4)::double as norepinephrine_equivalent_dose
 from vasoactive_agent where coalesce(norepinephrine, epinephrine, phenylephrine, dopamine, vasopressin) is not null"""

# --- treatment -----------------------------------------------------------------------------
_flags = lambda spec, col: ", ".join(f"coalesce({col} in {_in(v)}, false)::int as {k}" if v else f"0 as {k}" for k, v in spec.items())
SQL["code_status"] = f"""select subject_id, hadm_id, stay_id, charttime, {_flags(C.CHARTED_STATUS, 'value')} from chartevents where itemid = 223758
 union all select p.subject_id, p.hadm_id, i.stay_id, p.ordertime, {_flags(C.ORDERED_STATUS, 'field_value')} from poe p join poe_detail using (poe_id) left join icustays i on i.hadm_id = p.hadm_id and p.ordertime between i.intime and i.outtime
 where order_type = 'General Care' and order_subtype = 'Code status'"""
_st = lambda v: f"itemid = 224146 and value in {_in(v)}"
SQL["crrt"] = f"""select stay_id, charttime, {', '.join(f'{_pick(i)} as {n}' for n, i in C.CRRT_NUMBERS.items())}, {', '.join(f"max(value) filter (itemid = {i}) as {n}" for n, i in C.CRRT_TEXTS.items())},
 max(case when {_st(['Active', 'Initiated', 'Reinitiated', 'New Filter'])} then 1 when {_st(['Recirculating', 'Discontinued'])} then 0 end) as system_active, max(case when {_st(['Clots Present'])} then 1 when {_st(['No Clot Present'])} then 0 end) as clots,
 max(case when {_st(['Clots Increasing', 'Clot Increasing'])} then 1 end) as clots_increasing, max(case when {_st(['Clotted'])} then 1 end) as clotted
 from chartevents where value is not null and itemid in {_in([*C.CRRT_NUMBERS.values(), *C.CRRT_TEXTS.values(), 224146])} group by 1, 2"""


def _names(col, groups):
    return f"case {' '.join(f'when {col} in {_in(v)} then {k!r}' for k, v in groups.items())} else {col} end"


SQL["invasive_line"] = f"select stay_id, {_names('label', C.LINE_TYPES)} as line_type, {_names('location', C.LINE_SITES)} as line_site, starttime, endtime from procedureevents join d_items using (itemid) where itemid in {_in(C.LINE_ITEMS)}"
SQL["rrt"] = f"""with m as (select distinct stay_id, starttime, endtime, 1 as p, 1 as a, 'CRRT' as k from inputevents where itemid in {_in(C.CITRATE_INPUTS)} and amount > 0
   union select stay_id, starttime, endtime, 1, (itemid not in {_in(C.RRT_CATHETERS)})::int, case itemid {' '.join(f'when {i} then {n!r}' for i, n in C.RRT_PROCEDURES.items() if n)} end from procedureevents where itemid in {_in(C.RRT_PROCEDURES)} and value is not null),
 t as (select stay_id, charttime, 1 as p, coalesce((itemid = 225965 and value = 'In use') or itemid in {_in(C.RRT_ACTIVE)}, false)::int as a, case when itemid = 227290 then value when itemid in {_in(C.PERITONEAL)} then 'Peritoneal' when itemid = 226499 then 'IHD' end as k
   from chartevents where itemid in {_in(C.RRT_PRESENT)} and value is not null union select stay_id, starttime, p, a, k from m)
 select t.stay_id, charttime, coalesce(m.p, t.p) as dialysis_present, coalesce(m.a, t.a) as dialysis_active, coalesce(m.k, t.k) as dialysis_type from t left join m on t.stay_id = m.stay_id and charttime between m.starttime and m.endtime"""
_dev = [f"o2_delivery_device_{i}" for i in range(1, 5)]
SQL["ventilation"] = f"""with b as (select coalesce(v.stay_id, o.stay_id) as stay_id, coalesce(v.charttime, o.charttime) as charttime, ventilator_mode as vm, ventilator_mode_hamilton as hm, {', '.join(_dev)}
   from ventilator_setting v full join oxygen_delivery o on v.stay_id = o.stay_id and v.charttime = o.charttime),
 s as (select stay_id, charttime as ts, case when {_dev[0]} in ('Tracheostomy tube', 'Trach mask ') then 'Tracheostomy' when {_dev[0]} = 'Endotracheal tube' or vm in {_in(C.INVASIVE_MODES)} or hm in {_in(C.INVASIVE_HAMILTON)} then 'InvasiveVent'
   when {' or '.join(f'{d} in {_in(C.MASKS)}' for d in _dev)} or hm in {_in(C.NONINVASIVE_HAMILTON)} then 'NonInvasiveVent' when {_dev[0]} = 'High flow nasal cannula' then 'HFNC' when {_dev[0]} in {_in(C.SUPPLEMENTAL)} then 'SupplementalOxygen'
   when {_dev[0]} = 'None' then 'None' end as st from b),
 w as (select *, lag(st) over o as ps, lead(ts) over o as nt, lag(ts) over (partition by stay_id, st order by ts) as pt from s where st is not null window o as (partition by stay_id order by ts)),
 q as (select *, sum((ps is null or ps <> st or date_diff('hour', pt, ts) >= 14)::int) over (partition by stay_id order by ts) as seq from w)
 select stay_id, min(ts) as starttime, max(case when nt is null or date_diff('hour', ts, nt) >= 14 then ts else nt end) as endtime, max(st) as ventilation_status from q group by stay_id, seq having min(ts) <> max(ts)"""


def _rule(rule: str) -> str:
    tests = []
    for part in rule.split():
        if "-" in part:
            lo, hi = part.split("-")
            tests.append(f"substr(icd_code, 1, {len(lo)}) between '{lo}' and '{hi}'")
        else:
            tests.append(f"icd_code like '{part}%'")
    return "(" + " or ".join(tests) + ")"


def _icd(nine: str, ten: str) -> str:
    return f"max(coalesce((icd_version = 9 and {_rule(nine)}) or (icd_version = 10 and {_rule(ten)}), false)::int)"


_eight = " + ".join(list(C.CHARLSON)[:8])
SQL["charlson"] = f"""with d as (select hadm_id, {', '.join(f'{_icd(n, t)} as {k}' for k, (n, t) in C.CHARLSON.items())} from diagnoses_icd group by 1),
 f as (select a.subject_id, a.hadm_id, case when age < 50 then 0 when age < 60 then 1 when age < 70 then 2 when age < 80 then 3 else 4 end as age_score, {', '.join(f'coalesce({k}, 0) as {k}' for k in C.CHARLSON)} from admissions a left join d using (hadm_id) left join age g on g.hadm_id = a.hadm_id)
 select *, age_score + {_eight} + greatest(mild_liver_disease, 3 * severe_liver_disease) + greatest(2 * diabetes_with_cc, diabetes_without_cc) + greatest(2 * malignant_cancer, 6 * metastatic_solid_tumor) + 2 * paraplegia + 2 * renal_disease + 6 * aids as charlson_comorbidity_index from f"""

# --- first day ------------------------------------------------------------------------------


def _day(table, on, aggs, lead="6 hour", where=""):
    return f"""select i.subject_id, i.stay_id, {aggs} from icustays i left join {table} e on e.{on} = i.{on} and e.charttime >= i.intime - interval {lead} and e.charttime <= i.intime + interval 1 day{where} group by 1, 2"""


def _mm(cols):
    return ", ".join(f"min({s}) as {n}_min, max({s}) as {n}_max" for n, s in cols.items())


_bgf = {f: f"e.{f}" for f in C.BG_FIELDS}
SQL["first_day_bg"] = _day("bg", "subject_id", _mm(_bgf))
SQL["first_day_bg_art"] = _day("bg", "subject_id", _mm(_bgf), where=" and e.specimen = 'ART.'")
SQL["first_day_gcs"] = "with w as (select i.stay_id, g.* exclude (subject_id, stay_id) from icustays i join gcs g on g.stay_id = i.stay_id and charttime >= intime - interval 6 hour and charttime <= intime + interval 1 day qualify row_number() over (partition by i.stay_id order by gcs, charttime desc) = 1) select i.subject_id, i.stay_id, gcs as gcs_min, gcs_motor, gcs_verbal, gcs_eyes, gcs_unable from icustays i left join w using (stay_id)"
SQL["first_day_height"] = _day("height", "stay_id", "round(cast(avg(height) as decimal(38, 9)), 2)::double as height")
_groups = [
    ("complete_blood_count", {"hematocrit": "hematocrit", "hemoglobin": "hemoglobin", "platelets": "platelet", "wbc": "wbc"}), ("chemistry", {n: n for n in B.CHEMISTRY}),
    ("blood_differential", {f"abs_{n}": f"{n}_abs" for n in B.DIFF_ABSOLUTE} | {"atyps": "atypical_lymphocytes", "bands": "bands", "imm_granulocytes": "immature_granulocytes", "metas": "metamyelocytes", "nrbc": "nrbc"}),
    ("coagulation", {n: n for n in B.COAGULATION}), ("enzyme", {n: n for n in B.ENZYME}),
]
SQL["first_day_lab"] = "select * exclude (" + ", ".join(f"s{i}" for i in range(1, 5)) + ") from " + " join ".join(
    (f"({_day(t, 'subject_id', _mm({n: f'e.{s}' for n, s in cols.items()}))}) g{i}" if i == 0 else
     f"(select * exclude (subject_id, stay_id), stay_id as s{i} from ({_day(t, 'subject_id', _mm({n: f'e.{s}' for n, s in cols.items()}))})) g{i} on s{i} = stay_id")
    for i, (t, cols) in enumerate(_groups)
)
SQL["first_day_rrt"] = _day("rrt", "stay_id", "max(dialysis_present) as dialysis_present, max(dialysis_active) as dialysis_active, string_agg(distinct dialysis_type, ', ' order by dialysis_type) as dialysis_type")
SQL["first_day_urine_output"] = _day("urine_output", "stay_id", "sum(urineoutput) as urineoutput", "0 hour")
_vs = ["heart_rate", "sbp", "dbp", "mbp", "resp_rate", "temperature", "spo2", "glucose"]
SQL["first_day_vitalsign"] = _day("vitalsign", "stay_id", _mm({v: v for v in _vs}) + ", " + ", ".join(f"round(avg({v}), 6) as {v}_mean" for v in _vs))
SQL["first_day_weight"] = """select i.subject_id, i.stay_id, round(avg(weight) filter (weight_type = 'admit'), 6) as weight_admit, round(avg(weight), 6) as weight, min(weight) as weight_min, max(weight) as weight_max
 from icustays i left join weight_durations w on w.stay_id = i.stay_id and w.starttime <= i.intime + interval 1 day group by 1, 2"""

# --- organ failure and scores ------------------------------------------------------------------
SQL["kdigo_creatinine"] = """with c as (select i.hadm_id, i.stay_id, l.charttime, avg(valuenum) as creat from icustays i left join labevents l on l.subject_id = i.subject_id and itemid = 50912 and valuenum <= 150 and l.charttime between i.intime - interval 7 day and i.outtime group by 1, 2, 3)
 select *, min(creat) over (partition by stay_id order by charttime range between interval 48 hour preceding and interval 1 microsecond preceding) as creat_low_past_48hr,
  min(creat) over (partition by stay_id order by charttime range between interval 7 day preceding and interval 1 microsecond preceding) as creat_low_past_7day from c"""
SQL["kdigo_stages"] = """with cs as (select stay_id, charttime, creat_low_past_7day, creat_low_past_48hr, creat, case when creat >= creat_low_past_7day * 3.0::double then 3 when creat >= 4 and (creat >= creat_low_past_48hr + 0.3::double or creat >= 1.5::double * creat_low_past_7day) then 3
   when creat >= creat_low_past_7day * 2.0::double then 2 when creat >= creat_low_past_48hr + 0.3::double then 1 when creat >= creat_low_past_7day * 1.5::double then 1 else 0 end as aki_stage_creat from kdigo_creatinine),
 us as (select u.stay_id, charttime, uo_rt_6hr, uo_rt_12hr, uo_rt_24hr, case when uo_rt_6hr is null then null when charttime <= intime + interval 6 hour then 0 when uo_tm_24hr >= 24 and uo_rt_24hr < 0.3 then 3 when uo_tm_12hr >= 12 and uo_rt_12hr = 0 then 3
   when uo_tm_12hr >= 12 and uo_rt_12hr < 0.5 then 2 when uo_tm_6hr >= 6 and uo_rt_6hr < 0.5 then 1 else 0 end as aki_stage_uo from kdigo_uo u join icustays using (stay_id)),
 rs as (select stay_id, charttime, 3 as aki_stage_crrt from crrt where crrt_mode is not null), tm as (select stay_id, charttime from cs union select stay_id, charttime from us union select stay_id, charttime from rs),
 j as (select i.subject_id, i.hadm_id, i.stay_id, i.intime, tm.charttime, creat_low_past_7day, creat_low_past_48hr, creat, aki_stage_creat, uo_rt_6hr, uo_rt_12hr, uo_rt_24hr, aki_stage_uo, aki_stage_crrt,
   greatest(coalesce(aki_stage_creat, 0), coalesce(aki_stage_uo, 0), coalesce(aki_stage_crrt, 0)) as aki_stage from icustays i left join tm using (stay_id) left join cs on cs.stay_id = i.stay_id and cs.charttime = tm.charttime
   left join us on us.stay_id = i.stay_id and us.charttime = tm.charttime left join rs on rs.stay_id = i.stay_id and rs.charttime = tm.charttime)
 select * exclude (intime), max(aki_stage) over (partition by subject_id order by date_diff('second', intime, charttime) range between 21600 preceding and current row) as aki_stage_smoothed from j"""
SQL["meld"] = """with x as (select i.subject_id, i.hadm_id, i.stay_id, creatinine_max, bilirubin_total_max, inr_max, sodium_min, dialysis_present as rrt, case when sodium_min is null or sodium_min > 137 then 0.0 when sodium_min < 125 then 12.0 else 137.0 - sodium_min end::double as na,
   0.957::double * case when rrt = 1 or creatinine_max > 4 then ln(4) when creatinine_max < 1 then 0 else coalesce(ln(creatinine_max), 0) end + 0.378::double * case when bilirubin_total_max < 1 then 0 else coalesce(ln(bilirubin_total_max), 0) end
   + (1.120::double * case when inr_max < 1 then 0 else coalesce(ln(inr_max), 0) end + 0.643::double) as raw from icustays i left join first_day_lab l on l.stay_id = i.stay_id left join first_day_rrt r on r.stay_id = i.stay_id),
 m as (select *, case when raw > 4 then 40.0 else round(cast(raw as decimal(38, 9)), 1) * 10 end::double as meld_initial from x)
 select subject_id, hadm_id, stay_id, meld_initial, round(case when meld_initial > 11 then meld_initial + 1.32::double * na - 0.033::double * meld_initial * na else meld_initial end, 6) as meld, rrt, creatinine_max, bilirubin_total_max, inr_max, sodium_min from m"""
SQL["sirs"] = """with s as (select i.subject_id, i.hadm_id, i.stay_id, case when temperature_min < 36 or temperature_max > 38 then 1 when temperature_min is not null then 0 end as temp_score, case when heart_rate_max > 90 then 1 when heart_rate_max is not null then 0 end as heart_rate_score,
   case when resp_rate_max > 20 or pco2_min < 32 then 1 when coalesce(resp_rate_max, pco2_min) is not null then 0 end as resp_score, case when wbc_min < 4 or wbc_max > 12 or bands_max > 10 then 1 when coalesce(wbc_min, bands_max) is not null then 0 end as wbc_score
   from icustays i left join (select stay_id, pco2_min from first_day_bg_art) b on b.stay_id = i.stay_id left join first_day_vitalsign v on v.stay_id = i.stay_id left join first_day_lab l on l.stay_id = i.stay_id)
 select *, coalesce(temp_score, 0) + coalesce(heart_rate_score, 0) + coalesce(resp_score, 0) + coalesce(wbc_score, 0) as sirs from s"""


def _organs(vent, none, plt, bili, mbp, gcs, cr, uo, hourly):
    extra2, extra1 = (f" when {vent} < 300 then 2", f" when {vent} < 400 then 1") if hourly else ("", "")
    e, n, p, d = "rate_epinephrine", "rate_norepinephrine", "rate_dopamine", "rate_dobutamine"
    return f"""case when {vent} < 100 then 4 when {vent} < 200 then 3 when {none} < 300 then 2{extra2} when {none} < 400 then 1{extra1} when coalesce({vent}, {none}) is not null then 0 end as respiration,
  case when {plt} < 20 then 4 when {plt} < 50 then 3 when {plt} < 100 then 2 when {plt} < 150 then 1 when {plt} is not null then 0 end as coagulation,
  case when {bili} >= 12 then 4 when {bili} >= 6 then 3 when {bili} >= 2 then 2 when {bili} >= 1.2::double then 1 when {bili} is not null then 0 end as liver,
  case when {p} > 15 or {e} > 0.1::double or {n} > 0.1::double then 4 when {p} > 5 or {e} <= 0.1::double or {n} <= 0.1::double then 3 when {p} > 0 or {d} > 0 then 2 when {mbp} < 70 then 1 when coalesce({mbp}, {p}, {d}, {e}, {n}) is not null then 0 end as cardiovascular,
  case when {gcs} < 6 then 4 when {gcs} between 6 and 9 then 3 when {gcs} between 10 and 12 then 2 when {gcs} between 13 and 14 then 1 when {gcs} is not null then 0 end as cns,
  case when {cr} >= 5 or {uo} < 200 then 4 when {cr} >= 3.5::double or {uo} < 500 then 3 when {cr} >= 2 then 2 when {cr} >= 1.2::double then 1 when coalesce({uo}, {cr}) is not null then 0 end as renal"""


_inv = "(select stay_id, starttime as vs, endtime as ve from ventilation where ventilation_status = 'InvasiveVent')"
_osum = " + ".join(f"coalesce({o}, 0)" for o in S.ORGANS)
_press = ", ".join(f"(select max(rate) from r where r.stay_id = i.stay_id and itemid = {i} and s >= intime - interval 6 hour and s <= intime + interval 1 day) as rate_{n}" for n, i in S.PRESSORS.items())
SQL["first_day_sofa"] = f"""with r as (select stay_id, itemid, starttime as s, {_RATE} as rate from inputevents),
 p as (select i.stay_id, b.pao2fio2ratio as pf, exists (select 1 from {_inv} v where v.stay_id = i.stay_id and b.charttime between vs and ve) as vent from icustays i join bg b on b.subject_id = i.subject_id and specimen = 'ART.' and b.charttime >= i.intime - interval 6 hour and b.charttime <= i.intime + interval 1 day),
 q as (select stay_id, min(pf) filter (not vent) as pn, min(pf) filter (vent) as pv from p group by 1),
 x as (select i.subject_id, i.hadm_id, i.stay_id, {_press}, pn, pv, mbp_min, creatinine_max, bilirubin_total_max, platelets_min, urineoutput, gcs_min from icustays i left join q using (stay_id) left join first_day_vitalsign v on v.stay_id = i.stay_id
   left join first_day_lab l on l.stay_id = i.stay_id left join first_day_urine_output u on u.stay_id = i.stay_id left join first_day_gcs g on g.stay_id = i.stay_id),
 o as (select subject_id, hadm_id, stay_id, {_organs('pv', 'pn', 'platelets_min', 'bilirubin_total_max', 'mbp_min', 'gcs_min', 'creatinine_max', 'urineoutput', False)} from x) select *, {_osum} as sofa from o"""


def _slot(table, on, value, f, name, where=""):
    return f"(select h.stay_id, h.hr, {f}({value}) as {name} from co h join {table} t on t.{on} = h.{on} and t.charttime > h.endtime - interval 1 hour and t.charttime <= h.endtime{where} group by 1, 2)"


_hr = ["b_mbp", "b_gcs", "b_bili", "b_cr", "b_plt", "b_pn", "b_pv", "b_uo"]
SQL["sofa"] = f"""with co as (select h.*, i.hadm_id, i.subject_id from icustay_hourly h join icustays i using (stay_id)),
 r as (select stay_id, itemid, starttime as s, endtime as e, {_RATE} as rate from inputevents where itemid in {_in(S.PRESSORS.values())}),
 art as (select i.stay_id, b.charttime, b.pao2fio2ratio as pf, exists (select 1 from {_inv} v where v.stay_id = i.stay_id and b.charttime between vs and ve) as vent from icustays i join bg b on b.subject_id = i.subject_id and specimen = 'ART.'),
 u24 as (select stay_id, charttime, urineoutput_24hr / uo_tm_24hr * 24 as v from urine_output_rate where uo_tm_24hr between 22 and 30),
 va as (select h.stay_id, h.hr, {', '.join(f'max(rate) filter (itemid = {i}) as rate_{n}' for n, i in S.PRESSORS.items())} from co h join r on r.stay_id = h.stay_id and h.endtime > r.s and h.endtime <= r.e group by 1, 2),
 x as (select co.stay_id, co.hr, co.endtime - interval 1 hour as starttime, co.endtime, pn as pao2fio2ratio_novent, pv as pao2fio2ratio_vent, rate_epinephrine, rate_norepinephrine, rate_dopamine, rate_dobutamine, meanbp_min, gcs_min, uo_24hr, bilirubin_max, creatinine_max, platelet_min
   from co left join {_slot('vitalsign', 'stay_id', 'mbp', 'min', 'meanbp_min')} a using (stay_id, hr) left join {_slot('gcs', 'stay_id', 'gcs', 'min', 'gcs_min')} b using (stay_id, hr)
   left join {_slot('enzyme', 'hadm_id', 'bilirubin_total', 'max', 'bilirubin_max')} c using (stay_id, hr) left join {_slot('chemistry', 'hadm_id', 'creatinine', 'max', 'creatinine_max')} d using (stay_id, hr)
   left join {_slot('complete_blood_count', 'hadm_id', 'platelet', 'min', 'platelet_min')} e using (stay_id, hr) left join {_slot('art', 'stay_id', 'pf', 'min', 'pn', ' and not vent')} f using (stay_id, hr)
   left join {_slot('art', 'stay_id', 'pf', 'min', 'pv', ' and vent')} g using (stay_id, hr) left join {_slot('u24', 'stay_id', 'v', 'max', 'uo_24hr')} k using (stay_id, hr) left join va using (stay_id, hr)),
 o as (select *, {_organs('pao2fio2ratio_vent', 'pao2fio2ratio_novent', 'platelet_min', 'bilirubin_max', 'meanbp_min', 'gcs_min', 'creatinine_max', 'uo_24hr', True)} from x),
 w as (select *, {', '.join(f'coalesce(max({o}) over win, 0) as {o}_24hours' for o in S.ORGANS)} from o window win as (partition by stay_id order by hr rows between 23 preceding and current row))
 select *, {' + '.join(f'{o}_24hours' for o in S.ORGANS)} as sofa_24hours from w where hr >= 0"""
SQL["suspicion_of_infection"] = """with ab as (select subject_id, hadm_id, stay_id, antibiotic, route, starttime as t, row_number() over (partition by subject_id order by starttime, stoptime, antibiotic, hadm_id nulls first, stay_id nulls first, route) as ab_id from antibiotic),
 me as (select micro_specimen_id as id, max(subject_id) as subject_id, date_trunc('day', max(chartdate)) as d, max(charttime) as m, max(spec_type_desc) as spec, max(coalesce(org_name is not null and org_itemid not in (90856, 90760) and org_name <> '' and org_name <> 'CANCELLED', false)::int) as pos from microbiologyevents group by 1),
 b as (select ab.subject_id, ab_id, arg_min({'m': m, 'd': d, 's': spec, 'p': pos}, (d, coalesce(m, timestamp '9999-01-01'), -pos, id)) as x from ab join me using (subject_id)
   where (m is not null and t > m and t <= m + interval 72 hour) or (m is null and date_trunc('day', t) >= d and date_trunc('day', t) <= d + interval 3 day) group by 1, 2),
 a as (select ab.subject_id, ab_id, arg_min({'m': m, 'd': d, 's': spec, 'p': pos}, (d, coalesce(m, timestamp '9999-01-01'), -pos, id)) as y from ab join me using (subject_id)
   where (m is not null and t >= m - interval 24 hour and t < m) or (m is null and date_trunc('day', t) >= d - interval 1 day and date_trunc('day', t) <= d) group by 1, 2)
 select ab.subject_id, ab.stay_id, ab.hadm_id, ab.ab_id, antibiotic, t as antibiotic_time, (x.s is not null or y.s is not null)::int as suspected_infection,
  case when x.s is not null or y.s is not null then coalesce(x.m, x.d, t) end as suspected_infection_time, coalesce(x.m, x.d, y.m, y.d) as culture_time, coalesce(x.s, y.s) as specimen, coalesce(x.p, y.p) as positive_culture
 from ab left join b using (subject_id, ab_id) left join a using (subject_id, ab_id)"""
SQL["sepsis3"] = f"""with j as (select q.subject_id, q.stay_id, antibiotic_time, culture_time, suspected_infection_time, s.endtime as sofa_time, sofa_24hours as sofa_score, {', '.join(f'{o}_24hours as {o}' for o in S.ORGANS).replace(chr(10), '')}, suspected_infection = 1 as sepsis3
   from suspicion_of_infection q join (select stay_id, endtime, sofa_24hours, {', '.join(f'{o}_24hours' for o in S.ORGANS)} from sofa where sofa_24hours >= 2) s on s.stay_id = q.stay_id and s.endtime between suspected_infection_time - interval 48 hour and suspected_infection_time + interval 24 hour)
 select * from j qualify row_number() over (partition by stay_id order by suspected_infection_time, antibiotic_time, culture_time, sofa_time) = 1"""


# --- severity scores: bands as text, in the order they are tested ---------------------------------


def _band(col: str, bands, op: str = "<") -> str:
    steps = " ".join(f"when {col} {op} {b} then {v}" if b is not None else f"else {v}" for b, v in bands)
    return f"case when {col} is null then null {steps} end"


def _first(*rows, other="0") -> str:
    return f"case {' '.join(f'when {c} then {v}' for c, v in rows)} else {other} end"


_gas = "select i.stay_id, b.* exclude (subject_id), exists (select 1 from {inv} v where v.stay_id = i.stay_id and b.charttime between vs and ve) as vent from bg b join icustays i on i.hadm_id = b.hadm_id and b.charttime >= i.intime and b.charttime < i.outtime".format(inv=_inv)
_vent1 = f"(select i.stay_id, max((v.vs is not null)::int) as vent from icustays i left join {_inv} v on v.stay_id = i.stay_id and vs <= intime + interval 1 day and ve >= intime group by 1)"
_parts = lambda cols: " + ".join(f"coalesce({c}, 0)" for c in cols)

_lods = {
    "neurologic": _first(("gcs_min is null or gcs_min < 3", "null"), ("gcs_min <= 5", 5), ("gcs_min <= 8", 3), ("gcs_min <= 13", 1)),
    "cardiovascular": _first(("heart_rate_max is null and sbp_min is null", "null"), ("heart_rate_min < 30 or sbp_min < 40", 5), ("sbp_min < 70 or sbp_max >= 270", 3), ("heart_rate_max >= 140 or sbp_max >= 240 or sbp_min < 90", 1)),
    "renal": _first(("bun_max is null or urineoutput is null or creatinine_max is null", "null"), ("urineoutput < 500 or bun_max >= 56", 5), ("creatinine_max >= 1.6::double or urineoutput < 750 or bun_max >= 28 or urineoutput >= 10000", 3), ("creatinine_max >= 1.2::double or bun_max >= 7.5::double", 1)),
    "pulmonary": _first(("pf is null", 0), ("pf >= 150", 1), other="3"),
    "hematologic": _first(("wbc_max is null and platelets_min is null", "null"), ("wbc_min < 1", 3), ("wbc_min < 2.5::double or platelets_min < 50 or wbc_max >= 50", 1)),
    "hepatic": _first(("pt_max is null and bilirubin_total_max is null", "null"), ("bilirubin_total_max >= 2 or pt_max > 15 or pt_min < 3", 1)),
}
_day1 = "left join first_day_gcs g on g.stay_id = i.stay_id left join first_day_vitalsign v on v.stay_id = i.stay_id left join first_day_urine_output u on u.stay_id = i.stay_id"
SQL["lods"] = f"""with c as (select i.stay_id, min(charttime) - interval 1 hour as cs, max(charttime) + interval 4 hour as ce from icustays i join chartevents e on e.stay_id = i.stay_id and charttime between intime and intime + interval 1 day
   where itemid = 226732 and (lower(value) like '%cpap%' or lower(value) like '%bipap mask%') group by 1),
 q as (select q.stay_id, min(pao2fio2ratio) as pf from ({_gas}) q left join c on c.stay_id = q.stay_id where vent or charttime between cs and ce group by 1),
 x as (select i.subject_id, i.hadm_id, i.stay_id, {', '.join(f'{e} as {n}' for n, e in _lods.items())} from icustays i left join q on q.stay_id = i.stay_id {_day1} left join first_day_lab l on l.stay_id = i.stay_id)
 select *, {_parts(_lods)} as lods from x"""

_or = {
    "preiculos_score": _band("preiculos", [("10.2::double", 5), (297, 3), (1440, 0), (18708, 2), (None, 1)]),
    "age_score": _first(("age is null", "null"), ("age < 24", 0), ("age <= 53", 3), ("age <= 77", 6), ("age <= 89", 9), other="7"),
    "gcs_score": _first(("gcs is null", "null"), ("gcs <= 7", 10), ("gcs < 14", 4), ("gcs = 14", 3)),
    "urineoutput_score": _first(("urineoutput is null", "null"), ("urineoutput < 671.09", 10), ("urineoutput > 6896.8", 8), ("urineoutput between 671.09 and 1426.99", 5), ("urineoutput between 1427 and 2544.14", 1)),
    "mechvent_score": "case when mechvent = 1 then 9 else 0 end",
    "electivesurgery_score": _first(("electivesurgery is null", "null"), ("electivesurgery = 1", 0), other="6"),
}
_t = lambda c: f"{c}::decimal(10, 2)"
_ov = {
    ("heart_rate_score", "heartrate", "heart_rate_max", "heart_rate_min", "heart_rate_max"): [("heart_rate_max > 125", 6, "heart_rate_max"), ("heart_rate_min < 33", 4, "heart_rate_min"), ("heart_rate_max between 107 and 125", 3, "heart_rate_max"), ("heart_rate_max between 89 and 106", 1, "heart_rate_max")],
    ("mbp_score", "meanbp", "mbp_min", "mbp_min", "mbp_max"): [("mbp_min < 20.65::double", 4, "mbp_min"), ("mbp_min < 51", 3, "mbp_min"), ("mbp_max > 143.44::double", 3, "mbp_max"), ("mbp_min >= 51 and mbp_min < 61.33::double", 2, "mbp_min")],
    ("resp_rate_score", "resprate", "resp_rate_min", "resp_rate_min", "resp_rate_max"): [("resp_rate_min < 6", 10, "resp_rate_min"), ("resp_rate_max > 44", 9, "resp_rate_max"), ("resp_rate_max > 30", 6, "resp_rate_max"), ("resp_rate_max > 22", 1, "resp_rate_max"), ("resp_rate_min < 13", 1, "resp_rate_min")],
    ("temp_score", "temp", "temperature_max", "temperature_min", "temperature_max"): [(f"{_t('temperature_max')} > 39.88", 6, "temperature_max"), (f"{_t('temperature_min')} between 33.22 and 35.93", 4, "temperature_min"), (f"{_t('temperature_max')} between 33.22 and 35.93", 4, "temperature_max"),
        (f"{_t('temperature_min')} < 33.22", 3, "temperature_min"), (f"{_t('temperature_min')} > 35.93 and {_t('temperature_min')} <= 36.39", 2, "temperature_min"), (f"{_t('temperature_max')} between 36.89 and 39.88", 2, "temperature_max")],
}
for (_sc, _sh, _miss, _lo, _hi), _rows in _ov.items():
    _or[_sc] = _first((f"{_miss} is null", "null"), *[(c, v) for c, v, _ in _rows])
_shown = {_sh: f"case when {_miss} is null then null {' '.join(f'when {c} then {v}' for c, _, v in _rows)} else ({_lo} + {_hi}) / 2 end" for (_sc, _sh, _miss, _lo, _hi), _rows in _ov.items()}
SQL["oasis"] = f"""with s as (select i.stay_id, max(coalesce(lower(curr_service) like '%surg%' or curr_service = 'ORTHO', false)::int) as surg from icustays i left join services s on s.hadm_id = i.hadm_id and transfertime < intime + interval 1 day group by 1),
 x as (select i.subject_id, i.hadm_id, i.stay_id, date_diff('minute', a.admittime, intime) as preiculos, age, gcs_min as gcs, heart_rate_max, heart_rate_min, mbp_max, mbp_min, resp_rate_max, resp_rate_min, temperature_max, temperature_min, vent as mechvent, urineoutput,
   case when admission_type = 'ELECTIVE' and surg = 1 then 1 when admission_type is not null then 0 end as electivesurgery from icustays i join admissions a on a.hadm_id = i.hadm_id left join age ag on ag.hadm_id = i.hadm_id left join s on s.stay_id = i.stay_id {_day1} left join {_vent1} m on m.stay_id = i.stay_id),
 y as (select subject_id, hadm_id, stay_id, age, preiculos, gcs, urineoutput, mechvent, electivesurgery, {', '.join(f'{e} as {n}' for n, e in _or.items())}, {', '.join(f'{e} as {n}' for n, e in _shown.items())} from x),
 z as (select *, {_parts(_or)} as oasis from y) select *, 1 / (1 + exp(-(-6.1746::double + 0.1275::double * oasis))) as oasis_prob from z"""

_w = lambda n, lo, hi: f"{n}_max >= {lo} and {n}_max < {hi} and {n}_min >= {lo} and {n}_min < {hi}"
_sp = {
    "age_score": _band("age", [(40, 0), (60, 7), (70, 12), (75, 15), (80, 16), (None, 18)]),
    "hr_score": _first(("hr_max is null", "null"), ("hr_min < 40", 11), ("hr_max >= 160", 7), ("hr_max >= 120", 4), ("hr_min < 70", 2), (_w("hr", 70, 120), 0), other="null"),
    "sysbp_score": _first(("sbp_min is null", "null"), ("sbp_min < 70", 13), ("sbp_min < 100", 5), ("sbp_max >= 200", 2), (_w("sbp", 100, 200), 0), other="null"),
    "temp_score": _first(("temp_max >= 39", 3), ("temp_min < 39", 0), other="null"),
    "pao2fio2_score": _band("pf", [(100, 11), (200, 9), (None, 6)]),
    "uo_score": _band("uo", [(500, 11), (1000, 4), (None, 0)]),
    "bun_score": _band("bun_max", [(28, 0), (84, 6), (None, 10)]),
    "wbc_score": _first(("wbc_max is null", "null"), ("wbc_min < 1", 12), ("wbc_max >= 20", 3), (_w("wbc", 1, 20), 0), other="null"),
    "potassium_score": _first(("potassium_min < 3 or potassium_max >= 5", 3), (_w("potassium", 3, 5), 0), other="null"),
    "sodium_score": _first(("sodium_min < 125", 5), ("sodium_max >= 145", 1), (_w("sodium", 125, 145), 0), other="null"),
    "bicarbonate_score": _first(("bicarbonate_max is null", "null"), ("bicarbonate_min < 15", 6), ("bicarbonate_min < 20", 3)),
    "bilirubin_score": _band("bilirubin_max", [(4, 0), (6, 4), (None, 9)]),
    "gcs_score": _first(("mingcs is null or mingcs < 3", "null"), ("mingcs < 6", 26), ("mingcs < 9", 13), ("mingcs < 11", 7), ("mingcs < 14", 5), ("mingcs <= 15", 0), other="null"),
    "comorbidity_score": _first(("aids = 1", 17), ("hem = 1", 10), ("mets = 1", 9)),
    "admissiontype_score": _first(("admission_type = 'ELECTIVE' and surg = 1", 0), ("admission_type <> 'ELECTIVE' and surg = 1", 8), other="6"),
}
_d1 = lambda t, on, aggs: f"(select i.stay_id, {aggs} from icustays i join {t} e on e.{on} = i.{on} and e.charttime > i.intime and e.charttime <= i.intime + interval 24 hour group by 1)"
_mx = lambda d: ", ".join(f"min(e.{c}) as {n}_min, max(e.{c}) as {n}_max" for n, c in d.items())
SQL["sapsii"] = f"""with cp as (select i.subject_id, greatest(min(charttime) - interval 1 hour, intime) as cs, least(max(charttime) + interval 4 hour, intime + interval 24 hour) as ce from icustays i join chartevents e on e.stay_id = i.stay_id and charttime > intime and charttime <= intime + interval 24 hour
   where itemid = 226732 and regexp_matches(lower(value), 'cpap mask|bipap') group by i.subject_id, i.stay_id, intime),
 p as (select i.stay_id, pao2fio2ratio as pf, exists (select 1 from {_inv} v where v.stay_id = i.stay_id and b.charttime > vs and b.charttime <= ve) or exists (select 1 from cp where cp.subject_id = i.subject_id and b.charttime > cs and b.charttime <= ce) as sup
   from icustays i join bg b on b.subject_id = i.subject_id and specimen = 'ART.' and b.charttime > intime and b.charttime <= intime + interval 24 hour),
 q as (select stay_id, min(pf) as pf from p where sup group by 1), sv as (select hadm_id, arg_min((lower(curr_service) like '%surg%')::int, (transfertime, curr_service)) as surg from services group by 1),
 dx as (select hadm_id, {', '.join(f'{_icd(n, t)} as {k}' for k, (n, t) in S.SAPS_CODES.items())} from diagnoses_icd group by 1),
 x as (select i.subject_id, i.hadm_id, i.stay_id, i.intime as starttime, i.intime + interval 24 hour as endtime, {', '.join(f'{e} as {n}' for n, e in _sp.items())} from icustays i join admissions a on a.hadm_id = i.hadm_id left join age ag on ag.hadm_id = i.hadm_id left join q on q.stay_id = i.stay_id
   left join sv on sv.hadm_id = i.hadm_id left join dx on dx.hadm_id = i.hadm_id left join {_d1('gcs', 'stay_id', 'min(e.gcs) as mingcs')} g on g.stay_id = i.stay_id left join {_d1('vitalsign', 'subject_id', _mx({'hr': 'heart_rate', 'sbp': 'sbp', 'temp': 'temperature'}))} v on v.stay_id = i.stay_id
   left join {_d1('urine_output', 'stay_id', 'sum(e.urineoutput) as uo')} u on u.stay_id = i.stay_id left join {_d1('chemistry', 'subject_id', _mx({k: k for k in ('bun', 'potassium', 'sodium', 'bicarbonate')}))} c on c.stay_id = i.stay_id
   left join {_d1('complete_blood_count', 'subject_id', _mx({'wbc': 'wbc'}))} w on w.stay_id = i.stay_id left join {_d1('enzyme', 'subject_id', _mx({'bilirubin': 'bilirubin_total'}))} z on z.stay_id = i.stay_id),
 y as (select *, {_parts(_sp)} as sapsii from x) select *, 1 / (1 + exp(-(-7.7631::double + 0.0737::double * sapsii + 0.9971::double * ln(sapsii + 1)))) as sapsii_prob from y"""


def _aps(name: str, col: str) -> str:
    bands = [(f"{b}::double" if b is not None else None, v) for b, v in S.APS_BANDS[name][1]]
    e = _band(col, bands)
    if name == "resp_rate":
        e = f"case when vent = 1 and {col} < 14 then 0 else {e} end"
    if name == "creatinine":
        e = f"case when arf and {col} < 1.5::double then 0 when arf and {col} >= 1.5::double then 10 else {e} end"
    return e


_as = {}
for _k, (_src, _b, _ref) in S.APS_BANDS.items():
    _h, _l = f"{_src}_max", f"{_src}_min"
    if _ref is None:
        _as[f"{_k}_score"] = f"case when {_h} is not null then {_aps(_k, _h)} end"
    else:
        _worse = f"case when abs({_h} - {_ref}::double) > abs({_l} - {_ref}::double) then {_aps(_k, _h)} when abs({_h} - {_ref}::double) < abs({_l} - {_ref}::double) then {_aps(_k, _l)} else greatest({_aps(_k, _h)}, {_aps(_k, _l)}) end"
        _as[f"{_k}_score"] = f"case when {_h} is null then null {f'when arf then {_aps(_k, _h)}' if _k == 'creatinine' else ''} else {_worse} end"
_as["uo_score"] = _band("urineoutput", S.URINE_BANDS)
_as["pao2_aado2_score"] = f"case when pao2 is not null then {_band('pao2', S.PAO2_BANDS)} else {_band('aado2', S.AADO2_BANDS)} end"
_e1 = [("1", "1, 2", 48), ("1", "3, 4", 33), ("1", "5, 6", 16), ("2, 3", "1, 2", 29), ("2, 3", "3, 4", 24)]
_e2 = [("1", "1, 2", 29), ("1", "3, 4", 24), ("1", "5, 6", 15), ("2, 3", "1, 2", 29), ("2, 3", "3, 4", 24), ("2, 3", "5", 13), ("2, 3", "6", 10), ("4", "1, 2, 3, 4", 13), ("4", "5", 8), ("4", "6", 3), ("5", "1, 2, 3, 4, 5", 3), ("5", "6", 0)]
_coma = lambda rows: "case " + " ".join(f"when gcs_verbal in ({v}) and gcs_motor in ({m}) then {p}" for v, m, p in rows) + " end"
_as["gcs_score"] = f"case when gcs_unable = 1 then 0 when gcs_eyes = 1 then {_coma(_e1)} when gcs_eyes > 1 then {_coma(_e2)} end"
_acid = "case " + " ".join((f"when ph < {b}::double then " if b is not None else "else ") + _band("pco2", bands) for b, bands in S.ACID_BANDS) + " end"
SQL["apsiii"] = f"""with q as (select stay_id, max(po2) filter (not vent and coalesce(fio2, fio2_chartevents, 21) < 50) as pao2, max(aado2) filter (vent and coalesce(fio2, fio2_chartevents) >= 50) as aado2, max(case when ph is not null and pco2 is not null then {_acid} end) as acidbase_score
   from ({_gas}) where specimen = 'ART.' group by 1), k as (select hadm_id, {_icd('5854 5855 5856', 'N184 N185 N186')} as ckd from diagnoses_icd group by 1),
 x as (select i.subject_id, i.hadm_id, i.stay_id, q.pao2, q.aado2, acidbase_score, v.* exclude (subject_id, stay_id, glucose_min, glucose_max), l.* exclude (subject_id, stay_id, glucose_min, glucose_max), greatest(l.glucose_max, v.glucose_max) as glucose_max, least(l.glucose_min, v.glucose_min) as glucose_min,
   urineoutput, gcs_motor, gcs_verbal, gcs_eyes, gcs_unable, vent, coalesce(creatinine_max >= 1.5::double and urineoutput < 410 and ckd = 0, false) as arf from icustays i left join q on q.stay_id = i.stay_id left join k on k.hadm_id = i.hadm_id
   {_day1} left join first_day_lab l on l.stay_id = i.stay_id left join {_vent1} m on m.stay_id = i.stay_id),
 y as (select subject_id, hadm_id, stay_id, acidbase_score, {', '.join(f'{e} as {n}' for n, e in _as.items())} from x),
 z as (select *, {_parts([*_as, 'acidbase_score'])} as apsiii from y) select *, 1 / (1 + exp(-(-4.436::double + 0.04726::double * apsiii))) as apsiii_prob from z"""

# computed columns that are rounded only in the final result
_mean8 = [f"{v}_{m}" for v in _vs for m in ("min", "max")]
ROUNDED = {
    "vitalsign": ["heart_rate", "sbp", "dbp", "mbp", "sbp_ni", "dbp_ni", "mbp_ni", "resp_rate", "spo2", "glucose"],
    "first_day_vitalsign": _mean8, "bg": ["fio2_chartevents", "fio2", "pao2fio2ratio"],
    "kdigo_creatinine": ["creat", "creat_low_past_48hr", "creat_low_past_7day"], "kdigo_stages": ["creat", "creat_low_past_48hr", "creat_low_past_7day"],
    "sofa": ["pao2fio2ratio_novent", "pao2fio2ratio_vent", "rate_epinephrine", "rate_norepinephrine", "rate_dopamine", "rate_dobutamine", "meanbp_min", "uo_24hr"],
    "vasoactive_agent": list(B.AGENT_CODES), **{n: ["vaso_rate"] for n in B.AGENT_CODES},
    "first_day_bg": ["pao2fio2ratio_min", "pao2fio2ratio_max"], "first_day_bg_art": ["pao2fio2ratio_min", "pao2fio2ratio_max"],
    "oasis": ["oasis_prob", "heartrate", "meanbp", "resprate", "temp"], "sapsii": ["sapsii_prob"], "apsiii": ["apsiii_prob"],
}

_RAW = duck_raw()
_ALL = {**_RAW, **SQL}


def _needs(body: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", body))
    return [n for n in _ALL if n in words and re.search(rf"(?:from|join)\s+{n}\b", body)]


def oracle(name: str) -> str:
    """The body with every table it reads, directly or not, as common table expressions."""
    rounded = ", ".join(f"round({c}, 6) as {c}" for c in ROUNDED.get(name, ()))
    return f"{tables([name])}\nselect *{f' replace ({rounded})' if rounded else ''} from {name}"


def tables(names: list[str]) -> str:
    """A ``with`` clause that defines the named tables and all they read."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in _needs(_ALL[n]):
            if m != n:
                visit(m)
        order.append(n)

    for name in names:
        visit(name)
    return "with " + ",\n".join(f"{n} as ({_ALL[n]})" for n in order)
