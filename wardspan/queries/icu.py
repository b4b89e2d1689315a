"""ICU-shaped tables derived from the driver tables, in SQL that Spark and DuckDB both read.

A customer stands for a stay (two stays make an admission, two admissions a subject), a line
item for one bedside moment, at which a group of items is charted. Item numbers, units and texts
are those the derived-table catalogue looks for.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from wardspan.plans.concepts import Catalog
from wardspan.queries.registry import Tables

VENT_MODES = "CMV|PSV/SBT|SIMV|Standby|CPAP/PSV"
HAMILTON = "ASV|NIV|DuoPaP|Standby"
DEVICES = "Nasal cannula|Endotracheal tube|Bipap mask |High flow nasal cannula|None|Trach mask |Face tent|Other"
RHYTHMS = "SR (Sinus Rhythm)|AF (Atrial Fibrillation)|ST (Sinus Tachycardia)"
# group: [(item, low, high, texts)]
CHART_ITEMS = {
    0: [(220045, 10, 220, ""), (220210, 2, 60, ""), (220277, 60, 105, ""), (223835, 0, 100, ""), (220179, 40, 250, ""), (220180, 20, 140, ""), (220181, 30, 170, "")],
    1: [(223901, 1, 6.9, ""), (223900, 1, 5.9, "No Response-ETT|Confused|Oriented|Oriented|Confused"), (220739, 1, 4.9, ""), (223761, 60, 125, ""), (223762, 5, 45, "")],
    2: [(224688, 5, 40, ""), (224689, 0, 30, ""), (224690, 5, 50, ""), (224687, 2, 20, ""), (224684, 200, 800, ""), (224685, 200, 800, ""), (224686, 200, 800, ""),
        (224696, 10, 40, ""), (220339, -5, 120, ""), (224700, 0, 20, ""), (223849, 0, 1, VENT_MODES), (229314, 0, 1, HAMILTON), (223848, 0, 1, "Drager|Hamilton"), (224691, 10, 90, "")],
    3: [(223834, 0, 60, ""), (227582, 0, 60, ""), (227287, 0, 30, ""), (226732, 0, 1, DEVICES)],
    4: [(220048, 0, 1, RHYTHMS), (224650, 0, 1, "PVC's|None"), (224651, 0, 1, "Rare|Frequent"), (226479, 0, 1, "PAC's|None"), (226480, 0, 1, "Rare|Frequent"),
        (224642, 0, 1, "Oral|Axillary"), (220765, 0, 120, ""), (227989, 0, 120, "")],
    5: [(224149, -100, 0, ""), (224144, 50, 300, ""), (228004, 0, 300, ""), (225183, 0, 200, ""), (224154, 0, 900, ""), (224151, 0, 200, ""), (224150, 0, 300, ""), (224145, 0, 20, ""),
        (224191, 0, 300, ""), (228005, 0, 900, ""), (228006, 0, 900, ""), (224153, 0, 900, ""), (224152, 0, 200, ""), (226457, 0, 900, ""), (227290, 0, 1, "CVVHDF|CVVH|SCUF"),
        (225977, 0, 1, "Prismasate K2|Prismasate K4"), (225958, 0, 1, "0|1"), (225976, 0, 1, "Prismasate K0|Bicarb"), (224146, 0, 1, "Active|Recirculating|Clots Present|No Clot Present|Clotted|Clots Increasing")],
    6: [(226512, 30, 160, ""), (224639, 30, 160, ""), (226707, 40, 95, ""), (226730, 100, 240, ""), (225664, 20, 400, ""), (220621, 20, 400, ""), (226537, 20, 400, "")],
    7: [(220050, 40, 250, ""), (220051, 20, 140, ""), (220052, 30, 170, ""), (225309, 40, 250, ""), (225310, 20, 140, ""), (225312, 30, 170, ""), (220045, 30, 180, "")],
    8: [(226118, 0, 1, "Tunneled|Temporary"), (225725, 0, 1, "a|b"), (226499, 0, 1, "x|y"), (225810, 0, 1, "q|r"), (225965, 0, 1, "In use|Capped"), (223758, 0, 1, "Full code|DNR / DNI|Comfort measures only|DNI (do not intubate)")],
    9: [(220045, 20, 200, ""), (220181, 30, 170, ""), (220179, 40, 250, ""), (220277, 70, 100, ""), (223835, 0, 1, "")],
    10: [(224690, 5, 75, ""), (223835, 15, 100, ""), (226732, 0, 1, DEVICES), (223849, 0, 1, VENT_MODES)],
}
LAB_ITEMS = {
    0: [(50862, 1, 6, ""), (50930, 1, 6, ""), (50976, 3, 22, ""), (50868, -3, 30, ""), (50882, 5, 45, ""), (51006, 3, 310, ""), (50893, 5, 12, ""), (50902, 80, 130, ""), (50912, 0.2, 9, ""),
        (50931, 40, 600, ""), (50983, 110, 165, ""), (50971, 2, 8, "")],
    1: [(51221, 15, 55, ""), (51222, 5, 18, ""), (51248, 20, 40, ""), (51249, 25, 38, ""), (51250, 70, 110, ""), (51265, 5, 500, ""), (51279, 2, 6, ""), (51277, 11, 25, ""), (52159, 35, 80, ""), (51301, 0.5, 30, "")],
    2: [(51300, 0.5, 30, ""), (51146, 0, 3, ""), (51200, 0, 10, ""), (51244, 0, 60, ""), (51254, 0, 20, ""), (51256, 0, 95, ""), (51143, 0, 5, ""), (51144, 0, 30, ""), (52135, 0, 4, ""), (51251, 0, 4, ""), (51257, 0, 4, ""),
        (52069, 0, 0.3, ""), (52073, 0, 1, ""), (51199, 0, 900, ""), (51133, 0, 5, ""), (52769, 0, 5000, ""), (52074, 0, 2, ""), (51253, 0, 2000, ""), (52075, 0, 20, ""), (51218, 0, 9000, "")],
    3: [(52033, 0, 1, "ART.|ART.|VEN.|ART."), (50801, 10, 600, ""), (50802, -15, 15, ""), (50803, 5, 40, ""), (50804, 10, 45, ""), (50805, 0, 5, ""), (50806, 80, 130, ""), (50808, 0.8, 1.6, ""), (50809, 40, 500, ""),
        (50810, 15, 110, ""), (50811, 5, 18, ""), (50813, 0.4, 15, ""), (50814, 0, 3, ""), (50816, 15, 105, ""), (50817, 50, 104, ""), (50818, 15, 90, ""), (50820, 7, 7.7, ""), (50821, 30, 300, ""), (50822, 2, 8, ""), (50824, 120, 160, ""), (50825, 33, 41, "")],
    4: [(50861, 5, 900, ""), (50863, 20, 500, ""), (50878, 5, 900, ""), (50867, 10, 300, ""), (50885, 0.1, 15, ""), (50883, 0.1, 8, ""), (50884, 0.1, 8, ""), (50910, 20, 3000, ""), (50911, 1, 60, ""), (50927, 5, 400, ""), (50954, 100, 900, "")],
    5: [(51196, 100, 9000, ""), (51214, 100, 800, ""), (51297, 10, 40, ""), (51237, 0.8, 6, ""), (51274, 9, 60, ""), (51275, 20, 150, "")],
    6: [(51003, 0.01, 6, ""), (50911, 1, 60, ""), (50963, 50, 9000, ""), (50889, 0.2, 250, ""), (50821, 30, 300, ""), (50818, 15, 90, ""), (50820, 7, 7.7, ""), (52033, 0, 1, "ART.|VEN."), (50816, 0.1, 1.2, "")],
}


def _items(groups: dict) -> str:
    rows, k = [], 0
    for g, items in groups.items():
        for code, lo, hi, texts in items:
            t = texts.replace("'", "''")
            n = len(texts.split("|")) if texts else 0
            rows.append(f"({g}, {k}, {code}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), '{t}', {n})")
            k += 1
    return f"(VALUES {', '.join(rows)}) AS items(grp, k, itemid, lo, hi, texts, n)"


_N = "CAST(floor({x}) AS BIGINT)"


def _div(x: str, y: int) -> str:
    return f"CAST(floor({x} / {y}.0) AS BIGINT)"


SUBJECT, HADM = _div("c_custkey", 4), f"(100000 + {_div('c_custkey', 2)})"
_DAY0 = "CAST(TIMESTAMP '2150-01-01 00:00:00' AS TS_TYPE)"
_ADMIT = f"{_DAY0} + INTERVAL '1' DAY * ({SUBJECT} % 300) + INTERVAL '1' DAY * (({HADM} % 2) * 20)"
_INTIME = f"{_ADMIT} + INTERVAL '1' HOUR * (5 + (c_custkey % 2) * 80 + c_custkey % 7) + INTERVAL '1' MINUTE * (c_custkey * 7 % 60)"

_MOMENT = "INTERVAL '1' MINUTE * ((l_partkey * {a} + l_suppkey * {b} + l_linenumber * {c} + CAST(l_quantity AS BIGINT) * 13) % {m})"

_MOMENTS = "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN ({icustays}) AS s ON s.stay_id = o_custkey"


def _events(items: dict, a: int, b: int, c: int, m: int, lead: int, groups: int, seed: int, extra: str) -> str:
    at = _MOMENT.format(a=a, b=b, c=c, m=m)
    mix = f"(CAST(l_quantity AS BIGINT) * 7 + l_partkey * 13 + k * 31 + l_linenumber * 17 + {seed}) % 101"
    num = f"floor((lo + ({mix}) / 100.0 * (hi - lo)) * 10) / 10.0"
    absent = "(l_suppkey * 3 + k) % 17 = 0"
    whole = "CASE WHEN itemid IN (223901, 223900, 220739) THEN floor(v) ELSE v END"
    return f"""SELECT subject_id, hadm_id, stay_id, charttime, charttime + INTERVAL '1' MINUTE * l_linenumber AS storetime, itemid, specimen_id,
      CASE WHEN n > 0 THEN CASE WHEN pick % 9 = 8 THEN NULL ELSE split_part(texts, '|', CAST(1 + pick % n AS INT)) END WHEN v IS NOT NULL THEN 'num' END AS value,
      CAST(CASE WHEN n > 0 AND itemid <> 223900 THEN NULL ELSE {whole} END AS DOUBLE) AS valuenum {extra}
    FROM (SELECT s.subject_id, s.hadm_id, s.stay_id, s.intime - INTERVAL '1' HOUR * {lead} + {at} AS charttime, l_linenumber, itemid, texts, n, k,
      l_orderkey * 10 + l_linenumber AS specimen_id, (l_partkey + l_suppkey * 3 + k) AS pick, CASE WHEN {absent} THEN NULL ELSE {num} END AS v
    {_MOMENTS}
      JOIN {_items(items)} ON (l_partkey + l_linenumber * 3 + l_suppkey) % {groups} = items.grp) AS q"""


DRUGS = "Vancomycin|Lisinopril|Losartan Potassium|Aspirin EC|Cefepime|Ibuprofen|Docusate Sodium|Valsartan|Ciprofloxacin HCl|Enalapril Maleate|Heparin|Erythromycin Ophth Oint|Bacitracin Cream|Meropenem|Naproxen"
ROUTES = "IV|PO|PO|OU|TP|PO/NG|IV DRIP|LEFT EAR"
CODES9 = "41011|4280|4254|440|43310|2901|4912|7100|5311|5712|25001|25040|3420|5853|1741|5722|1970|042|36234|20021|2386|V434|585|78951"
CODES10 = "I219|I509|I700|G450|F051|J449|M069|K259|K702|E119|E112|G819|N185|C341|I850|C780|B20|I252|C819|N189|Z940|C800|R074|S720"
INPUTS = "221906|221289|221662|221653|221749|222315|221986|222062|227536|225158|221906|221749"
UNITS = "mcg/kg/min|mg/kg/min|mcg/min|units/min|units/hour"
OUTPUTS = "226559|226560|226561|226584|226563|227488|226565|227489|226633"
PROCS = "225441|225802|225803|225805|224270|225809|225955|225436|225752|224263|224267|225199"
LABELS = "224270=Dialysis Catheter|225752=Arterial Line|224263=Multi Lumen|224267=CCO PAC|225199=Triple Introducer"
SITES = "Left Femoral.|Right Antecub|Left Brachial|Right IJ"
ORGS = "STAPH AUREUS|ESCHERICHIA COLI|CANCELLED||KLEBSIELLA"
SPECS = "BLOOD CULTURE|URINE|SPUTUM"
SERVICES = "MED|SURG|CSURG|ORTHO|NMED"
ORDERS = "Resuscitate (Full code)|Do not resuscitate (DNR/DNI)|Full code (attempt resuscitation)"


def _pick(text: str, n: int, by: str) -> str:
    return f"split_part('{text}', '|', CAST(1 + ({by}) % {n} AS INT))"


_BASE = _MOMENTS
_IN_AT = _MOMENT.format(a=41, b=7, c=113, m=2900)

RAW = {
    "icustays": f"""SELECT {SUBJECT} AS subject_id, {HADM} AS hadm_id, c_custkey AS stay_id, {_INTIME} AS intime,
        {_INTIME} + INTERVAL '1' HOUR * (50 + c_custkey % 9) AS outtime, {_pick('MICU|SICU|CCU', 3, 'c_custkey')} AS first_careunit FROM {{customer}}""",
    "admissions": f"""SELECT MIN({SUBJECT}) AS subject_id, {HADM} AS hadm_id, MIN({_ADMIT}) AS admittime, MIN({_ADMIT}) + INTERVAL '1' HOUR * (190 + {HADM} % 30) AS dischtime,
        CASE WHEN {HADM} % 3 = 0 THEN 'ELECTIVE' ELSE 'EW EMER.' END AS admission_type, 'HOME' AS discharge_location, 'UNKNOWN' AS race,
        CAST(CASE WHEN {HADM} % 10 = 4 THEN 1 ELSE 0 END AS INT) AS hospital_expire_flag FROM {{customer}} GROUP BY {HADM}""",
    "patients": f"""SELECT {SUBJECT} AS subject_id, CASE WHEN {SUBJECT} % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(12 + {SUBJECT} % 75 AS INT) AS anchor_age,
        CAST(2145 + {SUBJECT} % 5 AS INT) AS anchor_year, CAST(NULL AS TS_TYPE) AS dod FROM {{customer}} GROUP BY {SUBJECT}""",
    "chartevents": _events(CHART_ITEMS, 37, 11, 101, 3200, 2, 11, 0, ""),
    "labevents": _events(LAB_ITEMS, 53, 29, 59, 3900, 8, 7, 5, ""),
    "inputevents": f"""SELECT s.stay_id, CAST({_pick(INPUTS, 12, 'l_suppkey + l_linenumber')} AS INT) AS itemid, s.intime + {_IN_AT} AS starttime,
        s.intime + {_IN_AT} + INTERVAL '1' MINUTE * (10 + CAST(l_quantity AS BIGINT) * 6) AS endtime, CAST(floor(l_discount * 300 + l_partkey % 7) / 100.0 AS DOUBLE) AS rate, CAST(floor(l_extendedprice) / 100.0 AS DOUBLE) AS amount,
        {_pick(UNITS, 5, 'l_partkey')} AS rateuom, CAST(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 40 + l_suppkey % 80 END AS DOUBLE) AS patientweight,
        l_orderkey AS orderid, l_partkey AS linkorderid {_BASE}""",
    "outputevents": f"""SELECT s.stay_id, CAST({_pick(OUTPUTS, 9, 'l_partkey + l_linenumber')} AS INT) AS itemid, s.intime + {_MOMENT.format(a=19, b=31, c=71, m=2990)} AS charttime,
        CAST(l_quantity * 12 AS DOUBLE) AS value {_BASE}""",
    "procedureevents": f"""SELECT s.stay_id, CAST({_pick(PROCS, 12, 'l_partkey + l_suppkey')} AS INT) AS itemid, s.intime + {_MOMENT.format(a=23, b=3, c=37, m=2500)} AS starttime,
        s.intime + {_MOMENT.format(a=23, b=3, c=37, m=2500)} + INTERVAL '1' MINUTE * (30 + CAST(l_quantity AS BIGINT) * 9) AS endtime,
        CASE WHEN l_partkey % 8 > 0 THEN l_quantity END AS value, {_pick(SITES, 4, 'l_suppkey')} AS location {_BASE}""",
    "prescriptions": f"""SELECT s.subject_id, s.hadm_id, {_pick(DRUGS, 15, 'l_partkey')} AS drug, {_pick(ROUTES, 8, 'l_suppkey')} AS route, CASE WHEN l_partkey % 6 = 5 THEN 'BASE' ELSE 'MAIN' END AS drug_type,
        s.intime + {_MOMENT.format(a=29, b=17, c=83, m=4000)} - INTERVAL '1' HOUR * 10 AS starttime, s.intime + {_MOMENT.format(a=29, b=17, c=83, m=4000)} + INTERVAL '1' HOUR * l_linenumber * 5 AS stoptime {_BASE}""",
    "diagnoses_icd": f"""SELECT DISTINCT s.subject_id, s.hadm_id, CAST(l_linenumber AS INT) AS seq_num, CASE WHEN l_partkey % 2 = 0 THEN {_pick(CODES9, 24, 'l_partkey + l_suppkey')} ELSE {_pick(CODES10, 24, 'l_partkey + l_suppkey')} END AS icd_code,
        CAST(CASE WHEN l_partkey % 2 = 0 THEN 9 ELSE 10 END AS INT) AS icd_version {_BASE}""",
    "services": f"""SELECT s.subject_id, s.hadm_id, s.intime + {_MOMENT.format(a=3, b=5, c=91, m=2000)} - INTERVAL '1' HOUR * 12 AS transfertime, {_pick(SERVICES, 5, 'l_partkey')} AS curr_service {_BASE}""",
    "microbiologyevents": f"""SELECT s.subject_id, s.hadm_id, l_orderkey * 10 + l_linenumber AS micro_specimen_id, date_trunc('day', s.intime + {_MOMENT.format(a=61, b=13, c=47, m=5000)} - INTERVAL '1' HOUR * 30) AS chartdate,
        CASE WHEN (l_orderkey + l_linenumber) % 4 > 0 THEN s.intime + {_MOMENT.format(a=61, b=13, c=47, m=5000)} - INTERVAL '1' HOUR * 30 END AS charttime,
        {_pick(SPECS, 3, 'l_orderkey')} AS spec_type_desc, CAST(CASE WHEN l_partkey % 9 = 0 THEN 90856 ELSE 80002 END AS INT) AS org_itemid, {_pick(ORGS, 5, 'l_partkey')} AS org_name {_BASE}""",
    "poe": f"""SELECT CAST(l_orderkey AS STRING_TYPE) AS poe_id, MIN(s.subject_id) AS subject_id, MIN(s.hadm_id) AS hadm_id, MIN(s.intime + {_MOMENT.format(a=7, b=5, c=11, m=3300)}) AS ordertime, 'General Care' AS order_type, 'Code status' AS order_subtype {_BASE} GROUP BY l_orderkey""",
    "poe_detail": f"""SELECT CAST(o_orderkey AS STRING_TYPE) AS poe_id, {_pick(ORDERS, 3, 'o_custkey + o_orderkey')} AS field_value FROM {{orders}}""",
    "d_items": "SELECT * FROM (VALUES " + ", ".join(f"({x.split('=')[0]}, '{x.split('=')[1]}')" for x in LABELS.split("|")) + ") AS d(itemid, label)",
}


def spark_raw(t: Tables, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The raw tables. ``keep`` may store the join of line items with their stays, which most of them read.

    A line item is charted as many items, so the event tables themselves stay unstored: what a reader asks of
    ``itemid`` then reaches the list of items, and only its rows are made.
    """
    src = {n: t(n) for n in ("customer", "orders", "lineitem")}
    out: dict[str, DataFrame] = {}
    out["icustays"] = src["icustays"] = t.spark.sql(RAW["icustays"].replace("TS_TYPE", "TIMESTAMP_NTZ"), customer=src["customer"])
    joined = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, subject_id, hadm_id, stay_id, intime " + _MOMENTS
    src["moments"] = keep(t.spark.sql(joined.replace("({icustays})", "{icustays}"), **{n: src[n] for n in ("lineitem", "orders", "icustays")}))
    for name, sql in RAW.items():
        text = sql.replace("TS_TYPE", "TIMESTAMP_NTZ").replace("STRING_TYPE", "STRING").replace(_MOMENTS, "FROM {moments} AS s")
        # tenths and hundredths as doubles, not as Spark's decimals: of whole numbers both give the nearest double
        text = re.sub(r"/ (10+\.0)\b", r"/ \1D", text)
        if name not in out:
            out[name] = t.spark.sql(text, **{n: d for n, d in src.items() if "{" + n + "}" in text})
    out["chartevents"] = out["chartevents"].drop("specimen_id")
    return out


def duck_raw() -> dict[str, str]:
    """CTE bodies of the raw tables for DuckDB."""
    out = {}
    for name, sql in RAW.items():
        text = sql.replace("TS_TYPE", "TIMESTAMP").replace("STRING_TYPE", "VARCHAR")
        out[name] = text.format(customer="customer", orders="orders", lineitem="lineitem", icustays="select * from icustays")
    return out


def catalog(t: Tables) -> Catalog:
    return Catalog(t.spark, spark_raw(t))
