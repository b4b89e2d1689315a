"""Ledger, grounding, retrieval, resources and reporting tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspan.functions import retrieval as RT
from wardspan.functions import text as X
from wardspan.plans import facts as FA
from wardspan.plans import resources as RS
from wardspan.queries.analytics import r
from wardspan.queries.concept_sql import tables
from wardspan.queries.concepts import catalog
from wardspan.queries.grid import CUT_SQL, tiered_grid
from wardspan.queries.registry import query
from wardspan.reports import summaries as G

_NOTE = "n as (select conv_id * 1000 + turn as note_id, conv_id, '[F' || lpad((turn % 4)::varchar, 3, '0') || case when turn % 3 = 0 then ', F009' else '' end || '] ' || text as body from conversations)"
_LEDGER = _NOTE + r""", p as (select note_id, conv_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(body, '^ +| +$', '', 'g'), '([.!?])\s+([A-Z\[])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(regexp_replace(regexp_replace(body, '^ +| +$', '', 'g'), '([.!?])\s+([A-Z\[])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)), 1) as i from n),
  l as (select note_id, conv_id, row_number() over (partition by note_id order by i) - 1 as sentence_idx, regexp_replace(s, '^\s+|\s+$', '', 'g') as text from p where regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')"""


def notes(t):
    turn = F.col("turn")
    more = F.when(turn % 3 == 0, ", F009").otherwise("")
    cite = F.concat(F.lit("[F"), F.lpad((turn % 4).cast("string"), 3, "0"), more, F.lit("] "))
    return t("conversations").select((F.col("conv_id") * 1000 + turn).alias("note_id"), "conv_id", F.concat(cite, F.col("text")).alias("body"))


@query(
    "sentence_ledger",
    f"with {_LEDGER} select note_id, conv_id, sentence_idx::integer as sentence_idx, text, flatten(list_transform(regexp_extract_all(text, '\\[(F\\d{{3}}(?:\\s*,\\s*F\\d{{3}})*)\\]', 1), lambda g: list_transform(string_split(g, ','), lambda f: trim(f)))) as cited from l",
)
def _(t):
    return X.ledger(notes(t), "note_id", "body", ["conv_id"])


@query(
    "citation_validity",
    f"""with {_LEDGER}, c as (select note_id, conv_id, text, unnest(flatten(list_transform(regexp_extract_all(text, '\\[(F\\d{{3}}(?:\\s*,\\s*F\\d{{3}})*)\\]', 1), lambda g: list_transform(string_split(g, ','), lambda f: trim(f))))) as fact_id from l),
    k as (select distinct conv_id, 'F' || lpad((turn % 3)::varchar, 3, '0') as fact_id from conversations), b as (select note_id, count(*) as n_invalid, count(distinct text) as n_bad from c where (conv_id, fact_id) not in (select conv_id, fact_id from k) group by 1),
    s as (select note_id, count(*) as n_sentences, count(*) filter (regexp_matches(text, '\\[F\\d{{3}}')) as n_cited from l group by 1)
    select note_id, n_sentences, n_cited, coalesce(n_invalid, 0) as n_invalid, coalesce(n_bad, 0) as n_bad_sentences, round((n_sentences - coalesce(n_bad, 0)) / n_sentences, 6) as faithfulness from s left join b using (note_id)""",
)
def _(t):
    led = X.ledger(notes(t), "note_id", "body", ["conv_id"])
    known = t("conversations").select("conv_id", F.concat(F.lit("F"), F.lpad((F.col("turn") % 3).cast("string"), 3, "0")).alias("fact_id"))
    return X.faithfulness(led, known, "note_id", "conv_id").select(
        "note_id", "n_sentences", "n_cited", "n_invalid", "n_bad_sentences", r("faithfulness")
    )


@query(
    "passages",
    f"""with {_LEDGER} select note_id || '#' || sentence_idx as passage_id, length(text)::integer as n_chars from l where length(regexp_replace(regexp_replace(text, '^[#*\\- ]+', ''), '^\\s+|\\s+$', '', 'g')) >= 15""",
)
def _(t):
    led = X.ledger(notes(t), "note_id", "body", ["conv_id"])
    return X.passages(led, "note_id").select("passage_id", F.length("text").alias("n_chars"))


# the pattern's look-around, which the oracle lacks: a sign or digit right after a letter and a digit right before one do not count
_NUM = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace({c}, '([A-Za-z])[-\d]', '\1' || chr(1), 'g'), '\d([A-Za-z])', chr(1) || '\1', 'g'), '-?\d+(?:\.\d+)?'), lambda n: n::double)"
_FACTS = "'{{\"doc\": {{\"size\": ' || {size} || ', \"parts\": [' || {part} || ', {{\"year\": 2024, \"ok\": true}}, \"stage 7 of 12\"]}}, \"none\": null, \"share\": 0.25}}'"


@query(
    "number_grounding",
    f"""with f as (select doc_id, {_FACTS.format(size="n_chars", part="(doc_id % 100)")} as facts from documents),
    l as (select doc_id, j.type as kind, j.atom from f, json_tree(f.facts) j),
    s as (select doc_id, atom::double as s from l where kind in ('UBIGINT', 'BIGINT', 'DOUBLE') union select doc_id, unnest({_NUM.format(c="json_extract_string(atom, '$')")}) from l where kind = 'VARCHAR'),
    n as (select doc_id, unnest({_NUM.format(c="text")}) as n from documents),
    g as (select doc_id, n, exists (select 1 from s where s.doc_id = n.doc_id and abs(n.n - s.s) <= 0.5) as hit from n)
    select doc_id, count(n) as n_numbers, count(*) filter (hit) as n_grounded, round(case when count(n) > 0 then count(*) filter (hit) / count(n) else 1 end, 6) as grounded_rate from documents left join g using (doc_id) group by 1""",
)
def _(t):
    d = t("documents")
    facts = F.concat(
        F.lit('{"doc": {"size": '), F.col("n_chars").cast("string"), F.lit(', "parts": ['), (F.col("doc_id") % 100).cast("string"),
        F.lit(', {"year": 2024, "ok": true}, "stage 7 of 12"]}, "none": null, "share": 0.25}'),
    )
    source = X.json_numbers(d.select("doc_id", facts.alias("facts")), "doc_id", "facts")
    return X.ground_against(d, source, "doc_id", "text").select("doc_id", "n_numbers", "n_grounded", r("grounded_rate"))


_STOP = ["the", "of", "and", "in", "le", "la", "et", "de"]
_TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _tfidf_sql(corpus: str, queries: str, k: int) -> str:
    stop = ", ".join(repr(w) for w in _STOP)
    return f"""c0 as (select doc_id, unnest({_TOK.format(c='text')}) as term from ({corpus})), c as (select doc_id, term, count(*) as tf from c0 where term not in ({stop}) group by 1, 2),
    q0 as (select query_id, unnest({_TOK.format(c='query_text')}) as term from ({queries})), q as (select query_id, term, count(*) as tf from q0 where term not in ({stop}) group by 1, 2),
    idf as (select term, ln((1 + nd) / (1 + count(*))::double) + 1 as idf from c, (select count(*)::double as nd from ({corpus})) group by term, nd having count(*) <= 0.9 * nd),
    dw as (select doc_id, term, tf * idf as w from c join idf using (term)), dn as (select doc_id, sqrt(sum(w * w)) as n from dw group by 1), qw as (select query_id, term, tf * idf as w from q join idf using (term)), qn as (select query_id, sqrt(sum(w * w)) as n from qw group by 1),
    hit as (select query_id, doc_id, sum(dw.w / dn.n * qw.w / qn.n) as score from dw join dn using (doc_id) join qw using (term) join qn using (query_id) group by 1, 2 having sum(dw.w / dn.n * qw.w / qn.n) > 0),
    top as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from hit qualify rank <= {k})"""


_BENCH_Q = "select item_id as query_id, text as query_text from benchmark"


@query("tfidf_topk", f"with {_tfidf_sql('select doc_id, text from documents', _BENCH_Q, 5)} select query_id, doc_id, rank::integer as rank, round(score, 6) as score from top")
def _(t):
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    out = RT.tfidf_topk(t("documents").select("doc_id", "text"), q, 5, stop_words=_STOP)
    return out.select("query_id", "doc_id", "rank", r("score"))


@query(
    "tfidf_scoped",
    f"with {_tfidf_sql('select doc_id, text from documents', _BENCH_Q, 100000).replace('top as', 'all_hits as')}, sc as (select a.* exclude (rank) from all_hits a join documents d using (doc_id) where d.source = 'src0' or d.source = 'src' || (query_id % 4)) select query_id, doc_id, round(score, 6) as score from sc qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 3",
)
def _(t):
    scope = F.when(F.col("source") != "src0", F.col("source")).alias("scope")
    q = t("benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), F.concat(F.lit("src"), (F.col("item_id") % 4).cast("string")).alias("scope")
    )
    out = RT.tfidf_topk(t("documents").select("doc_id", "text", scope), q, 3, scope="scope", stop_words=_STOP)
    return out.select("query_id", "doc_id", r("score"))


@query(
    "tfidf_sources",
    f"with {_tfidf_sql('select doc_id, text from documents', _BENCH_Q, 100000).replace('top as', 'all_hits as')}, sc as (select a.* exclude (rank) from all_hits a join documents d using (doc_id) where d.source in ('src1', 'src3', 'src5')) select query_id, doc_id, round(score, 6) as score from sc qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 4",
)
def _(t):
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    out = RT.tfidf_topk(t("documents").select("doc_id", "text", "source"), q, 4, stop_words=_STOP, source="source", sources=["src1", "src3", "src5"])
    return out.select("query_id", "doc_id", r("score"))


@query(
    "recall_at_k",
    f"with {_tfidf_sql('select item_id as doc_id, text from benchmark', _BENCH_Q, 3)} select round(avg((t.query_id is not null)::int), 6) as recall, count(*) as n from benchmark b left join (select query_id from top where query_id = doc_id) t on t.query_id = b.item_id",
)
def _(t):
    b = t("benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    hits = RT.tfidf_topk(b.select(F.col("item_id").alias("doc_id"), "text"), q, 3, stop_words=_STOP)
    truth = b.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"))
    return X.recall_at_k(hits, truth, "query_id", "doc_id").select(r("recall"), "n")


@query(
    "eligible_types",
    """with f as (select user_id as hadm_id, list(distinct event_type) as h from events where value > 120 group by 1)
    select hadm_id, list_filter([case when list_contains(h, 'view') and list_contains(h, 'error') then 'progress' end, case when list_contains(h, 'purchase') then 'discharge' end], lambda x: x is not null) as note_types from f""",
)
def _(t):
    f = t("events").filter("value > 120").select(F.col("user_id").alias("hadm_id"), F.col("event_type").alias("table_name"))
    return FA.eligible_note_types(f, {"progress": ["view", "error"], "discharge": ["purchase"]})


@query(
    "agreement_rate",
    "select event_type, round(avg(((value > 40) = (user_id % 2 = 0))::int), 6) as agreement, round(sum(value), 4) as tokens, round(sum(value) / count(distinct date_trunc('day', ts)), 4) as tokens_per_day from events group by 1",
)
def _(t):
    same = ((F.col("value") > 40) == (F.col("user_id") % 2 == 0)).cast("double")
    return t("events").groupBy("event_type").agg(
        F.round(F.avg(same), 6).alias("agreement"), F.round(F.sum("value"), 4).alias("tokens"),
        F.round(F.sum("value") / F.countDistinct(F.date_trunc("day", "ts")), 4).alias("tokens_per_day"),
    )


@query(
    "facts_table",
    tables(["admissions", "prescriptions", "microbiologyevents", "services", "sofa"]) + """,
    n as (select hadm_id, drug, row_number() over (partition by hadm_id order by count(*) desc, drug) as rn from prescriptions group by 1, 2 qualify rn <= 20),
    md as (select hadm_id, drug, route from prescriptions group by 1, 2, 3 qualify row_number() over (partition by hadm_id, drug order by count(*) desc, route) = 1),
    mi as (select *, row_number() over (partition by hadm_id order by chartdate, micro_specimen_id, org_name) as rn from microbiologyevents where org_name is not null qualify rn <= 10),
    sv as (select hadm_id, transfertime as ts, min(curr_service) as s from services group by 1, 2),
    f as (select hadm_id, 1 as family, '1' as k, 'Admitted as ' || lower(admission_type) || ' via clinic referral.' as text from admissions
      union all select hadm_id, 1, '2', 'Length of hospital stay: ' || date_diff('day', admittime, dischtime) || ' day(s).' from admissions
      union all select hadm_id, 1, '3', case when hospital_expire_flag = 1 then 'Patient died during this hospitalization.' else 'Discharged alive to: home.' end from admissions
      union all select hadm_id, 4, printf('%03d', rn), 'Medication administered (' || lower(route) || '): ' || drug || '.' from n join md using (hadm_id, drug)
      union all select hadm_id, 5, printf('%03d', rn), org_name || ' isolated from ' || lower(spec_type_desc) || ' on ' || chartdate::varchar || '.' || case when micro_specimen_id % 3 = 0 and micro_specimen_id % 7 <> 0 then ' Sensitivity to VANCOMYCIN: S.' else '' end from mi
      union all select hadm_id, 7, '1', 'Clinical service assignment over the stay: ' || string_agg(s, ' -> ' order by ts) || '.' from sv group by hadm_id
      union all select hadm_id, 10, '0', 'Peak sofa score: ' || max(sofa_24hours) || '.' from sofa join icustays using (stay_id) group by hadm_id)
    select hadm_id, family, text, 'F' || printf('%03d', row_number() over (partition by hadm_id order by family, k)) as fact_id from f""",
)
def _(t):
    c = catalog(t)
    adm = c("admissions").withColumns({"edregtime": F.lit(None).cast("timestamp_ntz"), "admission_location": F.lit("CLINIC REFERRAL")})
    services = c("services").groupBy("hadm_id", "transfertime").agg(F.min("curr_service").alias("curr_service"))
    sofa = c("sofa").join(c("icustays").select("stay_id", "hadm_id"), "stay_id").select("hadm_id", F.col("sofa_24hours").alias("value"))
    spec = F.col("micro_specimen_id")
    cultures = c("microbiologyevents").withColumns(
        {"ab_name": F.when(spec % 3 == 0, "VANCOMYCIN"), "interpretation": F.when(spec % 7 != 0, "S")}
    )
    parts = [
        *FA.admission_facts(adm), FA.medication_facts(c("prescriptions")), FA.culture_facts(cultures),
        FA.path_facts(services, 7, "transfertime", "curr_service", "services", "Clinical service assignment over the stay: ", repeats=True),
        *FA.score_facts({"sofa": sofa}),
    ]
    return FA.number_facts(parts).select("hadm_id", "family", "text", "fact_id")


@query(
    "facts_of_other_families",
    """with one as (select l_orderkey as hadm_id, l_linenumber as seq_num, min(l_partkey) as part, min(l_shipdate)::date as chartdate from lineitem group by 1, 2),
    t as (select hadm_id, seq_num, chartdate, p_name as title from one join part on p_partkey = part),
    lab as (select user_id as hadm_id, event_type as label, date_trunc('second', ts) as ts, event_id, case when event_id % 11 = 0 then '___' when event_id % 13 = 0 then null else (event_id % 500)::varchar end as v,
        case when event_id % 2 = 0 then 'mg/dL' end as unit, case when event_id % 3 = 0 then 10 end as lo from events where value > 40
        qualify row_number() over (partition by user_id, event_type order by date_trunc('second', ts) desc, event_id desc) = 1),
    lr as (select *, row_number() over (partition by hadm_id order by ts desc, event_id desc) as rn from lab qualify rn <= 15),
    mv as (select user_id as hadm_id, ts, event_type as s, lag(event_type) over (partition by user_id order by ts) as p from events where value > 60),
    ord as (select user_id as hadm_id, event_id, date_trunc('second', ts) as ts, case when event_id % 2 = 0 then 'CT Scan' end as sub, row_number() over (partition by user_id order by date_trunc('second', ts), event_id) as rn from events where event_type = 'purchase' qualify rn <= 10),
    f as (select hadm_id, 2 as family, printf('%05d', seq_num) as k, 'Diagnosis (' || case when seq_num = 1 then 'principal diagnosis' else 'diagnosis #' || seq_num end || '): ' || title || '.' as text from t
      union all select hadm_id, 3, printf('%05d', seq_num), 'Procedure performed on ' || chartdate::varchar || ': ' || title || '.' from t where seq_num % 2 = 1
      union all select hadm_id, 6, printf('%03d', rn), replace('Abnormal lab, most recent: ' || label || ' = ' || v || ' ' || coalesce(unit, '') || case when lo is null then '' else ' (reference 10-90)' end || ', on ' || ts::varchar || '.', '  ', ' ') from lr where v is not null and not contains(v, '_')
      union all select hadm_id, 8, '1', 'Care unit path: ' || string_agg(s, ' -> ' order by ts) || '.' from mv where p is null or p <> s group by hadm_id
      union all select hadm_id, 9, printf('%03d', rn), 'Radiology order placed on ' || ts::varchar || ': ' || coalesce(sub, 'imaging study') || '.' from ord)
    select hadm_id, family, text, 'F' || printf('%03d', row_number() over (partition by hadm_id order by family, k)) as fact_id from f""",
)
def _(t):
    one = t("lineitem").groupBy(F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber").alias("seq_num")).agg(
        F.min("l_partkey").alias("icd_code"), F.min("l_shipdate").cast("date").alias("chartdate")
    ).withColumn("icd_version", F.lit(10))
    titles = t("part").select(F.col("p_partkey").alias("icd_code"), F.lit(10).alias("icd_version"), F.col("p_name").alias("long_title"))
    e = t("events").withColumnRenamed("user_id", "hadm_id").withColumn("at", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    n = F.col("event_id")
    labs = e.filter("value > 40").select(
        "hadm_id", F.col("event_type").alias("itemid"), n.alias("labevent_id"), F.col("at").alias("charttime"), F.lit("abnormal").alias("flag"),
        F.when(n % 11 == 0, "___").when(n % 13 == 0, None).otherwise((n % 500).cast("string")).alias("value"),
        F.when(n % 2 == 0, "mg/dL").alias("valueuom"), F.when(n % 3 == 0, 10).alias("ref_range_lower"), F.lit(90).alias("ref_range_upper"),
    )
    names = e.select(F.col("event_type").alias("itemid"), F.col("event_type").alias("label")).distinct()
    orders = e.filter("event_type = 'purchase'").select(
        "hadm_id", n.alias("poe_id"), F.col("at").alias("ordertime"), F.lit("Radiology").alias("order_type"), F.when(n % 2 == 0, "CT Scan").alias("order_subtype")
    )
    parts = [
        FA.diagnosis_facts(one, titles), FA.procedure_facts(one.filter("seq_num % 2 = 1"), titles), FA.lab_facts(labs, names),
        FA.path_facts(e.filter("value > 60"), 8, "ts", "event_type", "transfers", "Care unit path: "), FA.order_facts(orders),
    ]
    return FA.number_facts(parts).select("hadm_id", "family", "text", "fact_id")


@query(
    "nested_json_export",
    """select o_orderkey, 'Encounter' as kind, o_orderkey::varchar as id, case when o_orderstatus = 'F' then 'finished' else 'in-progress' end as status,
      case when o_orderpriority = '1-URGENT' then 'EMER' else 'IMP' end as class, 'Patient/' || o_custkey as subject, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') as start from orders""",
)
def _(t):
    src = t("orders").select(
        "o_orderkey", F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("admittime"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("dischtime"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "EMERGENCY").otherwise("OTHER").alias("admission_type"),
    )
    j = RS.to_resources(src, "Encounter")
    get = lambda p: F.get_json_object("resource", p)
    return j.select(
        "o_orderkey", get("$.resourceType").alias("kind"), get("$.id").alias("id"), get("$.status").alias("status"), get("$.class").alias("class"),
        get("$.subject.reference").alias("subject"), get("$.period.start").alias("start"),
    )


@query(
    "reference_rewrite",
    """select c_custkey, case c_custkey % 4 when 0 then 'Patient?identifier=urn:record:subject_id|' || c_custkey when 1 then 'ICUStay/' || c_custkey when 2 then 'Encounter?identifier=urn:record:hadm_id|' || c_custkey else 'Device' end as reference from customer""",
)
def _(t):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("Patient/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("ICUStay/"), k.cast("string")))
    raw = raw.when(k % 4 == 2, F.concat(F.lit("Encounter/"), k.cast("string"))).otherwise("Device")
    return t("customer").select("c_custkey", RS.rewrite_reference(raw).alias("reference"))


# --- reports ---------------------------------------------------------------------------------


@query(
    "daily_summary",
    f"""with {CUT_SQL}, d as (select user_id, hour // 24 as day_index, list(score order by hour) as score_trajectory, list(tier order by hour) as tier_trajectory, arg_max(tier, hour) as outstanding_tier from tiered group by 1, 2),
    s as (select e.user_id, min(ts) as et from events e where event_type = 'purchase' and value > 100 group by 1)
    select d.*, coalesce((epoch_us(et) - epoch_us(t0)) // 86400000000 = day_index, false) as big_today from d join first_seen using (user_id) left join s using (user_id)""",
)
def _(t):
    e = t("events")
    anchors = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    s = e.filter("event_type = 'purchase' and value > 100").groupBy("user_id").agg(F.min("ts").alias("event_time"))
    return G.daily_summary(tiered_grid(t), "user_id", "hour", "score", "tier", {"big_today": s}, anchors, "t0")


@query(
    "shift_last_bucket",
    f"""with {CUT_SQL}, g as (select user_id, t0 + to_hours(hour) as abs_t, score, tier from tiered join first_seen using (user_id)), m as (select user_id, max(time_bucket(interval 4 hour, abs_t)) as b from g group by 1),
    w as (select user_id, min(abs_t) as window_start, max(abs_t) as window_end, arg_min(score, abs_t) as score_start, arg_max(score, abs_t) as score_end, arg_max(tier, abs_t) as tier_end from g join m using (user_id) where time_bucket(interval 4 hour, abs_t) = b group by 1),
    a as (select user_id, count(*) as n from (select user_id, time_bucket(interval 4 hour, ts) from events where value > 150 group by 1, 2) group by 1)
    select w.*, coalesce(n, 0) as active_alerts from w left join a using (user_id)""",
)
def _(t):
    from wardspan.plans.alerts import dedup_alerts

    e = t("events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    g = tiered_grid(t).join(first, "user_id").withColumn("abs_t", F.col("t0") + F.expr("make_dt_interval(0, hour)"))
    raised = e.filter("value > 150").select("user_id", F.lit("a").alias("alert_type"), "ts", F.lit("high").alias("severity"))
    active = dedup_alerts(raised, "user_id", "alert_type", "ts", "severity")
    return G.shift_handover(g, "user_id", "abs_t", "score", "tier", {}, active)


@query(
    "weekly_digest",
    """with f as (select user_id, min(ts) t0 from events group by 1), d as (select e.user_id, (epoch_us(ts) - epoch_us(t0)) // 86400000000 + 1 as day_index, event_type, value from events e join f using (user_id)),
    p as (select user_id, day_index, event_type, round(avg(value), 6) as m, count(*) as n from d where day_index <= 7 group by 1, 2, 3)
    select user_id, day_index, max(m) filter (event_type = 'view') as view_mean, max(m) filter (event_type = 'error') as error_mean, count(*)::integer as n_channels, sum(n)::bigint as n_samples from p group by 1, 2""",
)
def _(t):
    d = G.weekly_digest(t("events"), "user_id", "ts", "event_type", "value", 7)
    m = F.col("means")
    return d.select(
        "user_id", "day_index", F.round(F.try_element_at(m, F.lit("view")), 6).alias("view_mean"),
        F.round(F.try_element_at(m, F.lit("error")), 6).alias("error_mean"), F.size(m).alias("n_channels"), "n_samples",
    )


@query("ward_list", f"with {CUT_SQL} select user_id, max(hour) as hour, arg_max(score, hour) as score, arg_max(tier, hour) as tier from tiered group by 1")
def _(t):
    return G.ward_list(tiered_grid(t), "user_id", "hour", ["score", "tier"])


@query(
    "assessment_hour",
    f"with {CUT_SQL} select user_id, coalesce(max(hour) filter (tier = 'high'), max(hour)) as hour, case when max(hour) filter (tier = 'high') is not null then 'latest escalating hour' else 'latest scored hour (no hour escalates)' end as basis from tiered group by 1",
)
def _(t):
    return G.assessment_hour(tiered_grid(t), "user_id", "hour", F.col("tier") == "high")


@query(
    "reference_key",
    "select event_id, case when event_id % 3 = 0 then user_id end as stay_id from events",
)
def _(t):
    k = F.col("event_id") % 3
    ref = F.when(k == 0, F.concat(F.lit("ICUStay/"), F.col("user_id").cast("string"))).when(k == 1, "ICUStay/x").otherwise("Subject/S05")
    return t("events").select("event_id", G.stay_of_ref(ref).alias("stay_id"))


@query(
    "set_flag_names",
    """select l_orderkey, list_filter([case when bool_or(l_returnflag = 'R') then 'returned' end, case when max(l_quantity) > 45 then 'bulk' end, case when max(l_tax) > 0.07 then 'taxed' end], lambda x: x is not null) as names from lineitem group by 1""",
)
def _(t):
    f = t("lineitem").groupBy("l_orderkey").agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("a"), (F.max("l_quantity") > 45).cast("int").alias("b"), (F.max("l_tax") > 0.07).cast("int").alias("c")
    )
    return f.select("l_orderkey", G.set_names({"returned": F.col("a"), "bulk": F.col("b"), "taxed": F.col("c")}).alias("names"))


@query(
    "latest_abnormal",
    "select user_id, event_id from events where value > 90 qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10",
)
def _(t):
    return G.latest_abnormal(t("events").filter("value > 90").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id")
