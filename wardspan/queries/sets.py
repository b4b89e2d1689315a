"""Top-k, sampling, set operations and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardspan.operators import quality as Q
from wardspan.operators import sampling as S
from wardspan.operators import sets as U
from wardspan.operators.scan import DAY, row_numbers, time_bucket
from wardspan.queries.analytics import TYPES, r
from wardspan.queries.grid import FILL_SQL, filled_grid
from wardspan.queries.registry import query

# --- top-k, samples -------------------------------------------------------------


@query(
    "topk_per_group",
    """with b as (select user_id, event_type, arg_max({'id': event_id, 'ts': ts}, ts) as s from events where value > 20 group by 1, 2)
    select user_id, event_type, s.id as event_id, s.ts as ts from b
    qualify row_number() over (partition by user_id order by s.ts desc, event_type) <= 3""",
)
def _(t):
    e = t("events").filter("value > 20").select("user_id", "event_type", "event_id", "ts")
    out = S.topk_of_top1(e, ["user_id"], ["event_type"], F.col("ts"), 3, [F.col("ts").desc(), F.col("event_type")])
    return out.select("user_id", "event_type", "event_id", "ts")


@query(
    "topk_by_count",
    """with n as (select c_nationkey, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2)
    select * from n qualify row_number() over (partition by c_nationkey order by n desc, o_orderpriority) <= 2""",
)
def _(t):
    per = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("k"))
    j = per.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = j.groupBy("c_nationkey", "o_orderpriority").agg(F.sum("k").alias("n"))
    return S.topk(n, ["c_nationkey"], [F.col("n").desc(), F.col("o_orderpriority")], 2).drop("rn")


@query(
    "severity_order",
    """select event_id, ts, sev, row_number() over (order by case sev when 'high' then 0 when 'medium' then 1 else 2 end, ts desc, event_id) as position
    from (select *, case when value > 100 then 'high' when value > 40 then 'medium' else 'low' end as sev from events where event_id % 4 < 2)""",
)
def _(t):
    from wardspan.plans.alerts import inbox

    sev = F.when(F.col("value") > 100, "high").when(F.col("value") > 40, "medium").otherwise("low")
    status = F.element_at(F.array(*map(F.lit, ("active", "escalated", "resolved", "acknowledged"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = t("events").select("event_id", "ts", sev.alias("sev"), status.alias("status"))
    return inbox(e, "sev", "ts", "event_id").drop("status")


@query(
    "nulls_first_order",
    """select o_orderkey, k, row_number() over (order by k asc nulls first, o_orderkey) as position
    from (select o_orderkey, case when o_orderkey % 6 <> 0 then o_orderdate end as k from orders)""",
)
def _(t):
    k = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("k")
    d = t("orders").select("o_orderkey", k)
    # rows without a time come first, in slices of their keys
    slice_ = F.coalesce(time_bucket("k", 30 * DAY), F.floor(F.col("o_orderkey") / 1_000_000).cast("long") - (1 << 40))
    return row_numbers(d, [], [F.col("k").asc_nulls_first(), "o_orderkey"], slice_, "position")


@query(
    "stratified_sample",
    """select event_type, event_id from events
    qualify row_number() over (partition by event_type order by md5(concat_ws('|', '7', event_id)), event_id) <= 40""",
)
def _(t):
    e = t("events").select("event_type", "event_id")
    return S.stratified_sample(e, "event_type", ["event_id"], 40, 7)


@query(
    "seeded_subject_sample",
    """with ids as (select o_custkey from (select distinct o_custkey from orders) order by md5(concat_ws('|', '3', o_custkey)), o_custkey limit 200)
    select o_custkey, count(*) as n from orders where o_custkey in (from ids) group by 1""",
)
def _(t):
    s = S.seeded_sample(t("orders").select("o_custkey"), "o_custkey", 200, 3)
    return s.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "budget_sensitivity",
    """with c as (select event_type, cast(greatest(1, round_even(count(*) * 0.05, 0)) as bigint) as k from events group by 1),
    x as (select e.*, row_number() over (partition by e.event_type order by value desc) as rn from events e),
    cut as (select x.event_type, value as cutoff from x join c on x.event_type = c.event_type and rn = k)
    select e.event_type, cutoff, count(*) filter (value >= cutoff) as n_flagged,
       round(count(*) filter (value >= cutoff and user_id % 4 = 0) / count(*) filter (user_id % 4 = 0), 6) as sensitivity
    from events e join cut using (event_type) group by 1, 2""",
)
def _(t):
    e = t("events").select("event_type", "value", (F.col("user_id") % 4 == 0).alias("y"))
    cut = S.budget_cutoff(e, ["event_type"], "value", 0.05)
    j = e.join(cut, "event_type")
    hit = F.col("value") >= F.col("cutoff")
    return j.groupBy("event_type", "cutoff").agg(
        F.count(F.when(hit, 1)).alias("n_flagged"),
        F.round(F.count(F.when(hit & F.col("y"), 1)) / F.count(F.when(F.col("y"), 1)), 6).alias("sensitivity"),
    )


@query(
    "most_escalating",
    "select user_id, count(*) filter (value > 80) as n_escalating from events group by 1 order by 2 desc, 1 limit 12",
)
def _(t):
    from wardspan.reports.summaries import most_escalating

    return most_escalating(t("events"), "user_id", F.col("value") > 80, 12)


# --- set operations --------------------------------------------------------------


@query(
    "timeline_union",
    """select user_id, ts as at_time from events where event_type = 'view' union
    select user_id, date_trunc('hour', ts) from events where event_type = 'click' union
    select user_id, date_trunc('hour', ts) from events where event_type = 'error'""",
)
def _(t):
    e = t("events")
    kind = F.col("event_type")
    at = F.when(kind == "view", F.col("ts")).otherwise(F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    rows = e.filter(kind.isin("view", "click", "error")).select("user_id", at.alias("at_time"))
    return rows.distinct()


@query(
    "union_all_sources",
    """select o_orderkey as id, o_orderdate as at_time, 'order' as src from orders
    union all select l_orderkey, l_shipdate, 'ship' from lineitem""",
)
def _(t):
    a = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at_time"), F.lit("order").alias("src"))
    b = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at_time"), F.lit("ship").alias("src"))
    return a.unionByName(b)


@query(
    "pool_event_families",
    """with p as (select o_custkey as entity, o_orderdate as at_time, 'orders' as family from orders where o_orderdate is not null
      union all select o_custkey, l_shipdate, case when l_returnflag = 'R' then 'returns' else 'shipments' end
      from lineitem join orders on l_orderkey = o_orderkey)
    select family, count(*) as n, count(distinct entity) as entities, min(at_time) as first_at, max(at_time) as last_at from p group by 1""",
)
def _(t):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("entity"), "o_orderdate")
    li = t("lineitem").join(o.select("o_orderkey", "entity"), F.col("l_orderkey") == F.col("o_orderkey"))
    fam = F.when(F.col("l_returnflag") == "R", "returns").otherwise("shipments")
    pooled = U.pool_events(
        [(o, "entity", "o_orderdate", F.lit("orders")), (li, "entity", "l_shipdate", fam)]
    )
    return pooled.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"),
        F.min("at_time").alias("first_at"), F.max("at_time").alias("last_at"),
    )


@query(
    "key_intersection",
    """with a as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT'),
    b as (select distinct o_custkey as k from orders where o_orderstatus = 'P')
    select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from (from a intersect from b)) as n_both""",
)
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_orderstatus")
    return U.key_overlap(o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderstatus = 'P'"), "k")


@query(
    "replicate_masks",
    f"""with {FILL_SQL}, m as (
      select 'full' as replica, view, error, view_was_imputed::int as flag from filled union all
      select 'no_view', null, error, null from filled union all
      select 'only_view', view, null, view_was_imputed::int from filled)
    select replica, count(*) as n, count(view) as n_view, count(error) as n_error, count(flag) as n_flag, round(sum(view), 4) as s_view from m group by 1""",
)
def _(t):
    g = filled_grid(t)
    sensors = {k: [c for c in g.columns if c.split("_")[0] == k] for k in TYPES}
    devices = {"full": list(TYPES), "no_view": [k for k in TYPES if k != "view"], "only_view": ["view"]}
    rep = U.as_devices(g, sensors, devices, "replica")
    return rep.groupBy("replica").agg(
        F.count(F.lit(1)).alias("n"), F.count("view").alias("n_view"), F.count("error").alias("n_error"),
        F.count("view_was_imputed").alias("n_flag"), F.round(F.sum("view"), 4).alias("s_view"),
    )


# --- data quality -------------------------------------------------------------------

_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"]
_EXPECT = {"region": 5, "nation": 25, "customer": 1500, "supplier": 100, "part": 2000, "orders": 15000, "lineitem": 60000, "events": 9999, "documents": 1000, "labels": 400, "conversations": 536}


@query(
    "row_counts",
    " union all ".join(
        f"select '{n}' as table_name, {_EXPECT[n]}::bigint as expected, count(*) as observed, case when count(*) = {_EXPECT[n]} then 'PASSED' else 'FAILED' end as status from {n}"
        for n in _NAMES
    ),
)
def _(t):
    return Q.row_count_check(t.spark, {n: t(n) for n in _NAMES}, _EXPECT)


@query(
    "orphans",
    """select 'lineitem->part' as rel, count(*) as n from lineitem where l_partkey is not null and l_partkey not in (select p_partkey from part where p_size > 10)
    union all select 'orders->customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
    union all select 'labels->documents', count(*) from labels where doc_id not in (select doc_id from documents where n_chars > 500)""",
)
def _(t):
    n = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rel"), "n")
    a = Q.orphans(t("lineitem"), t("part").filter("p_size > 10"), {"l_partkey": "p_partkey"})
    b = Q.orphans(t("orders"), t("customer"), {"o_custkey": "c_custkey"})
    c = Q.orphans(t("labels"), t("documents").filter("n_chars > 500"), ["doc_id"])
    return n("lineitem->part", a).unionByName(n("orders->customer", b)).unionByName(n("labels->documents", c))


@query(
    "cohort_containment",
    """select count(*) as n_outside from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)""",
)
def _(t):
    cohort = t("customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return Q.outside_cohort(t("orders"), cohort, "o_custkey").agg(F.count(F.lit(1)).alias("n_outside"))


@query(
    "empty_tables",
    """select 'no_big_parts' as table_name where (select count(*) from part where p_size > 1000) = 0""",
)
def _(t):
    return Q.empty_tables({"orders": t("orders"), "no_big_parts": t("part").filter("p_size > 1000"), "events": t("events")})


@query(
    "completeness",
    f"with {FILL_SQL} "
    + " union all ".join(
        f"select '{c}' as column_name, (select round(100.0 * avg(({c} is not null)::int), 6) from grid) as before_pct, (select round(100.0 * avg(({c} is not null)::int), 6) from filled) as after_pct"
        for c in TYPES
    ),
)
def _(t):
    from wardspan.queries.grid import user_grid

    a = Q.completeness(user_grid(t), TYPES, "before_")
    b = Q.completeness(filled_grid(t), TYPES, "after_")
    return a.join(b, "column_name").select("column_name", r("before_pct"), r("after_pct"))


@query(
    "clip_report",
    """select 'l_quantity' as column_name, count(*) filter (l_quantity < 5 or l_quantity > 45) as n_clipped, round(sum(least(greatest(l_quantity, 5), 45)), 4) as total from lineitem
    union all select 'l_tax', count(*) filter (l_tax < 0.01 or l_tax > 0.07), round(sum(least(greatest(l_tax, 0.01), 0.07)), 4) from lineitem""",
)
def _(t):
    clipped, report = Q.clip_ranges(t("lineitem"), {"l_quantity": (5.0, 45.0), "l_tax": (0.01, 0.07)})
    s = clipped.agg(F.sum("l_quantity").alias("l_quantity"), F.sum("l_tax").alias("l_tax"))
    s = s.unpivot([], ["l_quantity", "l_tax"], "column_name", "total")
    return report.join(s, "column_name").select("column_name", "n_clipped", r("total", 4))


_DAILY_NULLS = """with d as (select user_id, date_trunc('day', ts) as day, """ + ", ".join(
    f"avg(value) filter (event_type = '{k}') as {k}" for k in TYPES
) + ", max(value) filter (value > 250) as huge from events group by 1, 2)"


def _daily_plus(t):
    from wardspan.queries.analytics import daily

    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    h = t("events").groupBy("user_id", day).agg(F.max(F.when(F.col("value") > 250, F.col("value"))).alias("huge"))
    return daily(t).join(h, ["user_id", "day"])


@query(
    "missing_drop_report",
    _DAILY_NULLS + " " + " union all ".join(
        f"select '{c}' as column_name, round(avg(({c} is null)::int), 6) as missing_rate, avg(({c} is null)::int) > 0.65 as dropped from d" for c in [*TYPES, "huge"]
    ),
)
def _(t):
    d = _daily_plus(t)
    m = Q.missing_rates(d, [*TYPES, "huge"])
    return m.select("column_name", r("missing_rate"), (F.col("missing_rate") > 0.65).alias("dropped"))


@query(
    "rare_flag_report",
    """with f as (select (l_returnflag = 'R')::int as returned, (l_quantity > 49)::int as max_qty, (l_extendedprice > 104000)::int as huge from lineitem)
    select column_name, minority, minority < 20 as dropped from (
      select 'returned' as column_name, least(count(*) filter (returned = 1), count(*) filter (returned = 0)) as minority from f union all
      select 'max_qty', least(count(*) filter (max_qty = 1), count(*) filter (max_qty = 0)) from f union all
      select 'huge', least(count(*) filter (huge = 1), count(*) filter (huge = 0)) from f)""",
)
def _(t):
    f = t("lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_quantity") > 49).cast("int").alias("max_qty"),
        (F.col("l_extendedprice") > 104000).cast("int").alias("huge"),
    )
    m = Q.minority_counts(f, ["returned", "max_qty", "huge"])
    return m.withColumn("dropped", F.col("minority") < 20)


@query(
    "violation_rate",
    """select round(avg((l_quantity > 45)::int), 6) as qty, round(avg((l_discount > 0.09 or l_discount < 0.01)::int), 6) as disc,
      round(avg(coalesce(case when l_tax > 0.02 then l_tax > 0.07 end, false)::int), 6) as tax,
      round(avg((l_quantity > 45 or l_discount > 0.09 or l_discount < 0.01 or coalesce(case when l_tax > 0.02 then l_tax > 0.07 end, false))::int), 6) as any_violation from lineitem""",
)
def _(t):
    d = F.col("l_discount")
    rules = {
        "qty": F.col("l_quantity") > 45,
        "disc": (d > 0.09) | (d < 0.01),
        "tax": F.when(F.col("l_tax") > 0.02, F.col("l_tax") > 0.07),
    }
    out = Q.violation_rate(t("lineitem"), rules)
    return out.select(*[r(c) for c in ("qty", "disc", "tax", "any_violation")])


@query(
    "column_kinds",
    " union all ".join(
        f"select '{c}' as column_name, count(distinct {c}) as n_distinct, {k} as kind from customer_x"
        for c, k in (
            ("c_custkey", "'continuous'"), ("c_acctbal", "'continuous'"), ("c_mktsegment", "'categorical'"), ("rich", "'binary'"), ("even", "'binary'"),
        )
    ).replace("customer_x", "(select *, c_acctbal > 5000 as rich, c_custkey % 2 as even from customer)"),
)
def _(t):
    c = t("customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", (F.col("c_acctbal") > 5000).alias("rich"), (F.col("c_custkey") % 2).alias("even")
    )
    return Q.classify_columns(c)


_CHAIN = """with r as (select user_id, event_id, ts, event_type, cast(event_id as varchar) as id_text, props,
      row_number() over (partition by user_id order by event_id) as seq from events),
   h as (select *, sha256(concat_ws('|', id_text, event_type, props)) as own0 from r),
   l as (select *, coalesce(lag(own0) over (partition by user_id order by seq), repeat('0', 64)) as prev0 from h)"""


@query(
    "hash_chain_verify",
    _CHAIN + """, c as (select user_id, seq, prev0, case when event_id % 3001 = 7 then 'x' else event_type end as event_type, id_text, props, own0 from l),
    v as (select *, coalesce(lag(own0) over (partition by user_id order by seq), repeat('0', 64)) as link from c),
    b as (select *, own0 <> sha256(concat_ws('|', id_text, event_type, props)) or prev0 <> link as bad from v)
    select user_id, count(*) as n_rows, min(case when bad then seq end) as first_broken, not bool_or(bad) as intact from b group by 1""",
)
def _(t):
    # links are checked against stored hashes; the row hash here covers the row's own fields
    from wardspan.operators.scan import prefix_scan, row_numbers

    e = t("events").select("user_id", "event_id", "event_type", "props", F.col("event_id").cast("string").alias("id_text"))
    b = F.floor(F.col("event_id") / 100_000).cast("long")
    e = row_numbers(e, ["user_id"], ["event_id"], b, "seq")
    own = F.sha2(F.concat_ws("|", "id_text", "event_type", "props"), 256)
    e = e.withColumn("row_hash", own)
    e = prefix_scan(e, ["user_id"], ["seq"], F.floor(F.col("seq") / 100_000).cast("long"), {"__p": ("prev", "row_hash")})
    e = e.withColumn("prev_hash", F.coalesce("__p", F.lit(Q.GENESIS))).drop("__p")
    tampered = F.when(F.col("event_id") % 3001 == 7, "x").otherwise(F.col("event_type"))
    e = e.withColumn("event_type", tampered)
    return Q.verify_hash_chain(e, ["user_id"], "seq", ["id_text", "event_type", "props"], linked=False)


_FLAGS = {"returned": "l_returnflag = 'R'", "max_qty": "l_quantity > 49", "huge": "l_extendedprice > 10400000", "never": "l_tax < 0"}


@query(
    "hash_chain_linked",
    """with r as (select user_id, event_id, event_type, event_id::varchar as id_text, row_number() over (partition by user_id order by event_id) - 1 as i from events),
    f as (select *, i // 3 as chain, i % 3 as seq, concat_ws('|', id_text, event_type) as own from r),
    l as (select *, lag(own) over w as own1, lag(own, 2) over w as own2 from f window w as (partition by user_id, chain order by seq)),
    h as (select *, sha256(own1 || '|' || case when seq = 2 then sha256(own2 || '|' || repeat('0', 64)) else repeat('0', 64) end) as before from l),
    c as (select user_id, chain, seq, case when seq = 0 then repeat('0', 64) when event_id % 997 = 5 then 'broken' else before end as prev0, case when event_id % 1009 = 7 then 'x' else event_type end as event_type, id_text,
        sha256(own || '|' || case when seq = 0 then repeat('0', 64) else before end) as own0 from h),
    v as (select *, coalesce(lag(own0) over (partition by user_id, chain order by seq), repeat('0', 64)) as link from c),
    b as (select *, prev0 <> link or own0 <> sha256(concat_ws('|', id_text, event_type, link)) as bad from v)
    select user_id, chain, count(*) as n_rows, min(case when bad then seq end) as first_broken, not bool_or(bad) as intact from b group by 1, 2""",
)
def _(t):
    # chains of three rows, whose hashes cover the hash before; some types and some links are changed afterwards
    e = t("events").select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("id_text"))
    e = row_numbers(e, ["user_id"], ["event_id"], F.floor(F.col("event_id") / 100_000).cast("long"), "__i")
    i = F.col("__i") - 1
    e = e.withColumns({"chain": F.floor(i / 3).cast("long"), "seq": i % 3})
    w = Window.partitionBy("user_id", "chain").orderBy("seq")
    fields = F.concat_ws("|", "id_text", "event_type")
    e = e.withColumns({"__own1": F.lag(fields, 1).over(w), "__own2": F.lag(fields, 2).over(w)})
    first = F.sha2(F.concat_ws("|", "__own2", F.lit(Q.GENESIS)), 256)
    before = F.sha2(F.concat_ws("|", F.col("__own1"), F.when(F.col("seq") == 2, first).otherwise(Q.GENESIS)), 256)
    link = F.when(F.col("seq") == 0, Q.GENESIS).otherwise(before)
    e = e.withColumns({"row_hash": Q.chain_hash(["id_text", "event_type"], link), "prev_hash": link})
    e = e.withColumn("prev_hash", F.when((F.col("seq") > 0) & (F.col("event_id") % 997 == 5), "broken").otherwise(F.col("prev_hash")))
    e = e.withColumn("event_type", F.when(F.col("event_id") % 1009 == 7, "x").otherwise(F.col("event_type")))
    return Q.verify_hash_chain(e, ["user_id", "chain"], "seq", ["id_text", "event_type"])


@query(
    "sparse_columns_dropped",
    _DAILY_NULLS + " select column_name, n_values, total from (" + " union all ".join(
        f"select '{c}' as column_name, count({c}) as n_values, round(sum({c}), 4) as total, avg(({c} is null)::int) as rate from d" for c in [*TYPES, "huge"]
    ) + ") where rate <= 0.65",
)
def _(t):
    left = Q.drop_missing(_daily_plus(t), [*TYPES, "huge"], 0.65).drop("user_id", "day")
    long = left.unpivot([], left.columns, "column_name", "v")
    return long.groupBy("column_name").agg(F.count("v").alias("n_values"), F.round(F.sum("v"), 4).alias("total"))


@query(
    "rare_flags_dropped",
    "with f as (select " + ", ".join(f"({e})::int as {n}" for n, e in _FLAGS.items()) + " from lineitem) select column_name, n_set from (" + " union all ".join(
        f"select '{n}' as column_name, sum({n})::bigint as n_set, least(count(*) filter ({n} = 1), count(*) filter ({n} = 0)) as minority from f" for n in _FLAGS
    ) + ") where minority >= 20",
)
def _(t):
    flags = t("lineitem").select(*[F.expr(f"({e})").cast("int").alias(n) for n, e in _FLAGS.items()])
    left = Q.drop_rare_flags(flags, list(_FLAGS))
    return left.unpivot([], left.columns, "column_name", "v").groupBy("column_name").agg(F.sum("v").alias("n_set"))


@query(
    "minmax_inverse",
    "select l_orderkey, l_linenumber, l_partkey, round(l_quantity, 6) as l_quantity, round(l_discount, 6) as l_discount, 3.0::double as fixed from lineitem",
)
def _(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", F.lit(3.0).alias("fixed"))
    cols = ["l_quantity", "l_discount", "fixed"]
    bounds = Q.minmax_bounds(li, cols)
    back = Q.minmax_inverse(Q.minmax_scale(li, cols, bounds), cols, bounds)
    return back.select("l_orderkey", "l_linenumber", "l_partkey", r("l_quantity"), r("l_discount"), "fixed")


@query(
    "minmax_scale",
    """with b as (select min(l_quantity) a0, max(l_quantity) a1, min(l_discount) d0, max(l_discount) d1 from lineitem)
    select l_orderkey, l_linenumber, l_partkey, round((l_quantity - a0) / (a1 - a0), 6) as l_quantity, round((l_discount - d0) / (d1 - d0), 6) as l_discount, 0.5::double as fixed
    from lineitem, b""",
)
def _(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", F.lit(3.0).alias("fixed"))
    out = Q.minmax_scale(li, ["l_quantity", "l_discount", "fixed"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r("l_quantity"), r("l_discount"), "fixed")


@query(
    "one_hot_roundtrip",
    """select o_orderstatus, count(*) as n, count(*) filter (o_orderstatus = 'F') as n_f, count(*) filter (o_orderstatus = 'O') as n_o from orders group by 1""",
)
def _(t):
    hot = Q.one_hot(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])
    hot = hot.withColumn("f", F.col("`o_orderstatus=F`")).withColumn("o", F.col("`o_orderstatus=O`"))
    back = Q.one_hot_inverse(hot, "o_orderstatus", ["F", "O", "P"])
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("f") == 1, 1)).alias("n_f"), F.count(F.when(F.col("o") == 1, 1)).alias("n_o")
    )
