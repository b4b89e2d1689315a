"""Sources and sinks: CSV landing zone, exports, checksums, catalogue build."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardspan.operators.sampling import hash_split
from wardspan.plans.concepts import Catalog, build_concepts
from wardspan.queries.concepts import catalog
from wardspan.queries.evaluation import SCORE_ROWS, _hash, score_rows
from wardspan.queries.registry import Tables, query
from wardspan.session import shared_dir
from wardspan.sources import tables as ST
from wardspan.streaming import observations as O


def folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


_ORDERS = ST.declared("o_orderkey:long o_custkey:long o_totalprice:double o_orderdate:ts o_missing:int o_orderpriority:string")


@query(
    "declared_csv",
    """select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total, min(o_orderdate) as first_at, count(distinct o_custkey) as customers, 0::bigint as n_missing from orders group by 1""",
)
def _(t):
    path = folder(t, "orders_csv")
    o = t("orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    # column order differs from the declared one and one column is undeclared
    o.select("o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice", "o_custkey", "o_orderkey").write.option("header", True).option(
        "compression", "gzip"
    ).csv(path)
    d = ST.read_declared_csv(t.spark, path, _ORDERS)
    return d.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first_at"),
        F.countDistinct("o_custkey").alias("customers"), F.count("o_missing").alias("n_missing"),
    )


@query(
    "checksum_manifest",
    "select 'ok' as status, count(distinct o_orderstatus) - 1 as parts from orders union all select 'changed', 1 union all select 'missing', 1",
)
def _(t):
    path = folder(t, "landing")
    o = t("orders").select("o_orderkey", "o_orderstatus")
    o.repartition(1).write.partitionBy("o_orderstatus").option("compression", "gzip").csv(path)
    f = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv.gz").option("recursiveFileLookup", True).load(path)
    man = f.select(ST.below(path).alias("file"), F.sha2("content", 256).alias("sha256"))
    # one file of the landing folder is rewritten after the manifest was made, and an unlisted one is added
    man = t.spark.createDataFrame(man.collect(), man.schema)
    o.filter("o_orderstatus = 'F'").limit(1).drop("o_orderstatus").coalesce(1).write.mode("overwrite").option("compression", "gzip").csv(f"{path}/o_orderstatus=X")
    wrong = F.when(F.col("file").startswith("o_orderstatus=F"), F.sha2(F.lit("an older version"), 256)).otherwise(F.col("sha256"))
    man = man.withColumn("sha256", wrong)
    gone = t.spark.range(1).select(F.lit("gone.csv.gz").alias("file"), F.lit("0").alias("sha256"))
    out = ST.verify_checksums(t.spark, path, man.unionByName(gone))
    return out.groupBy("status").agg(F.countDistinct("sha256").alias("parts"))


@query(
    "landing_zone",
    """select 'orders' as table_name, count(*) as n, count(distinct o_custkey) as keys, sum(o_orderkey)::bigint as total from orders
    union all select 'customer', count(*), count(distinct c_custkey), sum(c_nationkey)::bigint from customer""",
)
def _(t):
    """Files of one table name in two folders are one table; the whole is replaced by parquet, twice."""
    path = folder(t, "zone")
    o, c = t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_nationkey")
    parts = {"hosp/orders": o.filter("o_orderkey % 3 = 0"), "icu/orders": o.filter("o_orderkey % 3 <> 0"), "hosp/customer": c}
    for name, df in parts.items():
        df.write.option("header", True).option("compression", "gzip").csv(f"{path}/{name}.csv.gz")
    schemas = {"orders": ST.declared("o_orderkey:long o_custkey:long"), "customer": ST.declared("c_custkey:long c_nationkey:long")}
    for _ in range(2):
        ST.convert_to_parquet(ST.load_catalog(t.spark, path, schemas), f"{path}-parquet", {"orders": ["o_custkey"]})
    a, b = (t.spark.read.parquet(f"{path}-parquet/{n}") for n in schemas)
    count = lambda df, n, k, v: df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n"), F.countDistinct(k).alias("keys"), F.sum(v).alias("total"))
    return count(a, "orders", "o_custkey", "o_orderkey").unionByName(count(b, "customer", "c_custkey", "c_nationkey"))


@query(
    "training_export",
    f"with {SCORE_ROWS} select case when {_hash(repr('11'), 'user_id')} < 0.7 then 'train' else 'test' end as split, count(*) as n, sum(y)::bigint as positives from sc group by 1",
)
def _(t):
    d = hash_split(score_rows(t).select("user_id", "y", "score"), "user_id", 0.7, 11)
    path = folder(t, "export")
    ST.write_training_export(d, path, "split", "user_id", ["user_id", "y", "score"])
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query(
    "topic_sink",
    "select 'raw.' || case when value > 60 then 'icu_monitor' else 'wearable' end as topic, count(*) as n from events group by 1",
)
def _(t):
    obs = t("events").select(
        F.concat(F.lit("Subject/"), F.col("user_id").cast("string")).alias("patient_ref"), F.col("event_type").alias("code"), "value",
        F.when(F.col("value") > 60, "icu_monitor").otherwise("wearable").alias("source"), F.col("ts").alias("effective_time"),
    )
    path = folder(t, "jsonl")
    O.write_jsonl(obs, path)
    back = t.spark.read.schema("patient_ref string, code string, value double, source string").json(path)
    return O.publish_counts(back)


@query(
    "channel_registry",
    "select case event_type when 'view' then 'hr' when 'click' then 'spo2' when 'error' then 'ibi' end as channel, case event_type when 'view' then '8867-4' when 'click' then '59408-5' when 'error' then 'ibi' end as code, case event_type when 'view' then '/min' when 'click' then '%' when 'error' then 's' end as unit, count(*) as n from events group by 1, 2, 3",
)
def _(t):
    k = F.col("event_type")
    e = t("events").select(F.when(k == "view", "hr").when(k == "click", "spo2").when(k == "error", "ibi").alias("channel"))
    out = O.enrich_channel(e)
    back = O.channel_of_code(out.drop("channel"), "code")
    return back.groupBy("channel", "code", "unit").agg(F.count(F.lit(1)).alias("n"))


@query(
    "grid_observations",
    """select event_type as channel, 'imputed' as flag, count(*) as n from events where event_type in ('view', 'error') and user_id % 2 = 0 group by 1
    union all select event_type, '', count(*) from events where event_type in ('view', 'error') and user_id % 2 = 1 group by 1""",
)
def _(t):
    e = t("events")
    k, even = F.col("event_type"), F.col("user_id") % 2 == 0
    wide = e.select(
        "user_id", "ts", F.when(k == "view", F.col("value")).alias("view"), F.when(k == "error", F.col("value")).alias("error"),
        even.alias("view_was_imputed"), even.alias("error_was_imputed"),
    )
    out = O.wide_to_observations(wide, ["view", "error"], "user_id", "ts")
    return out.groupBy("channel", F.array_join("quality_flags", ",").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("catalog_build_status")
def _(t):
    c = catalog(t)
    own = Catalog(t.spark, {n: c(n) for n in ("icustays", "chartevents", "labevents", "inputevents", "patients", "admissions")})
    return build_concepts(own, folder(t, "build"), ["icustay_times", "age", "enzyme", "dopamine", "charlson"]).drop("error")


@query(
    "swap_control",
    """with e as (select vec_id, label, embedding::double[] as v from embeddings), tg as (select *, label < 7 as member from e where label >= 4), pools as (select 1 as p, * from e where label < 2 union all select 2, * from e where label in (2, 3)),
    d as (select p, t.vec_id, t.member, min(list_distance(t.v, s.v)) as dist from tg t, pools s group by 1, 2, 3), m as (select p, median(dist) as md from d group by 1),
    f as (select d.p, 2.0 * count(*) filter (member and dist <= md) / (2 * count(*) filter (member and dist <= md) + count(*) filter (not member and dist <= md) + count(*) filter (member and dist > md)) as f1 from d join m on d.p = m.p group by 1)
    select round(a.f1, 6)::double as f1_first, round(b.f1, 6)::double as f1_second, round(a.f1 - b.f1, 6)::double as swing from f a, f b where a.p = 1 and b.p = 2""",
)
def _(t):
    from wardspan.evaluation.synthetic import swap_control

    e = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    targets = e.filter("label >= 4").withColumn("member", F.col("label") < 7)
    out = swap_control(targets, "member", e.filter("label < 2"), e.filter("label in (2, 3)"), "vec_id", "v")
    return out.select(*[F.round(c, 6).alias(c) for c in ("f1_first", "f1_second", "swing")])


@query(
    "dimension_distance",
    """with w as (with g as (select l_discount as v, count(*) filter (l_suppkey % 2 = 0) as a, count(*) filter (l_suppkey % 2 = 1) as b from lineitem group by 1),
      c as (select v, sum(a) over (order by v)::double / sum(a) over () as fa, sum(b) over (order by v)::double / sum(b) over () as fb, lead(v) over (order by v) as nx from g) select sum(abs(fa - fb) * (nx - v)) as d from c where nx is not null),
    p as (select l_suppkey % 2 as h, avg((l_returnflag = 'R')::int) as r from lineitem group by 1)
    select round((abs(x.r - y.r) + w.d) * 100 / 2, 6) as score from p x, p y, w where x.h = 0 and y.h = 1""",
)
def _(t):
    from wardspan.evaluation.synthetic import dimension_distance

    li = t("lineitem").select("l_suppkey", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("r"))
    out = dimension_distance(li.filter(F.col("l_suppkey") % 2 == 0), li.filter(F.col("l_suppkey") % 2 == 1), ["r"], ["l_discount"])
    return out.select(F.round("score", 6).alias("score"))
