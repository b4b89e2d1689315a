"""Integrity checks and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.operators.scan import prefix_scan


def row_count_check(
    spark: SparkSession, tables: Mapping[str, DataFrame], expected: Mapping[str, int]
) -> DataFrame:
    """One row per table: expected and observed count, PASSED or FAILED."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("observed")).select(F.lit(n).alias("table_name"), "observed")
        for n, df in tables.items()
    ]
    want = spark.createDataFrame(
        [(n, int(v)) for n, v in expected.items()], "table_name string, expected long"
    )
    seen = reduce(DataFrame.unionByName, counts)
    out = want.join(seen, "table_name", "left")
    ok = F.col("expected") == F.coalesce("observed", F.lit(0))
    return out.withColumn("status", F.when(ok, "PASSED").otherwise("FAILED"))


def empty_tables(tables: Mapping[str, DataFrame], may_be_empty: Sequence[str] = ()) -> DataFrame:
    """Names of tables without rows, found from at most one row of each."""
    flags = [
        df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        for t, df in tables.items()
        if t not in may_be_empty
    ]
    return reduce(DataFrame.unionByName, flags).filter(F.col("n") == 0).select("table_name")


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    p = parent.select(*[F.col(pc).alias(cc) for cc, pc in pairs.items()]).distinct()
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pairs])
    return child.filter(known).join(p, list(pairs), "left_anti")


def outside_cohort(df: DataFrame, cohort: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in the cohort; a NULL key is outside as well."""
    return df.join(cohort.select(on).distinct(), on, "left_anti")


def completeness(df: DataFrame, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Percentage of non-NULL values, one row per column, in one pass."""
    agg = df.agg(*[(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(c) for c in cols])
    return agg.unpivot([], list(cols), "column_name", f"{prefix}pct")


# Bounds of what a living patient can show, (low, high)
PLAUSIBLE_RANGES: dict[str, tuple[float, float]] = {
    "hr": (20.0, 250.0),
    "rr": (4.0, 60.0),
    "spo2": (50.0, 100.0),
    "sbp": (40.0, 250.0),
    "map": (20.0, 200.0),
    "temp_c": (30.0, 43.0),
    "gcs_total": (3.0, 15.0),
    "fio2": (21.0, 100.0),
    "glucose": (20.0, 800.0),
    "admission_age": (18.0, 95.0),
}


def clip_ranges(
    df: DataFrame, ranges: Mapping[str, tuple[float, float]]
) -> tuple[DataFrame, DataFrame]:
    """Values clipped into their range, and the number of clipped values per column."""
    use = {c: r for c, r in ranges.items() if c in df.columns}
    outside = {c: (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in use.items()}
    report = df.agg(*[F.count(F.when(cond, 1)).alias(c) for c, cond in outside.items()])
    report = report.unpivot([], list(use), "column_name", "n_clipped")
    clipped = df.withColumns(
        {
            c: F.when(F.col(c).isNull(), None)
            .otherwise(F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
            for c, (lo, hi) in use.items()
        }
    )
    return clipped, report


def missing_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    agg = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return agg.unpivot([], list(cols), "column_name", "missing_rate")


def drop_missing(df: DataFrame, cols: Sequence[str], max_rate: float = 0.5) -> DataFrame:
    """Without the columns whose missing rate exceeds the limit (one row is read back)."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if (rates[c] or 0.0) > max_rate])


def minority_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per two-valued column, how many rows carry the rarer value."""
    agg = df.agg(
        *[
            F.least(F.count(F.when(F.col(c) == 1, 1)), F.count(F.when(F.col(c) == 0, 1))).alias(c)
            for c in cols
        ]
    )
    return agg.unpivot([], list(cols), "column_name", "minority")


def drop_rare_flags(df: DataFrame, cols: Sequence[str], min_count: int = 20) -> DataFrame:
    rare = minority_counts(df, cols).filter(F.col("minority") < min_count)
    return df.drop(*[r["column_name"] for r in rare.collect()])


def violation_rate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Share of rows breaking each rule and any rule; an undecidable rule is not broken."""
    broken = {n: F.coalesce(r, F.lit(False)) for n, r in rules.items()}
    any_rule = reduce(lambda a, b: a | b, broken.values())
    return df.agg(
        *[F.avg(b.cast("double")).alias(n) for n, b in broken.items()],
        F.avg(any_rule.cast("double")).alias("any_violation"),
    )


def classify_columns(df: DataFrame) -> DataFrame:
    """continuous, binary or categorical, from the schema and exact distinct counts."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    bools = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
    cols = df.columns
    n = df.agg(*[F.countDistinct(c).alias(c) for c in cols])
    long = n.unpivot([], cols, "column_name", "n_distinct")
    kind = F.when(
        F.col("column_name").isin(*bools)
        | (F.col("column_name").isin(*numeric) & (F.col("n_distinct") <= 2)),
        "binary",
    )
    kind = kind.when(F.col("column_name").isin(*numeric), "continuous").otherwise("categorical")
    return long.withColumn("kind", kind)


GENESIS = "0" * 64


def chain_hash(fields: Sequence[str], prev: Column | None) -> Column:
    """sha256 over the fields and the previous hash joined by a bar; a NULL field is empty."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat_ws("|", *parts, *([] if prev is None else [prev])), 256)


def verify_hash_chain(
    df: DataFrame,
    keys: list[str],
    seq: str,
    fields: Sequence[str],
    prev: str = "prev_hash",
    own: str = "row_hash",
    slice_rows: int = 100_000,
    linked: bool = True,
) -> DataFrame:
    """Per chain: row count, whether it is intact, and the first sequence number that is not.

    Each row is checked against its own fields and against the stored hash of the row before,
    so the check of all rows is one scan, whatever the chain length. With ``linked`` the row hash
    covers the previous hash as well; without it only the row's own fields.
    """
    b = F.floor(F.col(seq) / F.lit(slice_rows)).cast("long")
    rows = prefix_scan(df, keys, [seq], b, {"__before": ("prev", own)})
    link = F.coalesce("__before", F.lit(GENESIS))
    expected = chain_hash(fields, link if linked else None)
    # a blanked hash breaks the chain like a wrong one
    bad = ~F.col(prev).eqNullSafe(link) | ~F.col(own).eqNullSafe(expected)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.when(bad, F.col(seq))).alias("first_broken"),
        (F.count(F.when(bad, 1)) == 0).alias("intact"),
    )


def minmax_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.min(c).alias(f"{c}__lo") for c in cols], *[F.max(c).alias(f"{c}__hi") for c in cols]
    )


def minmax_scale(df: DataFrame, cols: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    """Columns scaled to [0, 1] with stored bounds; a constant column becomes 0.5."""
    b = minmax_bounds(df, cols) if bounds is None else bounds
    out = df.withColumn("__one", F.lit(1)).join(F.broadcast(b.withColumn("__one", F.lit(1))), "__one")
    for c in cols:
        lo, hi = F.col(f"{c}__lo"), F.col(f"{c}__hi")
        out = out.withColumn(c, F.when(hi == lo, F.lit(0.5)).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.drop("__one", *[f"{c}__lo" for c in cols], *[f"{c}__hi" for c in cols])


def minmax_inverse(df: DataFrame, cols: Sequence[str], bounds: DataFrame) -> DataFrame:
    out = df.withColumn("__one", F.lit(1)).join(
        F.broadcast(bounds.withColumn("__one", F.lit(1))), "__one"
    )
    for c in cols:
        lo, hi = F.col(f"{c}__lo"), F.col(f"{c}__hi")
        out = out.withColumn(c, lo + F.col(c) * (hi - lo))
    return out.drop("__one", *[f"{c}__lo" for c in cols], *[f"{c}__hi" for c in cols])


def one_hot(df: DataFrame, col_name: str, levels: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {f"{col_name}={v}": (F.col(col_name).eqNullSafe(F.lit(v))).cast("int") for v in levels}
    ).drop(col_name)


def one_hot_inverse(df: DataFrame, col_name: str, levels: Sequence[str]) -> DataFrame:
    """The level with the largest indicator, the first in order on ties."""
    members = [f"{col_name}={v}" for v in levels]
    best = F.greatest(*[F.col(f"`{m}`") for m in members])
    pick = F.coalesce(*[F.when(F.col(f"`{m}`") == best, F.lit(v)) for m, v in zip(members, levels)])
    return df.withColumn(col_name, pick).drop(*members)
