"""Hour slots per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions.compat import date_diff_boundaries


def hourly_slots(df: DataFrame, key: str, first: str, last: str, lo: int = -24) -> DataFrame:
    """Slots ``lo..n`` per key; slot ``h`` ends ``h`` hours after the first full hour."""
    trunc = F.date_trunc("hour", F.col(first)).cast("timestamp_ntz")
    base = F.when(trunc == F.col(first), trunc).otherwise(trunc + F.expr("interval 1 hour"))
    n = date_diff_boundaries("hour", first, last)
    out = df.filter(F.col(first).isNotNull()).withColumn("__base", base)
    out = out.withColumn("hr", F.explode(F.sequence(F.lit(lo).cast("long"), n)))
    return out.withColumn("endtime", F.col("__base") + F.expr("make_dt_interval(0, hr)")).drop("__base")
