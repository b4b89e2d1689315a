"""Date, rounding and NULL helpers whose semantics differ between engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(c: Column | str) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read in the (UTC) session zone."""
    return F.unix_micros(col(c).cast("timestamp"))


def epoch_s(c: Column | str) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.floor(epoch_us(c) / F.lit(1_000_000)).cast("long")


def from_epoch_us(us: Column) -> Column:
    """Zone-less timestamp from microseconds since the epoch."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def unit_index(unit: str, c: Column | str) -> Column:
    """Number of the calendar unit a timestamp falls in; two are equal iff in the same unit."""
    if unit == "year":
        return F.year(col(c)).cast("long")
    if unit == "month":
        return (F.year(col(c)) * 12 + F.month(col(c))).cast("long")
    width = _UNIT_SECONDS[unit]
    return F.floor(epoch_us(c) / F.lit(width * 1_000_000)).cast("long")


def date_diff_boundaries(unit: str, a: Column | str, b: Column | str) -> Column:
    """Unit boundaries crossed going from ``a`` to ``b`` (00:59 to 01:01 is one hour)."""
    return unit_index(unit, b) - unit_index(unit, a)


def greatest_strict(*cols: Column | str) -> Column:
    """``greatest`` that is NULL as soon as one argument is."""
    cs = [col(c) for c in cols]
    return F.when(reduce(lambda x, y: x & y, [c.isNotNull() for c in cs]), F.greatest(*cs))


def least_strict(*cols: Column | str) -> Column:
    cs = [col(c) for c in cols]
    return F.when(reduce(lambda x, y: x & y, [c.isNotNull() for c in cs]), F.least(*cs))


def round_dec(c: Column | str, n: int) -> Column:
    """Half-up decimal rounding; NULL where the value does not fit the decimal."""
    return F.round(col(c).try_cast("decimal(38,9)"), n)


def between_open(c: Column, lo=None, hi=None) -> Column:
    """Value where ``lo < c < hi``, else NULL; either bound may be missing."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c > lo)
    if hi is not None:
        cond = cond & (c < hi)
    return F.when(cond, c)


def all_present(*cols: Column | str) -> Column:
    return reduce(lambda x, y: x & y, [col(c).isNotNull() for c in cols])


def sum_all(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, cols)


def hash_unit(*parts: Column | str) -> Column:
    """Deterministic pseudo-random number in [0, 1) from an md5 of the joined parts."""
    h = F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
