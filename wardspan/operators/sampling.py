"""Top-k, seeded samples, folds and resampling. All draws are md5-based and repeatable."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspan.functions.compat import col, hash_unit
from wardspan.operators.scan import SLICE, prefix_scan, row_numbers, value_slices, weighted_ranks
from wardspan.session import stored


def draw(seed: int | str, *parts: Column | str) -> Column:
    """md5 text that orders rows in a repeatable random way."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key; Spark cuts each map task's groups to ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def topk_of_top1(
    df: DataFrame,
    keys: Sequence[str],
    sub: Sequence[str],
    order: Column,
    k: int,
    outer_order: Sequence[Column],
) -> DataFrame:
    """Newest row per sub-key, then the ``k`` first of those per key."""
    rest = [c for c in df.columns if c not in (*keys, *sub)]
    best = df.groupBy(*keys, *sub).agg(F.max_by(F.struct(*rest), order).alias("s"))
    return topk(best.select(*keys, *sub, "s.*"), keys, outer_order, k)


def mode_per_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value, smallest on ties, from pre-aggregated counts."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # max count first, then smallest value: min over (-n, value)
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")
    return n.groupBy(*keys).agg(best).select(
        *keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("n")
    )


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` ids, independent of input order: the n smallest draws (a distributed top-n)."""
    ids = df.select(id_col).distinct()
    picked = ids.orderBy(draw(seed, id_col), id_col).limit(n)
    return df.join(picked, id_col, "left_semi")


def stratified_sample(df: DataFrame, by: str, ident: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` rows per stratum."""
    d = df.withColumn("__d", draw(seed, *ident))
    return topk(d, [by], [F.col("__d"), *[F.col(i) for i in ident]], n).drop("__d", "rn")


def budget_cutoff(df: DataFrame, keys: list[str], score: str, fraction: float) -> DataFrame:
    """Score such that the top ``fraction`` of rows (at least one) lies at or above it."""
    d = df.withColumn("__neg", -F.col(score))
    r = weighted_ranks(d, keys, "__neg", {"n": F.lit(1)})
    want = F.greatest(F.lit(1), F.rint(F.col("n_all") * F.lit(fraction)).cast("long"))
    hit = (F.col("n_upto") >= want) & (F.col("n_upto") - F.col("n") < want)
    return r.groupBy(*keys).agg(F.max(F.when(hit, -F.col("__neg"))).alias("cutoff"))


def budget_flag(df: DataFrame, score: str, fraction: float, name: str = "flagged") -> DataFrame:
    """Flag the top fraction by score, ties at the cut-off included."""
    cut = budget_cutoff(df.withColumn("__g", F.lit(1)), ["__g"], score, fraction)
    out = df.withColumn("__g", F.lit(1)).join(F.broadcast(cut), "__g")
    return out.withColumn(name, F.col(score) >= F.col("cutoff")).drop("__g", "cutoff")


def grouped_folds(
    df: DataFrame, y: str, group: str, k: int, repeats: int, seed: int = 0
) -> DataFrame:
    """(group, repeat, fold): no group spans folds, positives are spread over the folds.

    Groups are ordered by draw inside strata of equal positive count and dealt round-robin.
    """
    g = df.groupBy(group).agg(F.sum(F.col(y).cast("long")).alias("__pos"))
    g = g.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    g = g.withColumn("__d", hash_unit(F.lit(seed), F.col("repeat"), F.col(group)))
    bucket = F.floor(F.col("__d") * (1 << 20)).cast("long")
    g = row_numbers(g, ["repeat", "__pos"], ["__d", group], bucket, "__i")
    shift = F.pmod(F.col("__pos"), F.lit(k))
    fold = F.pmod(F.col("__i") - 1 + shift, F.lit(k)).cast("int")
    return g.select(group, "repeat", fold.alias("fold"))


def bootstrap_counts(units: DataFrame, unit: str, strata: list[str], n_boot: int, seed: int) -> DataFrame:
    """How often each unit is drawn in each replicate (draws with replacement, per stratum).

    Every unit is also one slot; a slot draws the unit whose number the hash of
    (seed, replicate, slot) points to. Result: strata, unit, replicate, times.
    """
    u = units.select(*strata, unit).distinct()
    u = u.withColumn("__h", hash_unit(F.lit(seed), F.col(unit)))
    # the number of a unit and the size of its stratum come from one scan; both uses read the stored rows
    slices = F.floor(F.col("__h") * (1 << 20)).cast("long")
    u = prefix_scan(u, strata, ["__h", unit], slices, {"__i": ("sum", F.lit(1).cast("long")), "__n": ("total", F.lit(1).cast("long"))})
    u = stored(u.select(*strata, unit, "__i", "__n"), "units")
    slots = u.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    pick = F.floor(hash_unit(F.lit(f"b{seed}"), F.col("replicate"), F.col("__i")) * F.col("__n"))
    times = (
        slots.withColumn("__i", (pick + 1).cast("long"))
        .groupBy(*strata, "replicate", "__i")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return stored(times.join(u.select(*strata, unit, "__i"), [*strata, "__i"]).drop("__i"), "draws")


#: Slots and units that are counted together: a cell of the routing holds about this many draws of each replicate.
_SLOTS, _UNITS = 1_024, 1_024


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes that hold the largest, compressed."""
    size = next(k for k in (1, 2, 4, 8) if not len(numbers) or numbers.max() < 1 << 8 * k)
    return bytes([size]) + zlib.compress(numbers.astype(f"<u{size}").tobytes(), 1)


def unsqueezed(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}")


def bootstrap_arrays(units: DataFrame, unit: str, strata: list[str], n_boot: int, seed: int, small: bool = False) -> DataFrame:
    """The draws of ``bootstrap_counts`` as one row per unit: strata, unit, times (``n_boot`` little-endian 32-bit counts,
    or ``squeezed`` if ``small``).

    Every slot draws for all replicates at once. What a block of slots draws from a block of units goes out as one row, and
    a block of units is counted in one table of units by replicates, whose size does not depend on the number of units: the
    rows shuffled do not depend on the number of replicates. Units that are never drawn are left out.
    """
    u = units.select(*strata, unit).distinct().withColumn("__h", hash_unit(F.lit(seed), F.col(unit)))
    slices = F.floor(F.col("__h") * (1 << 20)).cast("long")
    one = F.lit(1).cast("long")
    u = prefix_scan(u, strata, ["__h", unit], slices, {"__i": ("sum", one), "__n": ("total", one)})
    stratum = F.to_json(F.struct(F.lit(0).alias("__0"), *[F.col(s) for s in strata]))
    u = stored(u.select(*strata, unit, "__i", "__n", stratum.alias("__s")), "units")
    pick = lambda r: F.floor(hash_unit(F.lit(f"b{seed}"), r, F.col("__i")) * F.col("__n")).cast("long")
    # few rows, but much work each: spread over all cores
    spread = u.repartition(max(1, u.sparkSession.sparkContext.defaultParallelism), "__s", "__i")
    slots = spread.select("__s", F.transform(F.sequence(F.lit(1), F.lit(n_boot)), pick).alias("picks"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLOTS):
                piece = batch.slice(at, _SLOTS)
                draws = piece.column(1).flatten().to_numpy().reshape(piece.num_rows, n_boot)
                names = np.array(piece.column(0).to_pylist(), object)
                for s in dict.fromkeys(names):
                    mine = draws[names == s]
                    # in order, so that a part is told by small steps from one cell to the next
                    every = np.sort(((mine // _UNITS) * (n_boot * _UNITS) + np.arange(n_boot) * _UNITS + mine % _UNITS).ravel())
                    blocks, first = np.unique(every // (n_boot * _UNITS), return_index=True)
                    parts = [squeezed(np.diff(x % (n_boot * _UNITS), prepend=0)) for x in np.split(every, first[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(blocks)), pa.array(blocks, pa.int64()), pa.array(parts, pa.binary())], ["__s", "__u", "cells"])

    def count(key: tuple, cells: pa.Table) -> pa.Table:
        s, block = (k.as_py() for k in key)
        total = np.zeros(n_boot * _UNITS, np.int64)
        for part in cells.column("cells").to_pylist():
            total += np.bincount(np.cumsum(unsqueezed(part), dtype=np.int64), minlength=len(total))
        times = total.reshape(n_boot, _UNITS).T.astype("<i4")
        drawn = np.flatnonzero(times.any(axis=1))
        of = squeezed if small else np.ndarray.tobytes
        return pa.table({"__s": pa.array([s] * len(drawn), pa.string()), "__i": pa.array(drawn + block * _UNITS + 1, pa.int64()), "times": pa.array([of(times[i]) for i in drawn], pa.binary())})

    cells = slots.mapInArrow(route, "__s string, __u long, cells binary")
    times = cells.groupBy("__s", "__u").applyInArrow(count, "__s string, __i long, times binary")
    return stored(u.join(times, ["__s", "__i"]).select(*strata, unit, "times"), "draws")


#: Units of a group that a task of ``drawn_weights`` adds up together, and distinct values of it, about.
_FOLD_UNITS, _FOLD_VALUES = 4_096, 4_096


def drawn_weights(df: DataFrame, by: list[str], unit: str, value: str, n_boot: int, seed: int) -> DataFrame:
    """How often each value stands in each replicate of a bootstrap over whole units: by, replicate, value, weight.

    Units' draw counts go to the slices of the value axis as arrays; a slice adds them up per distinct value and block of units,
    and only those sums become rows. Slices hold so many distinct values, not rows, so of few values a unit's counts go out once
    however many units there are.
    """
    per = df.groupBy(*by, F.col(unit).cast("string").alias("__unit"), value).agg(F.count(F.lit(1)).cast("double").alias("__c"))
    per = stored(per, "valued-units")
    sliced = value_slices(per, by, value, _FOLD_VALUES, of=per.select(*by, value).distinct())
    # a slice of few distinct values may hold every unit of a large group: its units go in blocks
    many = per.groupBy(*by).agg(F.ceil(F.countDistinct("__unit") / F.lit(_FOLD_UNITS)).cast("int").alias("__blocks")).where("__blocks > 1")
    many = stored(many, "unit-blocks")
    # at most one row per _FOLD_UNITS units; broadcast only while that is few
    per = sliced.join(F.broadcast(many) if many.count() <= 1_000_000 else many, by, "left")
    per = per.withColumn("__block", F.pmod(F.xxhash64("__unit"), F.coalesce("__blocks", F.lit(1))).cast("int")).drop("__blocks")
    key, kinds = [*by, SLICE, "__block"], dict(per.dtypes)
    times = bootstrap_arrays(df, unit, by, n_boot, seed, small=True).select(*by, F.col(unit).cast("string").alias("__unit"), "times")
    draws = per.select(*key, "__unit").distinct().join(times, [*by, "__unit"])

    def fold(name: tuple, rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        place = {k: i for i, k in enumerate(drawn["__unit"])}
        table = np.vstack([unsqueezed(x) for x in drawn["times"]]) if len(drawn) else np.zeros((0, n_boot))
        out = []
        for v, part in rows[rows["__unit"].isin(place)].groupby(value):
            w = part["__c"].to_numpy() @ table[part["__unit"].map(place).to_numpy(int)]
            out.append((*name[:-2], v, w.tolist()))
        return pd.DataFrame(out, columns=[*by, value, "w"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in (*by, value)) + ", w array<double>"
    sums = per.toDF(*per.columns).groupBy(*key).cogroup(draws.groupBy(*key)).applyInPandas(fold, schema)
    rows = sums.select(*by, value, F.posexplode("w").alias("replicate", "weight")).where("weight > 0")
    rows = rows.groupBy(*by, (F.col("replicate") + 1).alias("replicate"), value).agg(F.sum("weight").cast("long").alias("weight"))
    return rows.select(*by, "replicate", value, "weight")


def fraction_draws(df: DataFrame, unit: str, fractions: Sequence[float], draws: int, seed: int = 0) -> DataFrame:
    """Learning-curve subsamples: units kept per (fraction, draw) by hash threshold."""
    u = df.select(unit).distinct()
    u = u.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = u.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return u.filter(hash_unit(F.lit(seed), F.col("draw"), F.col(unit)) < F.col("fraction"))


def hash_split(df: DataFrame, unit: str, share: float, seed: int = 0, name: str = "split") -> DataFrame:
    """train/test by unit: every row of a unit is on the same side."""
    part = F.when(hash_unit(F.lit(seed), F.col(unit)) < share, "train").otherwise("test")
    return df.withColumn(name, part)


def resample_units(df: DataFrame, unit: str, times: DataFrame, new_id: str = "synthetic_id") -> DataFrame:
    """Whole units drawn with replacement, each copy under a fresh negative id.

    ``times`` has (unit, times); copies are numbered by a running total over a hash order.
    """
    t = times.withColumn("__h", hash_unit(F.lit("copies"), F.col(unit)))
    t = prefix_scan(
        t, [], ["__h", unit], F.floor(F.col("__h") * (1 << 20)).cast("long"), {"__hi": ("sum", "times")}
    )
    t = t.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("times"))))
    t = t.select(unit, (-(F.col("__hi") - F.col("times") + F.col("__c"))).cast("long").alias(new_id))
    return df.join(t, unit)


def marginal_impute(df: DataFrame, cols: Sequence[str], ident: str, seed: int = 0) -> DataFrame:
    """Fill missing cells by drawing from the observed values of the same column.

    Observed values are numbered; a missing cell draws a number by hash and joins on it, so no
    column is ever gathered in one place.
    """
    out = df
    for c in cols:
        seen = df.filter(F.col(c).isNotNull()).select(ident, F.col(c).alias("__v"))
        seen = seen.withColumn("__h", hash_unit(F.lit("imp"), F.col(ident)))
        seen = row_numbers(seen, [], ["__h", ident], F.floor(F.col("__h") * (1 << 20)).cast("long"), "__k")
        n = seen.agg(F.max("__k").alias("__n")).withColumn("__one", F.lit(1))
        miss = out.filter(F.col(c).isNull()).select(ident).withColumn("__one", F.lit(1))
        miss = miss.join(F.broadcast(n), "__one")
        k = (F.floor(hash_unit(F.lit(f"{seed}{c}"), F.col(ident)) * F.col("__n")) + 1).cast("long")
        fill = miss.withColumn("__k", k).join(seen.select("__k", "__v"), "__k").select(ident, "__v")
        out = out.join(fill, ident, "left").withColumn(c, F.coalesce(c, "__v")).drop("__v")
    return out
