"""Helpers shared by the operators: stored tables, value binding, words, prefix sums and spans as column expressions."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_BLOCK = 256
_STORED: list[tuple[SparkSession, str, str]] = []
_OWNER = ["query"]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none (tests) gets a temporary folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="wardspan-llm-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STORED.append((spark, _OWNER[-1], path))
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


@contextlib.contextmanager
def storing_for(owner: str):
    """Tables stored inside belong to ``owner``."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``stored`` returned, once nothing that is still to be computed reads it."""
    _remove(df.sparkSession, df._stored_at)
    _STORED[:] = [x for x in _STORED if x[2] != df._stored_at]


def release(spark: SparkSession, owner: str = "query") -> None:
    """Remove the owner's stored tables; call it once the results that read them are written."""
    left = []
    for session, own, path in _STORED:
        if session is spark and own == owner:
            _remove(spark, path)
        else:
            left.append((session, own, path))
    _STORED[:] = left


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and in whatever lambda the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words between ASCII white space; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def _running(values: Column, zero: Column) -> Column:
    """[0, v1, v1+v2, ...]: one element more than the input."""
    return F.aggregate(values, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def prefix_sums(values: Column) -> Column:
    """Sum of all earlier elements for each element of an array of longs.

    Works in blocks, so that an array of n elements costs n * 256 copies instead of n * n.
    """
    zero = F.lit(0).cast("long")

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: _running(F.slice(v, b * _BLOCK + 1, _BLOCK), zero))
        return let(cut, lambda c: let(_running(F.transform(c, lambda p: F.element_at(p, -1)), zero), lambda outer: F.flatten(
            F.transform(c, lambda p, b: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(outer, b))))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<bigint>")))


def spans(text: Column, regex: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, value>>, in code points, end exclusive.

    Pieces between matches and the matches themselves come from the same pattern; their lengths give the places.
    """
    pieces, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1))

    def place(p: Column, m: Column) -> Column:
        gap = F.transform(m, lambda x, i: (F.length(F.get(p, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)).cast("long"))
        starts = let(gap, lambda g: F.transform(prefix_sums(g), lambda s, i: s + F.get(g, i)))
        return let(starts, lambda s: F.transform(m, lambda x, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), x.alias("value"))))

    return let(pieces, lambda p: let(found, lambda m: place(p, m)))


NO_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def spans_if(condition: Column, text: Column, regex: str) -> Column:
    """``spans`` where a cheap necessary condition holds, else none."""
    return F.when(condition, spans(text, regex)).otherwise(F.array().cast(NO_SPANS))


def fresh(taken: list[str], name: str) -> str:
    """``name``, or ``name`` with underscores in front until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
