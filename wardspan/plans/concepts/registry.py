"""Catalogue of derived tables: lazy DataFrames by name, built in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

CONCEPTS: dict[str, Callable[["Catalog"], DataFrame]] = {}


def concept(name: str):
    def wrap(fn):
        CONCEPTS[name] = fn
        return fn

    return wrap


class Catalog:
    """Raw and derived tables by name. A derived table is planned once, on first use."""

    def __init__(self, spark: SparkSession, raw: Mapping[str, DataFrame]) -> None:
        self.spark = spark
        self._tables = dict(raw)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = CONCEPTS[name](self)
        return self._tables[name]

    def put(self, name: str, df: DataFrame) -> None:
        self._tables[name] = df

    def __contains__(self, name: str) -> bool:
        return name in self._tables


def build_concepts(catalog: Catalog, path: str, names: list[str] | None = None) -> DataFrame:
    """Write each derived table under ``path`` and read it back for the ones that follow.

    A failing table does not stop the others. Returns one status row per table. Writing cuts the
    lineage, so an executor lost late in the build does not redo the early tables.
    """
    rows = []
    for n in names or list(CONCEPTS):
        target = f"{path.rstrip('/')}/{n}"
        try:
            CONCEPTS[n](catalog).write.mode("overwrite").parquet(target)
            df = catalog.spark.read.parquet(target)
            catalog.put(n, df)
            rows.append((n, "ok", df.count(), None))
        except Exception as e:  # noqa: BLE001
            rows.append((n, "failed", None, str(e)[:500]))
    return catalog.spark.createDataFrame(rows, "table_name string, status string, rows long, error string")
