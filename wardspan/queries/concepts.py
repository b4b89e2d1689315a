"""The derived clinical tables as queries, over ICU-shaped tables made from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.plans.concepts import CONCEPTS, ORDER, Catalog
from wardspan.queries import icu
from wardspan.queries.concept_sql import SQL, oracle
from wardspan.queries.registry import Tables, query
from wardspan.session import shared_dir, stored

# line items with their stays (icu.spark_raw) and the derived tables that several others read are written once per session
STORED = {
    "icustays", "vitalsign", "bg", "gcs", "chemistry", "complete_blood_count", "enzyme",
    "urine_output", "weight_durations", "ventilator_setting", "oxygen_delivery", "ventilation", "icustay_times", "icustay_hourly",
    "urine_output_rate", "kdigo_uo", "kdigo_creatinine", "first_day_lab", "first_day_vitalsign", "first_day_gcs",
    "first_day_urine_output", "sofa", "antibiotic", "suspicion_of_infection", "vasoactive_agent",
}
_CATALOGS: dict[tuple[str, str], "StoredCatalog"] = {}


class StoredCatalog(Catalog):
    """Catalogue that keeps the shared tables as files in the cluster's checkpoint folder."""

    def __init__(self, spark, raw) -> None:
        super().__init__(spark, raw)
        self.base = f"{shared_dir(spark).rstrip('/')}/derived/{uuid.uuid4().hex}"
        self._stored: set[str] = set()

    def __call__(self, name: str) -> DataFrame:
        df = super().__call__(name)
        if name in STORED and name not in self._stored:
            df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
            df = self.spark.read.parquet(f"{self.base}/{name}")
            self.put(name, df)
            self._stored.add(name)
        return df


def catalog(t: Tables) -> StoredCatalog:
    key = (t.spark.sparkContext.applicationId, t.path)
    if key not in _CATALOGS:
        _CATALOGS[key] = StoredCatalog(t.spark, icu.spark_raw(t, lambda df: stored(df, "moments")))
    return _CATALOGS[key]


def tidy(df: DataFrame) -> DataFrame:
    """Decimals as doubles and all doubles to six places, for comparison across engines."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType)):
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def _register(name: str) -> None:
    @query(f"concept_{name}", oracle(name) if name in SQL else None)
    def run(t: Tables) -> DataFrame:
        return tidy(catalog(t)(name))


for _name in ORDER:
    assert _name in CONCEPTS
    _register(_name)
