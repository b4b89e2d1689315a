"""Observation contract: schema, channel registry, parsing, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: contract vocabulary --------------------------------------------
SOURCES = ("icu_monitor", "wearable", "manual", "lab")
QUALITY_FLAGS = ("imputed", "out_of_range", "device_fault", "synthetic", "duplicate")
SCORING_CHANNELS = ("hr", "rr", "spo2", "sbp", "temp_c", "gcs_total", "fio2")
LOINC = "http://loinc.org"
DEVICE_CODES = "urn:device-signal"
# channel: (code, code system, display, unit)
CHANNELS = {
    "hr": ("8867-4", LOINC, "Heart rate", "/min"),
    "rr": ("9279-1", LOINC, "Respiratory rate", "/min"),
    "spo2": ("59408-5", LOINC, "Oxygen saturation, pulse oximetry", "%"),
    "sbp": ("8480-6", LOINC, "Systolic blood pressure", "mmHg"),
    "map": ("8478-0", LOINC, "Mean blood pressure", "mmHg"),
    "temp_c": ("8310-5", LOINC, "Body temperature", "Cel"),
    "gcs_total": ("9269-2", LOINC, "Glasgow coma score total", "{score}"),
    "fio2": ("3150-0", LOINC, "Inhaled oxygen concentration", "%"),
    "glucose": ("2339-0", LOINC, "Glucose [Mass/volume] in Blood", "mg/dL"),
    "bvp": ("bvp", DEVICE_CODES, "Blood volume pulse (PPG)", "nW"),
    "acc_x": ("acc_x", DEVICE_CODES, "Acceleration, X axis", "g"),
    "acc_y": ("acc_y", DEVICE_CODES, "Acceleration, Y axis", "g"),
    "acc_z": ("acc_z", DEVICE_CODES, "Acceleration, Z axis", "g"),
    "eda": ("eda", DEVICE_CODES, "Electrodermal activity", "uS"),
    "temp_skin": ("temp_skin", DEVICE_CODES, "Skin temperature (wrist)", "Cel"),
    "ibi": ("ibi", DEVICE_CODES, "Inter-beat interval", "s"),
    "activity_index": ("activity_index", DEVICE_CODES, "Activity index (RMS accelerometer deviation)", "g"),
}

OBSERVATION = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("patient_ref", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("code_system", T.StringType()),
        T.StructField("display", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("effective_time", T.TimestampType()),
        T.StructField("ingest_time", T.TimestampType()),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
    ]
)


def channel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, *v) for n, v in CHANNELS.items()],
        "channel string, code string, code_system string, display string, unit string",
    )


def enrich_channel(df: DataFrame, channel: str = "channel") -> DataFrame:
    """Code, system, display and unit of a registered channel."""
    reg = channel_table(df.sparkSession).withColumnRenamed("channel", channel)
    return df.join(F.broadcast(reg), channel, "left")


def channel_of_code(df: DataFrame, code: str = "code") -> DataFrame:
    reg = channel_table(df.sparkSession).select(F.col("code").alias(code), "channel")
    return df.join(F.broadcast(reg), code, "left")


def parse_observations(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON texts into valid observations and rejected texts.

    A record is valid if it parses, names a patient, device, code, unit and both times, has a
    number as value, a known source and only known quality flags. A time without a zone is UTC.
    """
    typed = T.StructType([*OBSERVATION.fields, T.StructField("_corrupt", T.StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    d = raw.withColumn("__raw", F.col(column).cast("string"))
    d = d.withColumn("__o", F.from_json("__raw", typed, opts))
    o = F.col("__o")
    need = ("patient_ref", "device_id", "code", "unit", "value", "effective_time", "ingest_time")
    ok = reduce(lambda a, b: a & b, [o[c].isNotNull() for c in need]) & o["_corrupt"].isNull()
    ok = ok & o["source"].isin(*SOURCES)
    flags = F.coalesce(o["quality_flags"], F.array().cast("array<string>"))
    ok = ok & F.forall(flags, lambda f: f.isin(*QUALITY_FLAGS))
    d = d.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    cols = [o[f.name].alias(f.name) for f in OBSERVATION.fields]
    good = d.filter("__ok").select(*cols).withColumns(
        {
            "schema_version": F.coalesce("schema_version", F.lit(1)),
            "code_system": F.coalesce("code_system", F.lit(LOINC)),
            "display": F.coalesce("display", F.lit("")),
            "quality_flags": F.coalesce("quality_flags", F.array().cast("array<string>")),
        }
    )
    return good, d.filter(~F.col("__ok")).select(F.col("__raw").alias("raw"))


def wide_to_observations(grid: DataFrame, channels: list[str], key: str, ts: str) -> DataFrame:
    """One observation row per non-NULL core value, with the ``imputed`` flag where it was filled."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"), F.col(c).cast("double").alias("value"),
                F.col(f"{c}_was_imputed").alias("imputed"),
            )
            for c in channels
        ]
    )
    long = grid.select(key, ts, F.inline(cells)).filter(F.col("value").isNotNull())
    long = enrich_channel(long)
    flags = F.when(F.col("imputed"), F.array(F.lit("imputed"))).otherwise(F.array().cast("array<string>"))
    return long.select(
        F.lit(1).alias("schema_version"), F.concat(F.lit("ICUStay/"), F.col(key).cast("string")).alias("patient_ref"),
        F.lit("icu-monitor").alias("device_id"), F.lit("icu_monitor").alias("source"), "channel", "code", "code_system",
        "display", "value", "unit", F.col(ts).alias("effective_time"), flags.alias("quality_flags"),
    )


def kafka_source(spark: SparkSession, servers: str, pattern: str = r"raw\..*", **options: str) -> DataFrame:
    """Stream of every matching topic, from the earliest offset on the first start.

    Offsets after that come from the query's checkpoint. Needs the Kafka package on the cluster.
    """
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    r = r.option("subscribePattern", pattern).option("startingOffsets", "earliest")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def file_source(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of text lines from a landing folder (one JSON record per line)."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def topic_column() -> dict:
    return {"topic": F.concat(F.lit("raw."), F.col("source"))}


def to_records(obs: DataFrame) -> DataFrame:
    """Key, JSON value and topic per observation, ready for a Kafka sink."""
    body = F.to_json(F.struct(*[F.col(f.name) for f in OBSERVATION.fields if f.name in obs.columns]))
    return obs.select(F.col("patient_ref").alias("key"), body.alias("value"), F.concat(F.lit("raw."), F.col("source")).alias("topic"))


def write_kafka(obs: DataFrame, servers: str, checkpoint: str):
    out = to_records(obs).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return out.option("checkpointLocation", checkpoint).start()


def write_jsonl(obs: DataFrame, path: str, mode: str = "append") -> None:
    """One folder of JSON lines per source."""
    obs.write.mode(mode).partitionBy("source").json(path)


def publish_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy(F.concat(F.lit("raw."), F.col("source")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
