"""Declared-schema CSV tables, catalogues, exports and landing-zone checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.operators.sampling import seeded_sample

_SIMPLE = {
    "int": T.IntegerType(), "long": T.LongType(), "short": T.ShortType(), "float": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "ts": T.TimestampNTZType(), "date": T.DateType(),
}


def declared(text: str) -> T.StructType:
    """Schema from blank-separated ``name:type`` pairs."""
    return T.StructType([T.StructField(n, _SIMPLE[t]) for n, t in (p.split(":") for p in text.split())])


# The columns of the raw tables that the derived tables read
SCHEMAS: dict[str, T.StructType] = {
    "patients": declared("subject_id:int gender:string anchor_age:short anchor_year:short dod:ts"),
    "admissions": declared(
        "subject_id:int hadm_id:int admittime:ts dischtime:ts deathtime:ts admission_type:string admission_location:string "
        "discharge_location:string insurance:string marital_status:string race:string edregtime:ts hospital_expire_flag:short"
    ),
    "icustays": declared("subject_id:int hadm_id:int stay_id:int first_careunit:string last_careunit:string intime:ts outtime:ts los:float"),
    "chartevents": declared(
        "subject_id:int hadm_id:int stay_id:int charttime:ts storetime:ts itemid:int value:string valuenum:float valueuom:string"
    ),
    "labevents": declared(
        "labevent_id:int subject_id:int hadm_id:int specimen_id:int itemid:int charttime:ts storetime:ts value:string valuenum:double "
        "valueuom:string ref_range_lower:double ref_range_upper:double flag:string"
    ),
    "inputevents": declared(
        "subject_id:int hadm_id:int stay_id:int starttime:ts endtime:ts itemid:int amount:float rate:float rateuom:string orderid:int "
        "linkorderid:int patientweight:float"
    ),
    "outputevents": declared("subject_id:int hadm_id:int stay_id:int charttime:ts itemid:int value:float"),
    "procedureevents": declared("subject_id:int hadm_id:int stay_id:int starttime:ts endtime:ts itemid:int value:float location:string"),
    "prescriptions": declared("subject_id:int hadm_id:int starttime:ts stoptime:ts drug_type:string drug:string route:string"),
    "diagnoses_icd": declared("subject_id:int hadm_id:int seq_num:int icd_code:string icd_version:short"),
    "procedures_icd": declared("subject_id:int hadm_id:int seq_num:int chartdate:ts icd_code:string icd_version:short"),
    "d_icd_diagnoses": declared("icd_code:string icd_version:short long_title:string"),
    "d_icd_procedures": declared("icd_code:string icd_version:short long_title:string"),
    "d_items": declared("itemid:int label:string category:string param_type:string unitname:string"),
    "d_labitems": declared("itemid:int label:string fluid:string category:string"),
    "microbiologyevents": declared(
        "microevent_id:int subject_id:int hadm_id:int micro_specimen_id:int chartdate:ts charttime:ts spec_type_desc:string "
        "org_itemid:int org_name:string ab_name:string interpretation:string"
    ),
    "services": declared("subject_id:int hadm_id:int transfertime:ts prev_service:string curr_service:string"),
    "transfers": declared("subject_id:int hadm_id:int eventtype:string careunit:string intime:ts outtime:ts"),
    "poe": declared("poe_id:string poe_seq:int subject_id:int hadm_id:int ordertime:ts order_type:string order_subtype:string"),
    "poe_detail": declared("poe_id:string poe_seq:int field_value:string"),
}


def read_declared_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV (plain or gzip) matched to the schema by column name.

    Everything is read as text and cast; a column missing in the file is NULL, an undeclared one
    is ignored, an empty text is NULL.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    have = set(raw.columns)
    cols = []
    for f in schema:
        if f.name not in have:
            c = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
        else:
            text = F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit(""))
            # whole numbers may be written with a trailing ".0"
            whole = isinstance(f.dataType, T.IntegralType)
            c = (text.try_cast("double") if whole else text).try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def landing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length and table name of every ``*.csv.gz`` below the folder; loose ``.csv`` is left out.

    A table is a file of its name, or a folder of that name with part files.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv.gz").option("recursiveFileLookup", True).load(folder)
    return f.select("path", "length", F.regexp_extract("path", r"([^/]+)\.csv\.gz(?:/part-[^/]*)?$", 1).alias("table_name"))


def load_catalog(
    spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType] = SCHEMAS, views: bool = False
) -> dict[str, DataFrame]:
    """One DataFrame per declared table found in the landing folder, over all files of that name; others are skipped."""
    files = landing_files(spark, folder).filter(F.col("table_name").isin(*schemas))
    found = {r["table_name"]: r["paths"] for r in files.groupBy("table_name").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}
    out = {n: reduce(DataFrame.unionByName, (read_declared_csv(spark, p, schemas[n]) for p in paths)) for n, paths in found.items()}
    if views:
        for n, df in out.items():
            df.createOrReplaceTempView(n)
    return out


def convert_to_parquet(catalog: Mapping[str, DataFrame], path: str, sort: Mapping[str, Sequence[str]] | None = None) -> None:
    """Write the tables as parquet once: gzip text cannot be split or pruned.

    Event tables sorted by item code inside their files let the reader skip row groups.
    """
    for n, df in catalog.items():
        keys = (sort or {"chartevents": ["itemid"], "labevents": ["itemid"]}).get(n)
        (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{n}")


def cohort(catalog: Mapping[str, DataFrame], n: int, seed: int = 0, key: str = "subject_id") -> dict[str, DataFrame]:
    """The catalogue reduced to a seeded sample of subjects; tables without the key stay whole."""
    ids = seeded_sample(catalog["patients"].select(key), key, n, seed)
    return {t: df.join(ids, key, "left_semi") if key in df.columns else df for t, df in catalog.items()}


def survey_files(spark: SparkSession, folder: str, expected: Sequence[str]) -> DataFrame:
    """Present or missing, and bytes, per expected table."""
    f = landing_files(spark, folder).groupBy("table_name").agg(F.sum("length").alias("bytes"))
    want = spark.createDataFrame([(n,) for n in expected], "table_name string")
    out = want.join(f, "table_name", "left")
    return out.withColumn("status", F.when(F.col("bytes").isNotNull(), "present").otherwise("missing"))


def below(folder: str) -> Column:
    """Path of a file relative to the folder it was loaded from."""
    root = folder.rstrip("/").split("://")[-1].lstrip("/")
    return F.regexp_replace("path", rf"^.*\Q{root}\E/", "")


def verify_checksums(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Compare sha256 of every file with a manifest of (file, sha256): ok, changed or missing.

    Files are named by their path below the folder.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = below(folder)
    got = f.select(name.alias("file"), F.sha2("content", 256).alias("actual"), F.col("length").alias("bytes"))
    out = manifest.join(got, "file", "left")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.lower("sha256"), "ok").otherwise("changed")
    return out.withColumn("status", status)


def write_training_export(df: DataFrame, path: str, split: str, group: str, manifest: Sequence[str]) -> None:
    """Write train and test parts after two checks: the columns match the manifest, and no
    subject is in both parts."""
    missing = set(manifest) - set(df.columns)
    extra = set(df.columns) - set(manifest) - {split}
    if missing or extra:
        raise ValueError(f"columns differ from the manifest: missing {sorted(missing)}, extra {sorted(extra)}")
    both = df.groupBy(group).agg(F.countDistinct(split).alias("n")).filter(F.col("n") > 1)
    if both.limit(1).count():
        raise ValueError("a subject is in more than one part")
    df.write.mode("overwrite").partitionBy(split).parquet(path)
