"""Tables as nested exchange resources, one JSON text per row, and bundles per encounter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.codes import code_token
from wardspan.operators.scan import prefix_scan

# fixed values: the identifier system each resource type is keyed on
IDENTIFIERS = {
    "Patient": "urn:record:subject_id", "Encounter": "urn:record:hadm_id", "Device": "urn:device_id",
    "DiagnosticReport": "urn:record:study_id",
}
ICD_SYSTEM = {9: "http://hl7.org/fhir/sid/icd-9-cm", 10: "http://hl7.org/fhir/sid/icd-10-cm"}
ICD_PROCEDURE = {9: "http://hl7.org/fhir/sid/icd-9-cm", 10: "http://hl7.org/fhir/sid/icd-10-pcs"}


def concept_of(system: Column, code: Column, display: Column) -> Column:
    one = F.struct(system.alias("system"), code_token(code).alias("code"), display.alias("display"))
    return F.struct(F.array(one).alias("coding"))


def ref(kind: str, ident: Column) -> Column:
    return F.struct(F.concat(F.lit(f"{kind}/"), ident.cast("string")).alias("reference"))


def identifier(kind: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(IDENTIFIERS[kind]).alias("system"), value.cast("string").alias("value")))


def utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _of(system: dict[int, str], version: Column) -> Column:
    return F.when(version == 10, system[10]).otherwise(system[9])


def shape(kind: str) -> list[Column]:
    """Fields of a resource, named after the columns of its source table."""
    x = F.col
    text = F.lit
    subject = ref("Patient", x("subject_id")).alias("subject") if kind not in ("Patient", "Device") else None
    encounter = ref("Encounter", x("hadm_id")) if kind in ("Condition", "Procedure", "MedicationAdministration") else None
    fields: dict[str, list[Column]] = {
        "Patient": lambda: [
            x("subject_id").cast("string").alias("id"), identifier("Patient", x("subject_id")).alias("identifier"),
            F.when(x("gender") == "M", "male").when(x("gender") == "F", "female").otherwise("unknown").alias("gender"),
        ],
        "Encounter": lambda: [
            x("hadm_id").cast("string").alias("id"), identifier("Encounter", x("hadm_id")).alias("identifier"),
            F.when(x("dischtime").isNotNull(), "finished").otherwise("in-progress").alias("status"),
            F.when(F.upper("admission_type").contains("EMER"), "EMER").otherwise("IMP").alias("class"), subject,
            F.struct(utc(x("admittime")).alias("start"), utc(x("dischtime")).alias("end")).alias("period"),
        ],
        "Condition": lambda: [
            F.concat_ws("-", x("hadm_id").cast("string"), x("seq_num").cast("string")).alias("id"),
            concept_of(_of(ICD_SYSTEM, x("icd_version")), x("icd_code"), x("long_title")).alias("code"), subject, encounter.alias("encounter"),
        ],
        "Procedure": lambda: [
            F.concat_ws("-", x("hadm_id").cast("string"), x("seq_num").cast("string")).alias("id"), text("completed").alias("status"),
            concept_of(_of(ICD_PROCEDURE, x("icd_version")), x("icd_code"), x("long_title")).alias("code"), subject, encounter.alias("encounter"),
            x("chartdate").cast("string").alias("performedDateTime"),
        ],
        "MedicationAdministration": lambda: [
            text("completed").alias("status"), concept_of(text("urn:record:drug-name"), x("drug"), x("drug")).alias("medicationCodeableConcept"),
            subject, encounter.alias("context"), utc(x("starttime")).alias("effectiveDateTime"),
            F.when(x("route").isNotNull(), F.struct(concept_of(text("urn:record:route"), x("route"), x("route")).alias("route"))).alias("dosage"),
        ],
        "Observation": lambda: [
            text("final").alias("status"), concept_of(x("code_system"), x("code"), F.coalesce(F.nullif(x("display"), text("")), x("code"))).alias("code"),
            F.struct(x("patient_ref").alias("reference")).alias("subject"), utc(x("effective_time")).alias("effectiveDateTime"),
            F.struct(x("value"), x("unit")).alias("valueQuantity"), ref("Device", x("device_id")).alias("device"),
            F.when(F.size("quality_flags") > 0, F.array(F.struct(F.concat(text("quality_flags: "), F.array_join("quality_flags", ", ")).alias("text")))).alias("note"),
        ],
        "RiskAssessment": lambda: [
            text("final").alias("status"), subject, F.array(ref("Observation", x("stay_id"))).alias("basis"),
            F.array(F.struct(concept_of(text("urn:score"), text("news2"), text("NEWS2 (ICU-recalibrated)")).alias("outcome"), x("tier_icu").alias("qualitativeRisk"))).alias("prediction"),
            F.transform("reason", lambda r: F.struct(r.alias("text"))).alias("note"),
        ],
        "DocumentReference": lambda: [
            text("current").alias("status"), concept_of(text("urn:note-type"), x("note_type"), x("note_type")).alias("type"), subject,
            F.array(F.struct(F.struct(text("text/plain").alias("contentType"), F.base64(F.encode("note_text", "UTF-8")).alias("data")).alias("attachment"))).alias("content"),
        ],
        "Device": lambda: [
            x("device_id").alias("id"), identifier("Device", x("device_id")).alias("identifier"),
            concept_of(text("urn:device-type"), x("device_type"), x("device_type")).alias("type"),
        ],
        "DiagnosticReport": lambda: [
            text("final").alias("status"), concept_of(text("http://loinc.org"), text("11524-6"), text("EKG study")).alias("code"), subject,
            utc(x("ecg_time")).alias("effectiveDateTime"), identifier("DiagnosticReport", x("study_id")).alias("identifier"),
        ],
        "Communication": lambda: [
            x("alert_id").cast("string").alias("id"), text("completed").alias("status"), subject, utc(x("sent")).alias("sent"),
            F.array(F.struct(x("message").alias("contentString"))).alias("payload"),
        ],
    }
    return [F.lit(kind).alias("resourceType"), *fields[kind]()]


def to_resources(df: DataFrame, kind: str) -> DataFrame:
    """The source columns plus one JSON resource per row."""
    return df.withColumn("resource", F.to_json(F.struct(*shape(kind))))


def rewrite_reference(r: Column) -> Column:
    """``Type/id`` as ``Type?identifier=system|id`` where the type has a business identifier."""
    kind, local = F.substring_index(r, "/", 1), F.expr("null").cast("string")
    local = F.regexp_extract(r, r"^[^/]*/(.*)$", 1)
    out = r
    for k, system in IDENTIFIERS.items():
        ok = (kind == k) & (local != "") & ~r.contains("?")
        out = F.when(ok, F.concat(F.lit(f"{k}?identifier={system}|"), local)).otherwise(out)
    return out


def bundles(resources: DataFrame, key: str, order: str) -> DataFrame:
    """Transaction bundles, one row per entry: key, type, position from 1, entries in the bundle, entry.

    A key may have any number of resources, so a bundle is never gathered in one row; a writer streams the
    rows of a key in order of ``position``. ``order`` is a number or a time.
    """
    slice_ = F.floor(F.col(order).cast("double") / 1000).cast("long")
    rows = prefix_scan(resources, [key], [order, "resource"], slice_, {"position": ("sum", F.lit(1)), "n": ("total", F.lit(1))})
    return rows.select(key, F.lit("transaction").alias("type"), "position", "n", F.col("resource").alias("entry"))
