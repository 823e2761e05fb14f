"""Golden cases from a folder of label files, and the sessions' artefacts that they are held against.

A label file is one JSON document; a broken one doesn't stop the others: it is a row of `bad`. A case whose session has no
documents can't be measured and says so."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "case_id string, session_id string, verified boolean, expected_fields map<string,string>, expected_chunks array<string>, expected_citations map<string,array<string>>, _corrupt_record string"
ARTEFACTS = "documents array<struct<doc_id:string, extracted_fields:map<string,struct<value:string,machine_value:string>>>>, _corrupt_record string"
REPORT = "checks array<struct<check_id:string, verdict:string, citations:array<struct<chunk_id:string, source_doc:string>>>>, _corrupt_record string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of a glob as one row each with their `file`; none where the folder isn't there."""
    try:
        whole = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, file string")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return whole.select(parsed.alias("j"), F.col("_metadata.file_path").alias("file")).select("j.*", "file")


def _stem(depth: int = 1):
    """The file's name without its ending, or the name of the folder `depth` - 1 above it."""
    return F.regexp_extract("file", r"([^/]+)\.json$", 1) if depth == 1 else F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)


def load_cases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cases, bad): label files of a folder, and `file, reason` of those that can't be read: broken ones, and artefacts of
    sessions that were put there by mistake (a folder with documents.json in it)."""
    every = _read(spark, f"{folder}/*.json", CASE)
    broken = F.col("_corrupt_record").isNotNull()
    cases = every.filter(~broken).withColumn("case_id", F.coalesce("case_id", _stem())).withColumn("verified", F.coalesce("verified", F.lit(False))).drop("_corrupt_record", "file")
    bad = every.filter(broken).select(F.concat(_stem(), F.lit(".json")).alias("file"), F.lit("broken").alias("reason"))
    misplaced = _read(spark, f"{folder}/*/documents.json", "_corrupt_record string").select(_stem(2).alias("file"), F.lit("artefacts").alias("reason"))
    return cases, bad.unionByName(misplaced)


def artefacts(spark: SparkSession, temp: str) -> tuple[DataFrame, DataFrame]:
    """(fields, cited): `session_id, field_key, actual` of all sessions' documents (the first document with a value, and what the machine
    read where it was edited), and `session_id, check_id, chunk_id, source` of their reports. Broken files count as missing."""
    docs = _read(spark, f"{temp}/*/documents.json", ARTEFACTS).filter("_corrupt_record is null and documents is not null")
    own = docs.select(_stem(2).alias("session_id"), F.posexplode("documents").alias("ord", "d"))
    fields = own.select("session_id", "ord", F.explode("d.extracted_fields").alias("field_key", "v"))
    value = F.coalesce(F.col("v.machine_value"), F.col("v.value"))
    has = value.isNotNull() & (F.btrim(value) != "")
    first = fields.groupBy("session_id", "field_key").agg(F.min_by(F.when(has, value), F.struct(~has, "ord")).alias("actual"))
    reports = _read(spark, f"{temp}/*/final_report.json", REPORT).filter("_corrupt_record is null")
    checks = reports.select(_stem(2).alias("session_id"), F.explode("checks").alias("c"))
    cited = checks.select("session_id", F.col("c.check_id").alias("check_id"), F.explode("c.citations").alias("q")).select("session_id", "check_id", F.col("q.chunk_id").alias("chunk_id"), F.col("q.source_doc").alias("source"))
    return first, cited


def joined(cases: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, pairs): `case_id, session_id, verified, ok, error` of every case, and `case_id, field_key, expected, actual` of those that
    can be measured (`ok`), one row an expected field."""
    known = fields.select("session_id").distinct().withColumn("_known", F.lit(True))
    status = cases.join(known, "session_id", "left").withColumn("ok", F.coalesce("_known", F.lit(False)))
    error = F.when(~F.col("ok"), F.concat(F.lit("no artefacts of session "), F.coalesce(F.nullif("session_id", F.lit("")), F.lit("(none named)"))))
    wanted = status.filter("ok").select("case_id", "session_id", F.explode("expected_fields").alias("field_key", "expected"))
    pairs = wanted.join(fields, ["session_id", "field_key"], "left").select("case_id", "field_key", "expected", "actual")
    return status.select("case_id", "session_id", "verified", "ok", error.alias("error")), pairs
