"""The whole way of a dossier: text, fields, passages in force, judgements, verdicts, report. Reading is
`operators.extract`, judging `operators.judging`; this module gives them their tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import normalize_signed_date
from ..functions.text import normalize_text
from ..operators import extract, judging, retrieval
from ..sources import calls, models
from ..sources.cuts import written
from .audit import table
from .dossiers import CATALOG


@dataclass(frozen=True)
class CheckSet:
    """fields: what to read; required, declared: keys; date_field: the signing date's key."""

    fields: list[extract.Field]
    required: tuple[str, ...] = ()
    declared: tuple[str, ...] = ()
    date_field: str = ""
    kind: str = "contract"
    rules: judging.Rules = field(default_factory=judging.Rules)
    model: Callable[[], models.Model] = field(default=models.EchoModel)
    embedder: Callable[[], models.Embedder] = field(default=models.HashEmbedder)


def read_fields(docs: DataFrame, check: CheckSet) -> DataFrame:
    """`doc_id, field_key, value, confidence, quote` with what the check set says of each field."""
    clean = docs.select("doc_id", normalize_text(F.coalesce("text", F.lit(""))).alias("text"))
    got = extract.extract_fields(clean, check.fields)
    key = F.col("field_key")
    kinds = F.create_map(*[F.lit(x) for f in check.fields for x in (f.key, f.kind)])
    labels = F.create_map(*[F.lit(x) for f in check.fields for x in (f.key, f.label)])
    kind = F.when(key.isin(*check.declared, ""), "declaration").when(kinds[key] == "number", "positive_integer").otherwise("regulated")
    return got.withColumn("kind", kinds[key]).withColumn("label", labels[key]).withColumn("check_type", kind).withColumn("required", key.isin(*check.required, "")).withColumn("selected", F.lit(True))


def signing_days(fields: DataFrame, check: CheckSet) -> DataFrame:
    """`doc_id, day`: null where it can't be read, which lifts the filter of validity."""
    own = fields.filter(F.col("field_key") == check.date_field)
    return own.select("doc_id", F.try_to_date(normalize_signed_date(F.coalesce("value", F.lit(""))), "yyyy-MM-dd").alias("day"))


def nearness(fields: DataFrame, chunks: DataFrame, check: CheckSet) -> DataFrame:
    """`field_key, chunk_id, text_key, distance, effective_from, effective_to` of every field of the set and every passage in scope: a distance
    belongs to a field and a passage, whatever the dossier and its day. `chunks`: chunk_id (text), text, effective_from, effective_to and what the scope asks for."""
    labels = fields.select("field_key", "label").distinct().select("field_key", F.concat_ws(" ", F.lit(check.kind), "label").alias("text"))
    vec = models.embed(labels.withColumnRenamed("field_key", "chunk_id"), check.embedder).withColumnsRenamed({"chunk_id": "field_key", "embedding": "vec"})
    scoped = judging.in_scope(chunks, check.rules)
    near = _distances(vec, models.embed(scoped, check.embedder))
    own = F.sha2(F.coalesce(F.nullif(F.btrim("text"), F.lit("")), F.col("chunk_id")), 256)
    return near.join(scoped.select("chunk_id", own.alias("text_key"), "effective_from", "effective_to"), "chunk_id")


def _distances(fields: DataFrame, store: DataFrame) -> DataFrame:
    """`field_key, chunk_id, distance` of all fields of a check set and all passages. A check set has a bounded number of
    fields (60 at most are drafted): their vectors are one array column, which each passage's row is held against."""
    asked = fields.agg(F.collect_list(F.struct("field_key", "vec")).alias("asked")).withColumn("scope", F.lit(0))
    each = F.transform("asked", lambda a: F.struct(a["field_key"].alias("field_key"), F.round(retrieval.squared_distance(a["vec"], F.col("embedding")), 6).alias("distance")))
    return store.withColumn("scope", F.lit(0)).join(F.broadcast(asked), "scope").select("chunk_id", F.explode(each).alias("d")).select("d.field_key", "chunk_id", "d.distance")


def check_dossiers(docs: DataFrame, chunks: DataFrame, check: CheckSet) -> tuple[DataFrame, DataFrame]:
    """(checks, report) of all documents. Fields, their distances to the passages and what is sent are written once, as later steps read
    them several times; `report.fields` is the table of fields."""
    fields = written(read_fields(docs, check))

    def ask(requests: DataFrame) -> DataFrame:
        return calls.judgements(calls.replies(requests, lambda: [calls.Sized("stand-in", check.model())]))

    blocked = fields.filter((F.col("field_key") == check.date_field) & F.col("value").isNull())
    checks, report, _ = judging.judge(fields, signing_days(fields, check), written(nearness(fields, chunks, check)), chunks, check.rules, ask, blocked)
    report.fields = fields
    return checks, report


def _forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Forms and passages made from orders and parts; small files are few splits, and reading forms is the work."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    o = table(spark, sf_dir, "orders").repartition(tasks)
    k = F.col("o_orderkey")
    text = F.concat(F.lit("HỢP ĐỒNG\n1. Ngày ký: "), F.when(k % 30 == 0, "chưa rõ").otherwise(F.date_format("o_orderdate", "01/MM/yyyy")), F.lit("\n2. Tien luong: "), F.floor("o_totalprice").cast("long"), F.lit(" USD/tháng\n- Số lượng: "), k % 1000, F.lit(" người\n- Địa điểm làm việc: Kho "), F.col("o_orderpriority"), F.lit("\n\nHết"))
    p = table(spark, sf_dir, "part").repartition(tasks)
    start = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("p_partkey") % 2000).cast("int"))
    chunks = p.select("p_size", F.concat(F.lit("c"), "p_partkey").alias("chunk_id"), F.concat_ws(" ", F.lit("Tiền lương"), "p_name", "p_type").alias("text"), start.alias("effective_from"), F.when(F.col("p_partkey") % 3 == 0, F.date_add(start, 900)).alias("effective_to"))
    scope = [F.when(F.col("p_size") % 4 == 0, "JP").otherwise("VN").alias("jurisdiction"), F.when(F.col("p_size") % 5 == 0, "memo").otherwise("law").alias("doc_type"), (F.col("p_size") % 3).cast("string").alias("reg_set")]
    return o.select(k.alias("doc_id"), text.alias("text")), chunks.select("*", *scope)


RULES = judging.Rules("VN", ("law", "circular"), ("0", "1"), per_field=4, guarantee=1, cap=3, groups=(("wage", "place"), ("people", "day")))
CHECK = CheckSet(CATALOG, required=("day", "wage", "people"), declared=("place",), date_field="day", rules=RULES)


def dossier_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_dossiers(*_forms(spark, sf_dir), CHECK)[1]


def dossier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_dossiers(*_forms(spark, sf_dir), CHECK)[0]


QUERIES = {"dossier_flow": dossier_flow, "dossier_checks": dossier_checks}
SQL: dict[str, str] = {}
