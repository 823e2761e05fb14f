"""The judging of dossiers: scope and day of each, passages of its fields, judgements, verdicts, report.

Queries of a check set differ by field only, so a field's distances to the passages are had once whatever the number of
dossiers; what a dossier adds is its day. Dossiers with equal fields to ask about and equal days are one case: passages are chosen,
and a model is asked, once a case, for its first dossier. All dossiers of a set are one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cuts import written
from . import grounding, retrieval, verdicts


@dataclass(frozen=True)
class Rules:
    """How passages are chosen and verdicts drawn. `groups`: fields of which one must have a value."""

    jurisdiction: str | None = None
    doc_types: tuple[str, ...] = ()
    sets: tuple[str, ...] = ()
    per_field: int = 4
    guarantee: int = 2
    cap: int = 8
    missing_is_fail: bool = False
    groups: tuple[tuple[str, ...], ...] = ()


def in_scope(passages: DataFrame, rules: Rules) -> DataFrame:
    """Passages (chunk_id, text, effective_from, effective_to and, as far as the rules name them, jurisdiction, doc_type, reg_set) of the rules' scope."""
    return passages.filter(retrieval.scope(rules.jurisdiction, list(rules.doc_types), list(rules.sets)))


def passages_of(asked: DataFrame, near: DataFrame, rules: Rules) -> DataFrame:
    """`doc_id, key, chunk_id, distance, must, found`: the passages sent with each dossier.

    `asked`: doc_id, field_key, field_ord, day of every regulated field with a value; `near`: field_key, chunk_id, text_key, distance, effective_from,
    effective_to in scope, where equal texts have equal keys. Each field's `per_field` nearest that are in force on the day (if none of the scope is: of all), its
    first `guarantee` for sure, others by distance up to `cap` texts of the dossier."""
    days = asked.select("day").distinct()
    top = retrieval.valid_top_k(days, near.drop("text_key"), rules.per_field, by=("field_key",), cut=written)
    keys = near.select("chunk_id", "text_key").distinct()
    known = F.coalesce("day", F.lit(retrieval.FIRST_DAY).cast("date"))
    top = top.join(keys, "chunk_id").select("field_key", known.alias("_day"), "chunk_id", F.col("text_key").alias("text"), "distance", (F.col("rank") - 1).alias("i"))
    hits = asked.withColumn("_day", known).join(top, ["field_key", "_day"]).drop("_day", "day")
    return retrieval.guaranteed(hits, rules.guarantee, rules.cap, "doc_id")


def asked_fields(fields: DataFrame) -> DataFrame:
    """Regulated fields with a value that are required or selected: what a model is asked about."""
    return verdicts.checked_fields(fields).filter(F.col("check_type") == "regulated")


def cases(with_day: DataFrame) -> DataFrame:
    """`doc_id, lead`: the first dossier of each one's case. `with_day`: doc_id, field_key, day of what a model is asked about."""
    own = with_day.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field_key", F.col("day").isNull().alias("open"), F.coalesce("day", F.lit(retrieval.FIRST_DAY).cast("date")).alias("day")))).alias("case"))
    return own.join(own.groupBy("case").agg(F.min("doc_id").alias("lead")), "case").select("doc_id", "lead")


def of_all(led: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the first dossiers of cases, for all dossiers."""
    return led.join(rows.withColumnRenamed("doc_id", "lead"), "lead").select(rows.columns)


def requests_of(asked: DataFrame, sent: DataFrame, passages: DataFrame) -> DataFrame:
    """`doc_id, request`: one request a dossier, its fields with the passages sent."""
    texts = sent.select("doc_id", "chunk_id").join(passages.select("chunk_id", "text"), "chunk_id").select("doc_id", "chunk_id", "text")
    return grounding.requests(asked.select("doc_id", "field_key"), texts)


def concluded(fields: DataFrame, judged: DataFrame, blocked: DataFrame, rules: Rules) -> DataFrame:
    """`doc_id, field_key, verdict, made_by_model, citations, mandatory` of all checks: the stages of reconciling in their order, then selected fields
    that have no value. `judged`: doc_id, ord, field_key, model_verdict, citations. Judged fields are written, as each later stage reads them."""
    checks = written(verdicts.quality_gate(verdicts.reconcile(fields, judged), blocked))
    checks = verdicts.mandatory_missing(checks, fields, rules.missing_is_fail)
    if rules.groups:
        rows = [(g, k, n) for g, group in enumerate(rules.groups) for n, k in enumerate(group)]
        checks = verdicts.required_one_of(checks, fields, fields.sparkSession.createDataFrame(rows, "group_id int, field_key string, pos int"))
    checks = verdicts.no_citation(checks)
    more = verdicts.selected_but_empty(checks, fields).join(checks.select("doc_id", "field_key"), ["doc_id", "field_key"], "left_anti")
    return checks.unionByName(more.select("doc_id", "field_key", "verdict", F.lit(False).alias("made_by_model"), F.lit(0).alias("citations"), F.lit(False).alias("mandatory")))


def reported(checks: DataFrame, fields: DataFrame) -> DataFrame:
    """`doc_id, overall_verdict, flag, regulated, violations, checks` of every dossier with a field."""
    counts = F.count_if("made_by_model").alias("regulated"), F.count_if(F.col("verdict") == "FAIL").alias("violations"), F.count("*").alias("checks")
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("regulated", "violations", "checks")]
    return verdicts.overall(checks, fields, *counts).select("doc_id", "overall_verdict", "flag", *none)


def judge(fields: DataFrame, days: DataFrame, near: DataFrame, passages: DataFrame, rules: Rules, ask: Callable[[DataFrame], DataFrame], blocked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checks, report, sent) of all dossiers. `fields` as `verdicts.checked_fields` takes them; `days`: doc_id, day; `ask` gets requests and gives judgements
    (doc_id, ord, field_key, model_verdict), a request a case under its first dossier; `blocked`: doc_id, field_key whose verdict the input forbids."""
    with_day = asked_fields(fields).select("doc_id", "field_key").join(days, "doc_id", "left")
    led = written(cases(with_day))
    asked = written(with_day.join(led.filter("doc_id = lead").select("doc_id"), "doc_id", "left_semi"))
    order = asked.select("field_key").distinct().select("field_key", F.row_number().over(Window.orderBy("field_key")).alias("field_ord"))  # a row a field of the check set
    sent = written(passages_of(asked.join(order, "field_key"), near, rules))
    judged = written(ask(requests_of(asked, sent, passages)))  # a model is asked once
    cited = retrieval.field_ranks(sent, "doc_id").groupBy("doc_id", "field_key").agg(F.count("*").alias("citations"))  # a field cites what was sent for it
    checks = concluded(fields, of_all(led, written(judged.join(cited, ["doc_id", "field_key"], "left"))), blocked, rules)
    return checks, reported(checks, fields), of_all(led, sent)

