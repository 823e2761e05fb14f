"""From model judgements to verdicts: one left join from the checked fields, then named
stages whose order matters (branch, quality gate, mandatory, one-of, citations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import check_positive_integer

SEVERITY = {"FAIL": 0, "NEEDS_SUPPLEMENT": 1, "PASS": 2, "DECLARATION": 3}


def has_value(value: Column, amount: Column | None = None, raw: Column | None = None) -> Column:
    """0 is a value; blank text and an amount without number and text are none."""
    text = value.isNotNull() & (F.btrim(value.cast("string")) != "")
    if amount is None:
        return text
    return text | amount.isNotNull() | F.coalesce(F.btrim(raw) != "", F.lit(False))


def checked_fields(fields: DataFrame) -> DataFrame:
    """Declarations always; others with a value that are required or selected."""
    present = has_value(F.col("value"))
    return fields.filter((F.col("check_type") == "declaration") | (present & (F.col("required") | F.col("selected"))))


def first_judgement(model: DataFrame) -> DataFrame:
    """The first row of a key wins."""
    w = Window.partitionBy("doc_id", "field_key").orderBy("ord")
    return model.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "ord")


def reconcile(fields: DataFrame, model: DataFrame) -> DataFrame:
    """`doc_id, field_key, verdict, made_by_model, citations` of every checked field.

    A declaration is taken as it is, a number is checked by rule, all else stands on
    the model's first judgement; none is a supplement."""
    j = checked_fields(fields).join(first_judgement(model), ["doc_id", "field_key"], "left")
    by_rule = check_positive_integer(F.col("value"))["verdict"]
    verdict = F.when(F.col("check_type") == "declaration", "DECLARATION").when(F.col("check_type") == "positive_integer", by_rule).otherwise(F.coalesce("model_verdict", F.lit("NEEDS_SUPPLEMENT")))
    return j.select("doc_id", "field_key", verdict.alias("verdict"), (F.col("check_type") == "regulated").alias("made_by_model"), F.coalesce("citations", F.lit(0)).alias("citations"), F.lit(False).alias("mandatory"))


def quality_gate(checks: DataFrame, blocked: DataFrame) -> DataFrame:
    """A verdict on a field that the input blocks becomes a supplement."""
    b = blocked.select("doc_id", "field_key").distinct().withColumn("blocked", F.lit(True))
    hit = F.coalesce("blocked", F.lit(False)) & F.col("verdict").isin("PASS", "FAIL")
    return checks.join(b, ["doc_id", "field_key"], "left").withColumn("verdict", F.when(hit, "NEEDS_SUPPLEMENT").otherwise(F.col("verdict"))).drop("blocked")


def mandatory_missing(checks: DataFrame, fields: DataFrame, missing_is_fail: bool) -> DataFrame:
    """Rows for required fields without a value that have no check yet."""
    need = fields.filter(F.col("required") & ~has_value(F.col("value"))).select("doc_id", "field_key")
    new = need.join(checks, ["doc_id", "field_key"], "left_anti").select(
        "doc_id", "field_key", F.lit("FAIL" if missing_is_fail else "NEEDS_SUPPLEMENT").alias("verdict"), F.lit(False).alias("made_by_model"), F.lit(0).alias("citations"), F.lit(True).alias("mandatory")
    )
    return checks.unionByName(new)


def required_one_of(checks: DataFrame, fields: DataFrame, groups: DataFrame) -> DataFrame:
    """A row `one_of_<first>` for each group (group_id, field_key, pos) none of whose fields has a value."""
    g = groups.join(fields.select("doc_id", "field_key", has_value(F.col("value")).alias("has")), "field_key")
    none = g.groupBy("doc_id", "group_id").agg(F.bool_or("has").alias("any"), F.min_by("field_key", "pos").alias("first")).filter(~F.col("any"))
    new = none.select("doc_id", F.concat(F.lit("one_of_"), "first").alias("field_key"), F.lit("NEEDS_SUPPLEMENT").alias("verdict"), F.lit(False).alias("made_by_model"), F.lit(0).alias("citations"), F.lit(True).alias("mandatory"))
    return checks.unionByName(new)


def no_citation(checks: DataFrame) -> DataFrame:
    """A model's pass, or any fail, without a citation becomes a supplement; mandatory rows are exempt."""
    hit = ~F.col("mandatory") & (F.col("citations") == 0) & ((F.col("made_by_model") & (F.col("verdict") == "PASS")) | (F.col("made_by_model") & (F.col("verdict") == "FAIL")))
    return checks.withColumn("verdict", F.when(hit, "NEEDS_SUPPLEMENT").otherwise(F.col("verdict")))


def completeness(fields: DataFrame) -> DataFrame:
    need = fields.filter("required")
    gone = ~has_value(F.col("value"))
    return need.groupBy("doc_id").agg(F.count("*").alias("required_total"), F.count_if(gone).alias("required_missing"), (F.count_if(gone) == 0).alias("is_complete"))


def severity(v: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), v)


def merge_checks(checks: DataFrame) -> DataFrame:
    """One row a check over several documents: the most severe, in order of first sight."""
    return checks.groupBy("check_id").agg(F.min_by("verdict", F.struct(severity(F.col("verdict")), F.col("ord"))).alias("verdict"), F.min("ord").alias("first_seen"))


def input_flags(stats: DataFrame, empty_lines: int = 1, low_conf: float = 0.6, many_low: int = 10) -> DataFrame:
    """Flags of reading: empty stands alone; else blurry or low confidence, and many weak lines."""
    empty = F.col("num_lines") < empty_lines
    flags = F.filter(
        F.array(
            F.when(empty, "EMPTY_TEXT"),
            F.when(~empty & (F.col("avg_confidence") < low_conf / 2), "BLURRY"),
            F.when(~empty & (F.col("avg_confidence") >= low_conf / 2) & (F.col("avg_confidence") < low_conf), "LOW_CONFIDENCE"),
            F.when(~empty & (F.col("low_lines") > many_low), "MANY_LOW_LINES"),
        ),
        lambda x: x.isNotNull(),
    )
    return stats.select("doc_id", F.explode(flags).alias("code"))


def signed_date_flag(day: Column, today: Column, earliest: str, ahead: int = 2) -> Column:
    """missing, invalid, future (more than `ahead` days) or too old, else null."""
    d = F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd")
    return (
        F.when(day.isNull() | (day == ""), "SIGNED_DATE_MISSING")
        .when(d.isNull(), "SIGNED_DATE_INVALID")
        .when(F.datediff(d, today) > ahead, "SIGNED_DATE_FUTURE")
        .when(d < F.lit(earliest).cast("date"), "SIGNED_DATE_TOO_OLD")
    )


def blocking_fields(flags: DataFrame) -> DataFrame:
    """The first blocking flag of each field."""
    return flags.filter("block_field is not null").groupBy("doc_id", "block_field").agg(F.min_by("code", "ord").alias("code"))


def report(checks: DataFrame) -> DataFrame:
    """Verdict and violations of each document; none regulated forces a supplement."""
    from .audit import overall_verdict

    r = checks.groupBy("doc_id").agg(
        overall_verdict(F.col("verdict")).alias("overall"), F.count_if("made_by_model").alias("regulated"), F.count_if(F.col("verdict") == "FAIL").alias("violations"), F.count("*").alias("checks")
    )
    return r.withColumn("overall", F.when((F.col("regulated") == 0) & (F.col("overall") == "PASS"), "NEEDS_SUPPLEMENT").otherwise(F.col("overall")))


def checkable(fields: DataFrame) -> DataFrame:
    """How many of a dossier's fields can be checked (all but declarations), and how many of these have a value."""
    own = fields.filter(F.col("check_type") != "declaration")
    return own.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(has_value(F.col("value"))).alias("checked"))


def attention_filter(rows: DataFrame, which: str, low: float = 0.5) -> DataFrame:
    """Fields of a review: `empty`, `has`, `lowconf`, or all."""
    has = has_value(F.col("value"))
    cond = {"empty": ~has, "has": has, "lowconf": has & (F.col("confidence") < low)}
    return rows.filter(cond[which]) if which in cond else rows


def selected_but_empty(checks: DataFrame, fields: DataFrame) -> DataFrame:
    """`checks` with a row NEEDS_SUPPLEMENT for every selected field without a value that has none yet."""
    empty = fields.filter(F.col("selected") & ~has_value(F.col("value"))).select("doc_id", "field_key").distinct()
    new = empty.join(checks.select("doc_id", "field_key"), ["doc_id", "field_key"], "left_anti").withColumn("verdict", F.lit("NEEDS_SUPPLEMENT"))
    return checks.select("doc_id", "field_key", "verdict").unionByName(new)


def overall(checks: DataFrame, fields: DataFrame, *more: Column) -> DataFrame:
    """`doc_id, overall_verdict, asked`: the worst verdict of a dossier, where declarations don't count. A dossier
    without a regulated field that has a value was never held against a regulation: it needs supplement and
    carries the flag NO_REGULATED_FIELDS. `more`: aggregates of its checks, in columns behind these."""
    asked = fields.groupBy("doc_id").agg((F.count_if((F.col("check_type") == "regulated") & has_value(F.col("value"))) > 0).alias("asked"))
    worst = checks.groupBy("doc_id").agg(F.bool_or(F.col("verdict") == "FAIL").alias("fail"), F.bool_or(F.col("verdict") == "NEEDS_SUPPLEMENT").alias("needs"), *more)
    j = asked.join(worst, "doc_id", "left")
    verdict = F.when(F.coalesce("fail", F.lit(False)), "FAIL").when(F.coalesce("needs", F.lit(False)) | ~F.col("asked"), "NEEDS_SUPPLEMENT").otherwise("PASS")
    return j.select("doc_id", verdict.alias("overall_verdict"), "asked", F.when(~F.col("asked"), "NO_REGULATED_FIELDS").alias("flag"), *worst.columns[3:])
