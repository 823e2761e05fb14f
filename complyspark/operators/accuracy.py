"""Accuracy of reading and of golden labels, micro-averaged from sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate, values_match
from ..functions.text import word_edit_distance


def machine_value(value: Column, has_machine: Column, machine: Column) -> Column:
    """The machine's value if an edit stored one (a stored null counts), else the current one."""
    return F.when(has_machine, machine).otherwise(value)


def run_accuracy(pairs: DataFrame) -> DataFrame:
    """CER, WER and shares by kind over `ref`, `hyp`, `value_type`, `in_table`, `edited`; rows
    with both sides empty are left out; shares of nothing are null."""
    p = pairs.select(F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp"), "value_type", "in_table", "edited").filter("ref <> '' or hyp <> ''")
    ok = F.col("ref") == F.col("hyp")
    share = lambda cond: rate(F.count_if(cond & ok), F.nullif(F.count_if(cond), F.lit(0)))
    words = F.size(F.filter(F.split("ref", r"\s+"), lambda w: w != ""))
    cer = F.round(F.try_divide(F.sum(F.levenshtein("hyp", "ref")), F.nullif(F.sum(F.length("ref")), F.lit(0))), 4)
    out = p.agg(
        cer.alias("cer"),
        F.round(F.try_divide(F.sum(word_edit_distance(F.col("hyp"), F.col("ref"))), F.nullif(F.sum(words), F.lit(0))), 4).alias("wer"),
        share(F.lit(True)).alias("field_accuracy"),
        share(F.col("value_type").isin("number", "money")).alias("number_accuracy"),
        share(F.col("value_type") == "date").alias("date_accuracy"),
        share(F.col("in_table")).alias("table_accuracy"),
        F.count("*").alias("fields"),
        F.count_if(F.col("edited") & ~ok).alias("fields_edited"),
    )
    return out.withColumn("ocr_accuracy", F.greatest(F.lit(0.0), 1 - F.col("cer")))


def extraction_accuracy(golden: DataFrame, produced: DataFrame) -> DataFrame:
    """Matches of golden labels by case; a label without a value that got one is wrong."""
    j = golden.join(produced, ["case_id", "field_key"], "left")
    return j.groupBy("case_id").agg(F.count("*").alias("labels"), F.count_if(values_match(F.col("expected"), F.col("actual"))).alias("correct"))


def recall_at_k(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Distinct expected ids found, over all cases (sums, not a mean of ratios)."""
    e = expected.select("case_id", "chunk_id").distinct()
    hit = e.join(got.select("case_id", "chunk_id").distinct().withColumn("hit", F.lit(1)), ["case_id", "chunk_id"], "left")
    return hit.agg(F.count("*").alias("expected"), F.count("hit").alias("found"), rate(F.count("hit"), F.nullif(F.count("*"), F.lit(0))).alias("recall"))


def golden_summary(cases: DataFrame) -> DataFrame:
    """Micro-average over verified cases that have artefacts; others are counted."""
    ok = F.col("verified") & F.col("labels").isNotNull()
    return cases.agg(
        F.count_if(~F.col("verified")).alias("unverified"),
        F.count_if(ok).alias("measured"),
        rate(F.sum(F.when(ok, F.col("correct"))), F.nullif(F.sum(F.when(ok, F.col("labels"))), F.lit(0))).alias("accuracy"),
    )


def citation_sources(expected: DataFrame, cited: DataFrame) -> DataFrame:
    """Whether any expected source name is among a check's cited ones, after normalisation."""
    from ..functions.text import accent_fold

    e = expected.select("case_id", "check_id", accent_fold(F.col("source")).alias("s"))
    c = cited.select("case_id", "check_id", accent_fold(F.col("source")).alias("s")).distinct().withColumn("hit", F.lit(True))
    j = e.join(c, ["case_id", "check_id", "s"], "left").groupBy("case_id", "check_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("ok"))
    return j.agg(F.count("*").alias("checks"), F.count_if("ok").alias("correct"), rate(F.count_if("ok"), F.nullif(F.count("*"), F.lit(0))).alias("accuracy"))
