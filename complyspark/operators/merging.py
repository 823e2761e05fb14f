"""Merging the documents of a dossier: first value wins, conflicts, flags, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import golden_normalize
from .verdicts import has_value


def merge_first(fields: DataFrame, empty_is_value: bool = False) -> DataFrame:
    """`dossier, field_key, value, ord`: the first non-missing value by upload order; a key
    whose values are all missing stays with null."""
    present = F.col("value").isNotNull() if empty_is_value else has_value(F.col("value"))
    best = F.min_by(F.when(present, F.struct("value", "ord")), F.when(present, F.col("ord")))
    return fields.groupBy("dossier", "field_key").agg(best.alias("b"), F.min("ord").alias("first_seen")).select("dossier", "field_key", "b.value", F.col("b.ord").alias("source_ord"), "first_seen")


def conflicts(fields: DataFrame) -> DataFrame:
    """Fields whose documents give two values or more, after normalisation."""
    n = golden_normalize(F.col("value"))
    return fields.filter(has_value(F.col("value"))).groupBy("dossier", "field_key").agg(F.count_distinct(n).alias("n_values")).filter("n_values > 1")


def dedupe_flags(flags: DataFrame, date_known: DataFrame | None = None) -> DataFrame:
    """One row a code and message, the first; signing-date flags go where the date is known."""
    out = flags.groupBy("dossier", "code", "message").agg(F.min("ord").alias("ord"))
    if date_known is not None:
        known = date_known.select("dossier").distinct().withColumn("known", F.lit(True))
        out = out.join(known, "dossier", "left").filter(F.col("known").isNull() | ~F.startswith("code", F.lit("SIGNED_DATE"))).drop("known")
    return out


def key_union(fields: DataFrame) -> DataFrame:
    """Keys of a dossier in order of first sight."""
    return fields.groupBy("dossier", "field_key").agg(F.min("ord").alias("first_seen"))


def selected_unseen(selected: DataFrame, seen: DataFrame) -> DataFrame:
    return selected.join(seen, ["dossier", "field_key"], "left_anti")


def unique_labels(catalog: DataFrame) -> DataFrame:
    """Labels (and alternatives) that name one field only."""
    all_labels = catalog.select("field_key", F.explode(F.array_distinct(F.concat(F.array("label"), F.coalesce("label_alts", F.array().cast("array<string>"))))).alias("label")).filter(F.btrim("label") != "")
    once = all_labels.groupBy(F.lower("label").alias("l")).agg(F.count_distinct("field_key").alias("n")).filter("n = 1")
    return all_labels.join(once, F.lower("label") == F.col("l"), "left_semi")


def patch(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual edits by key: the first machine value is kept, edits without a change do nothing."""
    e = edits.select("dossier", "field_key", F.col("value").alias("new"), F.lit(True).alias("given"))
    j = fields.join(e, ["dossier", "field_key"], "left")
    changed = F.coalesce("given", F.lit(False)) & ~F.col("new").eqNullSafe(F.col("value"))
    machine = F.when(changed, F.coalesce("machine", "value")).otherwise(F.col("machine"))
    return j.select("dossier", "field_key", F.when(changed, F.col("new")).otherwise(F.col("value")).alias("value"), machine.alias("machine"), changed.alias("edited"))


def latest_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert semantics: the last row of a key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def sort_by_attention(rows: DataFrame, low: float = 0.5) -> DataFrame:
    """Empty values first, then weak ones, then the rest."""
    rank = F.when(~has_value(F.col("value")), 0).when(F.col("confidence") < low, 1).otherwise(2)
    return rows.withColumn("attention", rank).orderBy("attention", "ord")


def golden_merge(fields: DataFrame) -> DataFrame:
    """`dossier, field_key, value`: the first value by upload order that isn't empty in the sense of golden labels
    (null, '', [], {}; blanks are a value); where all are empty, the last one."""
    filled = F.col("value").isNotNull() & ~F.col("value").isin("", "[]", "{}")
    first = F.min_by(F.when(filled, F.struct("value")), F.when(filled, F.col("ord")))
    return fields.groupBy("dossier", "field_key").agg(F.coalesce(first, F.max_by(F.struct("value"), "ord")).alias("b")).select("dossier", "field_key", "b.value")


def selected_union(documents: DataFrame) -> DataFrame:
    """`dossier, keys`: all keys that any document of a dossier selects (`selected`: array), sorted."""
    return documents.select("dossier", F.explode("selected").alias("k")).groupBy("dossier").agg(F.array_sort(F.collect_set("k")).alias("keys"))
