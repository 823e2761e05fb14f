"""Model values against the text they claim to come from, requests to the model, cache keys.

A model's field is taken only if every guard holds; each guard is a boolean column, so
a report can say which one refused. Similarity needs difflib, hence one Arrow UDF."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import CURRENCIES, coerce_typed
from ..functions.text import accent_fold, fold_diacritics, golden_normalize
from .verdicts import has_value

MODEL_CONFIDENCE_CAP = 0.7
# Answers that stand for no answer (folded, letters and digits only).
PLACEHOLDERS = ("na", "none", "null", "khongco", "khongro", "khongxacdinh", "chuaxacdinh", "unknown")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def coverage(part: pd.Series, whole: pd.Series) -> pd.Series:
    """Share of the characters of `part` in blocks that `whole` has too."""

    def one(p: str | None, w: str | None) -> float:
        if not p:
            return 0.0
        return sum(m.size for m in difflib.SequenceMatcher(None, p, w or "", autojunk=False).get_matching_blocks()) / len(p)

    return pd.Series([one(p, w) for p, w in zip(part, whole, strict=True)])


def is_placeholder(v: Column) -> Column:
    return accent_fold(v).isin(*PLACEHOLDERS)


def digit_runs(v: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(v, F.lit(r"\d[\d.,]*"), 0), lambda t: F.regexp_replace(t, r"[^0-9]", "")), lambda t: t != "")


def digits_supported(v: Column, evidence: Column) -> Column:
    """Every run of digits of a value is in the digits of its evidence."""
    digits = F.regexp_replace(evidence, r"[^0-9]", "")
    return F.forall(digit_runs(v), lambda t: F.contains(digits, t))


def evidence_window(text: Column, quote: Column, value: Column, around: int = 120) -> Column:
    """Text around the quote, else around the first 24 characters of the value, else ''."""
    low = F.lower(text)
    at = F.coalesce(F.nullif(F.instr(low, F.lower(quote)), F.lit(0)), F.nullif(F.instr(low, F.lower(F.substring(value, 1, 24))), F.lit(0)))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at.isNull(), "").otherwise(F.substring(text, start, at - start + F.greatest(F.length(quote), F.length(value)) + around))


def respell_ok(new: Column, old: Column) -> Column:
    """A new spelling keeps digits, doesn't grow much, and stays alike."""
    return digit_runs(new).eqNullSafe(digit_runs(old)) & (F.length(new) <= F.greatest(F.lit(24), (F.length(old) * 1.6).cast("int"))) & (ratio(F.lower(fold_diacritics(new)), F.lower(fold_diacritics(old))) >= 0.6)


def grounded(value: Column, kind: Column, window: Column) -> Column:
    """By type: digits of numbers and money, parts of dates, nearly all characters of text."""
    parts = F.forall(F.split(value, "-"), lambda p: F.contains(F.regexp_replace(window, r"[^0-9]", ""), F.regexp_replace(p, "^0", "")))
    return F.when(kind == "date", parts).when(kind.isin("number", "money"), digits_supported(value, window)).otherwise(coverage(golden_normalize(value), golden_normalize(window)) >= 0.9)


def guard_columns(fields: DataFrame, model: DataFrame, least: float = 0.3) -> DataFrame:
    """`fields` (doc_id, field_key, value, kind, text) joined to a model's answers (value,
    quote, confidence) with one column a guard."""
    m = model.select("doc_id", "field_key", F.col("value").alias("new"), "quote", F.col("confidence").alias("sure"))
    j = fields.join(m, ["doc_id", "field_key"], "left")
    typed = coerce_typed(F.col("new"), F.col("kind"))
    window = evidence_window(F.col("text"), F.coalesce("quote", F.lit("")), F.coalesce("new", F.lit("")))
    j = j.withColumn("typed", typed).withColumn("window", window)
    return (
        j.withColumn("g_missing", ~has_value(F.col("value")))
        .withColumn("g_answer", has_value(F.col("typed")) & ~is_placeholder(F.col("new")))
        .withColumn("g_shape", (F.col("kind") != "text") | ~F.rlike(F.coalesce("new", F.lit("")), F.lit(rf"(?iu)^\s*\d[\d.,\s]*({CURRENCIES})\s*$")))
        .withColumn("g_evidence", F.col("window") != "")
        .withColumn("g_grounded", F.coalesce(grounded(F.col("typed"), F.col("kind"), F.col("window")), F.lit(False)))
        .withColumn("g_sure", F.coalesce("sure", F.lit(0.0)) >= least)
    )


def merge_model(fields: DataFrame, model: DataFrame, least: float = 0.3) -> DataFrame:
    """Missing fields filled with answers that pass every guard, confidence capped; read values stay."""
    g = guard_columns(fields, model, least)
    names = [c for c in g.columns if c.startswith("g_")]
    take = F.lit(True)
    for c in names:
        take = take & F.coalesce(c, F.lit(False))
    refused = F.get(F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(c)) for c in names]), lambda x: x.isNotNull()), 0)
    return g.select("doc_id", "field_key", F.when(take, F.col("typed")).otherwise(F.col("value")).alias("value"), F.when(take, F.least(F.lit(MODEL_CONFIDENCE_CAP), "sure")).alias("model_confidence"), F.when(F.col("new").isNotNull(), refused).alias("refused"))


def requests(fields: DataFrame, chunks: DataFrame, chunk_chars: int = 600) -> DataFrame:
    """`doc_id, request`: JSON with the fields to judge and their passages, cut and in
    stable order; the part that all requests share comes first."""
    passages = F.array_sort(F.collect_set(F.struct("chunk_id", F.substring("text", 1, chunk_chars).alias("text"))))
    c = chunks.groupBy("doc_id").agg(passages.alias("regulations"))
    f = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list("field_key")).alias("fields"))
    return f.join(c, "doc_id", "left").select("doc_id", F.to_json(F.struct("regulations", "fields")).alias("request"))


def cache_keys(files: DataFrame, set_hash: str) -> DataFrame:
    """A key of a dossier's files in any order and its check set."""
    return files.groupBy("dossier").agg(F.sha2(F.concat_ws("|", F.array_join(F.array_sort(F.collect_list("sha256")), "|"), F.lit(set_hash)), 256).alias("cache_key"))


def request_signature(prompt_version: str, fingerprint: Column, day: Column, fields: Column) -> Column:
    return F.sha2(F.concat_ws("#", F.lit(prompt_version), fingerprint, F.coalesce(day, F.lit("")), F.array_join(F.array_sort(fields), ",")), 256)


def display_value(value: Column, amount: Column, currency: Column, period: Column, raw: Column) -> Column:
    """Text of a value for a report: the raw money text first, then amount, currency and period."""
    money = F.concat_ws(" ", F.format_number(amount, 0), currency, F.when(period.isNotNull(), F.concat(F.lit("/ "), period)))
    return F.coalesce(F.nullif(raw, F.lit("")), F.when(amount.isNotNull(), money), value, F.lit("—"))


def _with_words(quotes: DataFrame) -> DataFrame:
    """Quotes folded (`low_quote`) and their words, once a quote."""
    low = quotes.withColumn("low_quote", F.lower(fold_diacritics(F.col("quote"))))
    return low.withColumn("words", F.filter(F.split("low_quote", "[^a-z0-9]+"), lambda w: F.length(w) >= 2))


def best_line(lines: DataFrame, quotes: DataFrame, least: int = 2) -> DataFrame:
    """The line of each document that holds most words of a quote (all of it: one more)."""
    return _best(lines.join(_with_words(quotes), "doc_id"), least)


def best_own_line(docs: DataFrame, quote: Column, least: int = 2) -> DataFrame:
    """`best_line` for a quote that is drawn from each document (`doc_id`, `text`): lines and quote are in one row, so lines are not
    joined to quotes. Ids that several documents have are: each of their quotes meets the lines of all of them."""
    own = docs.select("doc_id", F.col("text").alias("_text"), quote.alias("quote"))
    lines = lambda d, *more: d.select("doc_id", *more, F.posexplode(F.split("_text", "\n")).alias("line_no", "text"))
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    apart = lines(_with_words(own.join(repeated, "doc_id", "left_anti")), "quote", "low_quote", "words")
    shared = own.join(repeated, "doc_id", "left_semi")
    return _best(apart, least).unionByName(best_line(lines(shared), shared.select("doc_id", "quote"), least))


def _best(j: DataFrame, least: int) -> DataFrame:
    """The best line of each quote. A line is folded once, not for each word, and scored once: a filter on the score would repeat it."""
    hits = lambda t: F.size(F.filter(F.col("words"), lambda w: F.contains(t, w)))
    score = F.transform(F.array(F.lower(fold_diacritics(F.col("text")))), lambda t: F.when(F.contains(t, F.col("low_quote")), F.size("words") + 1).otherwise(hits(t)))
    placed = F.get(F.transform(score, lambda n: F.when(n >= least, F.struct(n.alias("score"), (-F.col("line_no")).alias("place")))), 0)
    best = j.groupBy("doc_id", "quote").agg(F.max(placed).alias("best")).filter("best is not null")
    return best.select("doc_id", "quote", (-F.col("best.place")).alias("line_no"), F.col("best.score").alias("score"))
