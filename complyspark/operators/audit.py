"""Statistics over the run log.

`runs`: pos (append order), session_id, set_id, set_name, ts (ISO text), pages,
bytes, seconds, stages (map of stage to seconds), documents (array of
struct(verdict, accuracy)). All of it is one partial aggregate and one shuffle on
the group key; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..functions.text import fold_diacritics

VERDICTS = ("PASS", "FAIL", "NEEDS_SUPPLEMENT")
UNKNOWN_SET = "(unknown)"


def verdict(v: Column) -> Column:
    """Whatever is not a verdict of its own counts as a supplement."""
    return F.when(v.isin(*VERDICTS), v).otherwise("NEEDS_SUPPLEMENT")


def set_label(name: Column, set_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(set_id, F.lit("")), F.lit(UNKNOWN_SET))


def verdict_stats(runs: DataFrame, since: str | None = None) -> DataFrame:
    """Verdicts of documents by check set; a run without documents still makes its row."""
    if since:
        runs = runs.filter(F.col("ts") >= since)
    rows = runs.select(set_label(F.col("set_name"), F.col("set_id")).alias("set_label"), F.explode_outer("documents").alias("d"))
    v = verdict(F.col("d.verdict"))
    counts = [F.count_if(F.col("d").isNotNull() & (v == x)).alias(f"n_{x.lower()}") for x in VERDICTS]
    return rows.groupBy("set_label").agg(*counts, F.count("d").alias("n_documents"))


def overall_verdict(v: Column) -> Column:
    """Aggregate: the most severe of a group; nothing at all is a pass."""
    return F.when(F.coalesce(F.bool_or(v == "FAIL"), F.lit(False)), "FAIL").when(F.coalesce(F.bool_or(v == "NEEDS_SUPPLEMENT"), F.lit(False)), "NEEDS_SUPPLEMENT").otherwise("PASS")


def session_rollup(runs: DataFrame, first_day: str | None = None) -> DataFrame:
    """Runs, files, pages, bytes and seconds by session with the last non-empty name, and
    the grand total (session_id null), from unrounded sums."""
    if first_day:
        runs = runs.filter(F.substring("ts", 1, 10) >= first_day)
    # the window of the session's last name comes from the same aggregate
    return runs.rollup("session_id").agg(
        F.count("*").alias("runs"),
        F.sum(F.size("documents")).cast("long").alias("files"),
        F.sum("pages").cast("long").alias("pages"),
        F.sum("bytes").cast("long").alias("bytes"),
        F.round(F.sum("seconds"), 1).alias("seconds"),
        F.max("ts").alias("last_ts"),
        F.max_by(F.col("set_name"), F.when(F.length("set_name") > 0, F.col("pos"))).alias("last_name"),
    )


def derived_rates(rollup: DataFrame) -> DataFrame:
    """Megabytes, seconds a page and a file; null where the denominator is 0."""
    return rollup.select(
        "session_id",
        F.round(F.col("bytes") / 1048576, 2).alias("mb"),
        rate(F.col("seconds"), F.nullif(F.col("pages"), F.lit(0)), 2).alias("s_per_page"),
        rate(F.col("seconds"), F.nullif(F.col("files"), F.lit(0)), 2).alias("s_per_file"),
    )


def latency_percentiles(runs: DataFrame, last: int, digits: int = 3) -> DataFrame:
    """p50 and p95 of all seconds and of each stage over the last runs, by append order."""
    recent = runs.orderBy(F.col("pos").desc()).limit(last)
    rows = recent.select(F.explode(F.map_concat(F.create_map(F.lit("total"), F.col("seconds")), "stages")).alias("stage", "s"))
    return rows.groupBy("stage").agg(F.round(F.percentile("s", 0.5), digits).alias("p50"), F.round(F.percentile("s", 0.95), digits).alias("p95"), F.count("s").alias("n"))


def quality_means(runs: DataFrame, fingerprint: str) -> DataFrame:
    """Means that skip nulls, and how many runs stand on another corpus."""
    return runs.filter(F.col("metrics").isNotNull()).agg(
        F.count("*").alias("runs"),
        F.round(F.avg("metrics.coverage"), 4).alias("coverage"),
        F.round(F.avg("metrics.precision"), 4).alias("precision"),
        F.sum("metrics.citations").cast("long").alias("citations"),
        F.count_if(F.col("fingerprint") != fingerprint).alias("stale"),
    )


def uncovered_top(runs: DataFrame, n: int = 20) -> DataFrame:
    """The fields most often without a passage."""
    return runs.select(F.explode("metrics.uncovered").alias("field")).groupBy("field").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "field").limit(n)


def recent(runs: DataFrame, n: int) -> DataFrame:
    """The newest runs by append order; the count is held between 1 and 2000."""
    return runs.orderBy(F.col("pos").desc()).limit(max(1, min(n, 2000)))


def search(runs: DataFrame, words: str = "", set_key: str = "", has_verdict: str = "", limit: int = 200) -> DataFrame:
    """Runs whose joined columns hold the words, marks ignored, newest first."""
    hay = F.lower(fold_diacritics(F.concat_ws(" ", "session_id", "set_id", "set_name", "ts")))
    cond = F.contains(hay, F.lower(fold_diacritics(F.lit(words)))) if words else F.lit(True)
    if set_key:
        cond = cond & ((F.col("set_id") == set_key) | (F.col("set_name") == set_key))
    if has_verdict:
        cond = cond & F.exists("documents", lambda d: d["verdict"] == has_verdict)
    return recent(runs.filter(cond), limit)


def mean_accuracy(runs: DataFrame, names: list[str]) -> DataFrame:
    """Means of accuracy measures, nulls skipped, 4 digits, and the runs that have one."""
    some = F.coalesce(*[F.col(f"accuracy.{n}") for n in names]).isNotNull()
    return runs.filter(some).agg(F.count("*").alias("runs"), *[F.round(F.avg(f"accuracy.{n}"), 4).alias(n) for n in names])


def section_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("section", "verdict").agg(F.count("*").alias("n"))


def csv_rows(runs: DataFrame) -> DataFrame:
    """One row a run and document, formulas defused, for a CSV sink with quotes."""
    rows = runs.select("session_id", "set_name", "ts", F.explode_outer("documents").alias("d"))
    guard = lambda c: F.regexp_replace(c, r"^([=+\-@\t\r])", "'$1")
    return rows.select(guard(F.col("session_id").cast("string")).alias("session_id"), guard(F.coalesce("set_name", F.lit(""))).alias("set_name"), "ts", guard(F.coalesce("d.verdict", F.lit(""))).alias("verdict"))


def run_metrics(counters: DataFrame) -> DataFrame:
    """Figures of each run from its counters (`run_id, name, n`): cache hits, payload means, retries.
    Shares and means of nothing are null."""
    n = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0))
    hit, miss = n("cache.embed.hit") + n("cache.query.hit"), n("cache.embed.miss") + n("cache.query.miss")
    calls = F.nullif(n("payload.calls"), F.lit(0))
    return counters.groupBy("run_id").agg(
        hit.alias("hit"),
        miss.alias("miss"),
        F.round(F.try_divide(hit, F.nullif(hit + miss, F.lit(0))), 3).alias("hit_ratio"),
        F.floor(n("payload.chars") / 3).alias("tokens_est"),
        F.round(F.try_divide(n("payload.fields"), calls), 1).alias("fields_per_call"),
        F.coalesce(F.sum(F.when(F.startswith("name", F.lit("llm.retry.")), F.col("n"))), F.lit(0)).alias("retry_total"),
    )
