"""Run-log statistics over `orders` and `lineitem`, which stand in for runs: a session is
a customer, a check set a priority, a verdict an order status, pages are line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..operators import audit as A


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with pages, bytes and seconds summed from their line items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("pages"), F.sum(F.round("l_extendedprice").cast("long")).alias("bytes"), F.round(F.sum("l_quantity"), 1).alias("seconds")
    )
    o = table(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("DECLARATION")
    return o.join(items, o.o_orderkey == items.l_orderkey, "left").select(
        F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").alias("session_id"),
        F.lit("").alias("set_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.substring_index("o_orderpriority", "-", -1)).alias("set_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.coalesce("pages", F.lit(0)).cast("long").alias("pages"),
        F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        F.create_map(F.lit("read"), F.col("o_totalprice"), F.lit("judge"), F.col("o_totalprice") / 2).alias("stages"),
        F.when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<struct<verdict:string>>")).otherwise(F.array(F.struct(verdict.alias("verdict")))).alias("documents"),
    )


RUNS_SQL = """runs AS (SELECT o_orderkey AS pos, o_custkey AS session_id, CASE WHEN o_orderkey % 11 <> 0 THEN split_part(o_orderpriority, '-', 2) END AS set_name,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ts, coalesce(pages, 0) AS pages, coalesce(bytes, 0) AS bytes, coalesce(seconds, 0.0) AS seconds, o_totalprice AS price,
 CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'NEEDS_SUPPLEMENT' END END AS verdict, o_orderstatus
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS pages, sum(CAST(round(l_extendedprice) AS BIGINT)) AS bytes, round(sum(l_quantity), 1) AS seconds FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.verdict_stats(runs(spark, sf_dir))


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.session_rollup(runs(spark, sf_dir), "1995-01-01")


def derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.derived_rates(A.session_rollup(runs(spark, sf_dir), "1995-01-01"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("seconds", F.element_at("stages", F.lit("read")) / 4)
    return A.latency_percentiles(r, 1000, 7)


def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search(runs(spark, sf_dir), "spécified", has_verdict="FAIL", limit=100).select("pos", "session_id", "set_name", "ts")


def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent(runs(spark, sf_dir), 50).select("pos", "session_id", "ts", "pages")


def overall_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select("session_id", F.explode_outer("documents").alias("d"))
    return r.groupBy("session_id").agg(A.overall_verdict(F.col("d.verdict")).alias("overall"))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.csv_rows(runs(spark, sf_dir).withColumn("set_name", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("="), "set_name")).otherwise(F.col("set_name"))))


def verdict_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.verdict_stats(runs(spark, sf_dir))
    return s.select("set_label", rate(F.col("n_pass"), F.nullif(F.col("n_documents"), F.lit(0))).alias("pass_rate"), rate(F.col("n_fail"), F.nullif(F.col("n_documents"), F.lit(0))).alias("fail_rate"))


def quality_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics from `events`: coverage and precision from values, uncovered fields from kinds."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.struct((F.round(F.col("value"), 0) % 5 / 4).alias("coverage"), F.when(k % 3 != 0, k % 10 / 10).alias("precision"), k.alias("citations"), F.when(k % 2 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("uncovered"))
    return e.select(F.when(F.col("event_type") != "error", m).alias("metrics"), F.concat(F.lit("fp"), k % 4).alias("fingerprint"))


def quality_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quality_means(quality_runs(spark, sf_dir), "fp0")


def uncovered_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.uncovered_top(quality_runs(spark, sf_dir), 20)


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select(F.coalesce("set_name", F.lit("")).alias("section"), F.explode("documents").alias("d"))
    return A.section_counts(r.select("section", A.verdict(F.col("d.verdict")).alias("verdict")))


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_STATS = f"""WITH {RUNS_SQL} SELECT coalesce(set_name, '(unknown)') AS set_label, count(*) FILTER (verdict = 'PASS') AS n_pass, count(*) FILTER (verdict = 'FAIL') AS n_fail,
 count(*) FILTER (verdict = 'NEEDS_SUPPLEMENT') AS n_needs_supplement, count(verdict) AS n_documents FROM runs GROUP BY 1"""
_ROLLUP = f"""WITH {RUNS_SQL}, roll AS (SELECT session_id, count(*) AS runs, CAST(count(verdict) AS BIGINT) AS files, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(bytes) AS BIGINT) AS bytes,
 round(sum(seconds), 1) AS seconds, max(ts) AS last_ts, max_by(set_name, CASE WHEN length(set_name) > 0 THEN pos END) AS last_name FROM runs WHERE ts[1:10] >= '1995-01-01' GROUP BY ROLLUP (session_id))"""

QUERIES = {
    "verdict_stats": verdict_stats,
    "verdict_rates": verdict_rates,
    "session_rollup": session_rollup,
    "derived_rates": derived_rates,
    "latency_percentiles": latency_percentiles,
    "audit_search_filter": audit_search,
    "audit_recent_limit": audit_recent,
    "overall_verdict": overall_by_session,
    "csv_explode": csv_rows,
    "quality_means": quality_means,
    "uncovered_top20": uncovered_top,
    "section_counts": section_counts,
}
SQL = {
    "verdict_stats": _STATS,
    "verdict_rates": f"SELECT set_label, round(n_pass / nullif(n_documents, 0), 4) AS pass_rate, round(n_fail / nullif(n_documents, 0), 4) AS fail_rate FROM ({_STATS})",
    "session_rollup": _ROLLUP + " SELECT * FROM roll",
    "derived_rates": _ROLLUP + " SELECT session_id, round(bytes / 1048576, 2) AS mb, round(seconds / nullif(pages, 0), 2) AS s_per_page, round(seconds / nullif(files, 0), 2) AS s_per_file FROM roll",
    "latency_percentiles": f"""WITH {RUNS_SQL}, last AS (SELECT * FROM runs ORDER BY pos DESC LIMIT 1000), s AS (SELECT 'total' AS stage, price / 4 AS s FROM last UNION ALL SELECT 'read', price FROM last UNION ALL SELECT 'judge', price / 2 FROM last)
 SELECT stage, round(quantile_cont(s, 0.5), 7) AS p50, round(quantile_cont(s, 0.95), 7) AS p95, count(s) AS n FROM s GROUP BY 1""",
    "audit_search_filter": f"WITH {RUNS_SQL} SELECT pos, session_id, set_name, ts FROM runs WHERE set_name = 'NOT SPECIFIED' AND verdict = 'FAIL' ORDER BY pos DESC LIMIT 100",
    "audit_recent_limit": f"WITH {RUNS_SQL} SELECT pos, session_id, ts, CAST(pages AS BIGINT) AS pages FROM runs ORDER BY pos DESC LIMIT 50",
    "overall_verdict": """SELECT o_custkey AS session_id, CASE WHEN bool_or(v = 'FAIL') THEN 'FAIL' WHEN bool_or(v = 'NEEDS_SUPPLEMENT') THEN 'NEEDS_SUPPLEMENT' ELSE 'PASS' END AS overall
 FROM (SELECT o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'DECLARATION' END END AS v FROM orders) GROUP BY 1""",
    "csv_explode": f"""WITH {RUNS_SQL} SELECT CAST(session_id AS VARCHAR) AS session_id, coalesce(CASE WHEN pos % 5 = 0 THEN '''=' || set_name ELSE set_name END, '') AS set_name, ts,
 CASE WHEN verdict = 'NEEDS_SUPPLEMENT' THEN 'DECLARATION' ELSE coalesce(verdict, '') END AS verdict FROM runs""",
    "quality_means": f"""SELECT count(*) AS runs, round(avg(round(value, 0) % 5 / 4), 4) AS coverage, round(avg(CASE WHEN k % 3 <> 0 THEN k % 10 / 10 END), 4) AS "precision", CAST(sum(k) AS BIGINT) AS citations, count(*) FILTER (k % 4 <> 0) AS stale
 FROM (SELECT *, {_K} AS k FROM events WHERE event_type <> 'error')""",
    "uncovered_top20": f"SELECT event_type AS field, count(*) AS runs FROM events WHERE event_type <> 'error' AND {_K} % 2 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "section_counts": f"WITH {RUNS_SQL} SELECT coalesce(set_name, '') AS section, verdict, count(*) AS n FROM runs WHERE verdict IS NOT NULL GROUP BY 1, 2",
}
