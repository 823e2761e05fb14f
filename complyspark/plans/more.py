"""Further queries: totals, windows of pages, condensed clauses, attention order, regions, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A
from ..operators import merging as M
from ..operators import pages as P
from ..sources import files as S
from .audit import RUNS_SQL, runs, table


def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by check set with the grand total (set null)."""
    r = runs(spark, sf_dir).select(A.set_label(F.col("set_name"), F.col("set_id")).alias("set_label"), F.explode("documents").alias("d"))
    v = A.verdict(F.col("d.verdict"))
    return r.rollup("set_label").agg(F.count("*").alias("documents"), F.count_if(v == "FAIL").alias("fails"))


def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages: from the first with a start anchor to the next with an end anchor."""
    p = P.lines(table(spark, sf_dir, "documents")).withColumnRenamed("line_no", "page_index")
    return P.page_window(p, ["que", "the"], ["der", "ion"]).groupBy("doc_id").agg(F.count("*").alias("pages"), F.min("page_index").cast("long").alias("first"))


def condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = X.condense_clause(F.col("text"), ["the", "que"], 300)
    return d.select("doc_id", c.alias("clause"), (F.length(c) <= 300).alias("fits"))


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields of each kind of attention a dossier has."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("value"), (1 - F.col("l_discount") * 8).alias("confidence"), F.col("l_linenumber").alias("ord"))
    return M.sort_by_attention(l).groupBy("doc_id", "attention").agg(F.count("*").alias("n"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from JSON; corners in any order, slivers and broken ones dropped."""
    k = F.col("p_partkey")
    j = F.concat(F.lit('{"1": ['), k % 10 / 10, F.lit(", 0.9, "), F.lit(1.5), F.lit(', 0.2], "2": [0.1, 0.1, 0.105, 0.9], "3": [1]}'))
    r = P.regions(j)["1"]
    return table(spark, sf_dir, "part").select("p_partkey", r[0].alias("x0"), r[1].alias("y0"), r[2].alias("x1"), r[3].alias("y1"))


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("c_name"))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    i = F.when(F.col("c_custkey") % 3 == 0, F.upper(uuid)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("../"), uuid)).otherwise(uuid)
    return table(spark, sf_dir, "customer").select("c_custkey", S.valid_session(i).alias("valid"))


def foreign_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with foreign script mixed in: lines of it go, single characters are blanked."""
    k = F.col("p_partkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("日本語の条項です "), F.substring("p_name", 1, 3))).when(k % 3 == 1, F.concat(F.col("p_name"), F.lit("円/月"))).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(k.alias("doc_id"), t.alias("text"))
    return P.own_script(rows)


QUERIES = {
    "verdict_totals_rollup": verdict_totals,
    "page_window": page_window,
    "sentence_condense": condensed,
    "attention_order": attention,
    "region_rectangles": regions,
    "session_ids": session_ids,
    "foreign_lines": foreign_lines,
}
SQL = {
    "verdict_totals_rollup": f"WITH {RUNS_SQL}, v AS (SELECT coalesce(set_name, '(unknown)') AS set_label, verdict FROM runs WHERE verdict IS NOT NULL) SELECT set_label, count(*) AS documents, count(*) FILTER (verdict = 'FAIL') AS fails FROM v GROUP BY ROLLUP (set_label)",
    "page_window": """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), k AS (SELECT *, lower(regexp_replace(strip_accents(replace(replace(t, 'đ', 'd'), 'Đ', 'D')), '[^0-9A-Za-z]', '', 'g')) AS a FROM l),
 f AS (SELECT *, min(CASE WHEN contains(a, 'que') OR contains(a, 'the') THEN i END) OVER (PARTITION BY doc_id) AS s FROM k), g AS (SELECT *, min(CASE WHEN (contains(a, 'der') OR contains(a, 'ion')) AND i > coalesce(s, -1) THEN i END) OVER (PARTITION BY doc_id) AS e FROM f)
 SELECT doc_id, count(*) AS pages, min(i) AS first FROM g WHERE ((s IS NULL OR i >= s) AND (e IS NULL OR i <= e)) OR trim(t) = '' GROUP BY 1""",
    "attention_order": "SELECT l_orderkey AS doc_id, CAST(CASE WHEN NOT l_tax > 0.02 THEN 0 WHEN 1 - l_discount * 8 < 0.5 THEN 1 ELSE 2 END AS INTEGER) AS attention, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "region_rectangles": "SELECT p_partkey, p_partkey % 10 / 10 AS x0, 0.2::DOUBLE AS y0, 1.0::DOUBLE AS x1, 0.9::DOUBLE AS y1 FROM part",
    "session_ids": "SELECT c_custkey, c_custkey % 3 = 2 OR (c_custkey % 3 = 0 AND NOT regexp_matches(md5(c_name), '[a-f]')) AS valid FROM customer",
    "foreign_lines": "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 1 THEN p_name || ' /' ELSE p_name END AS text FROM part WHERE p_partkey % 3 <> 0",
}
