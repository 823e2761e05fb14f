"""Stores, logs, memos, rounds and counters over the test tables: each writes to a folder of its own and reads back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters, frontier, retrieval
from ..operators.memo import Memo
from ..sources import runlog
from ..sources.cuts import freed, shared_folder, written
from ..sources.store import KeyedStore
from .audit import table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind by way of a keyed store: thirds of the events in turn, the second one twice, then kinds are deleted."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))
    store = KeyedStore(spark, _place(spark, "states"), "user_id long, event_type string, event_id long, value double", ("user_id", "event_type"), 16)
    for third in (2, 0, 1, 0):
        store.upsert(e.filter(F.col("event_id") % 3 == third), order="event_id", newest=True)
    gone = e.filter((F.col("user_id") % 5 == 0) & (F.col("event_type") == "click")).select("user_id", "event_type").distinct()
    store.delete(gone)
    return store.read()


def logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as check runs in the log, their lines as checks; the first batch is written twice, the second one repeats its runs."""
    l = table(spark, sf_dir, "lineitem")
    verdict = F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS")
    docs = l.groupBy("l_orderkey", "l_linestatus").agg(F.collect_list(F.struct(verdict.alias("verdict"))).alias("checks"))
    doc = F.struct(F.col("l_linestatus").alias("doc_id"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("string").alias("overall_verdict"), "checks")
    runs = docs.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(doc), lambda a, b: F.when(a["doc_id"] < b["doc_id"], -1).otherwise(1)).alias("documents"))
    runs = runs.select(F.col("l_orderkey").cast("string").alias("run_id"), F.concat(F.lit("s"), "l_orderkey").alias("session_id"), (F.col("l_orderkey") / 7).alias("ocr_seconds"), "documents")
    lines = runlog.run_lines(runs, F.lit("2024-01-01").cast("timestamp"))
    path = _place(spark, "log")
    for batch, part in (("b1", lines.filter("run_id % 2 = 0")), ("b1", lines.filter("run_id % 2 = 0")), ("b2", lines)):
        runlog.append(part, path, batch)
    got = runlog.read(spark, path)
    fails = F.aggregate("documents", F.lit(0), lambda acc, d: acc + d["num_fail"])
    return got.select("run_id", "batch", "session_id", F.col("num_documents").cast("long").alias("num_documents"), "ocr_seconds", fails.cast("long").alias("num_fail"))


def remembered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every hundredth one, asked twice through a memo, and how many were missing each time."""
    e = table(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    vectors = e.select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("vec"), "label")

    def answer(queries: DataFrame) -> DataFrame:
        asked = queries.join(vectors, "query").select(F.struct("query", "filter", "k").alias("query_id"), "vec", "label")
        return retrieval.top_k(asked, chunks, "label", 5).select("query_id.*", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "distance")

    memo = Memo(spark, _place(spark, "memo"), answer)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query"), F.col("label").cast("string").alias("filter"), F.lit(5).alias("k"))
    first = memo.prefetch(q, "corpus-1", 1)
    hits = memo.ask(q, "corpus-1", 2)
    again = memo.prefetch(q, "corpus-1", 3)
    return hits.select("query", F.col("rank").cast("long").alias("rank"), "chunk_id", "distance", F.lit(first).cast("long").alias("missing_first"), F.lit(again).cast("long").alias("missing_again"))


PAGE = 4
"""Lines of a page of a document's text."""


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of PAGE lines, read round by round, two pages a round, until a line begins with `the` or `der` after the first one that holds `que` or `und`.

    Pages are filed in folders by index (pages 0 and 1, 2 to 5, 6 to 13 and so on), so a round opens just the folders of its pages."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    lines = rows.select("doc_id", F.floor(F.col("n") / PAGE).cast("int").alias("page_index"), (F.col("n") % PAGE).alias("line_no"), "text", F.lit(1.0).alias("conf"))
    folder = lambda page: F.floor(F.log2(page / 2 + 1)).cast("int")
    path = _place(spark, "pages")
    lines.withColumn("folder", folder(F.col("page_index"))).sortWithinPartitions("folder", "page_index").write.partitionBy("folder").parquet(path)
    filed = spark.read.schema(lines.withColumn("folder", F.lit(0)).schema).parquet(path)
    docs = written(filed.groupBy("doc_id").agg((F.max("page_index") + 1).cast("int").alias("n_pages")))

    def read(want: DataFrame) -> DataFrame:
        low, high = want.agg(F.min("page_index"), F.max("page_index")).first()
        if low is None:
            return filed.limit(0)
        own = filed.filter(F.col("folder").between(int(math.log2(low / 2 + 1)), int(math.log2(high / 2 + 1))) & F.col("page_index").between(low, high))
        return own.join(want, ["doc_id", "page_index"], "left_semi")

    _, state = frontier.read_until(docs, read, _place(spark, "rounds"), ["que", "und"], ["the", "der"], step=2)
    filed.step_path = path
    freed(filed)  # rounds hold what was read
    return state


def counted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run that writes all lines: taken while they are written, not counted again."""
    run = counters.Run()
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_linenumber").repartition(6)
    with run.stage("write"):
        run.written(l, _place(spark, "counted"), returned=F.col("l_returnflag") == "R", pieces=F.col("l_quantity"), lines=F.lit(1))
    return run.rows(spark, "r1").filter("kind = 'counter'").select("name", "value")


QUERIES = {"stored_states": stored_states, "logged_runs": logged_runs, "remembered_topk": remembered_topk, "early_stop_pages": early_stop, "counted_run": counted_run}
_D = "round(list_sum([(q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) for i in range(1, 65)]), 6)"
SQL = {
    "stored_states": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(round(value, 2), event_id) AS value FROM events WHERE NOT (user_id % 5 = 0 AND event_type = 'click') GROUP BY 1, 2",
    "logged_runs": """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CASE WHEN l_orderkey % 2 = 0 THEN 'b1' ELSE 'b2' END AS batch, 's' || l_orderkey AS session_id, count(DISTINCT l_linestatus) AS num_documents,
 round(l_orderkey / 7, 1) AS ocr_seconds, count(*) FILTER (l_returnflag = 'R') AS num_fail FROM lineitem GROUP BY l_orderkey""",
    "remembered_topk": f"""WITH h AS (SELECT q.vec_id AS query, c.vec_id AS chunk_id, {_D} AS distance FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, chunk_id) AS rank FROM h) SELECT CAST(query AS VARCHAR) AS query, rank, CAST(chunk_id AS VARCHAR) AS chunk_id, distance,
 (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS missing_first, CAST(0 AS BIGINT) AS missing_again FROM r WHERE rank <= 5""",
    "early_stop_pages": r"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 f AS (SELECT *, regexp_replace(lower(strip_accents(replace(replace(t, 'đ', 'd'), 'Đ', 'D'))), '[^0-9a-z]', '', 'g') AS a,
  regexp_replace(regexp_replace(lower(trim(strip_accents(replace(replace(t, 'đ', 'd'), 'Đ', 'D')))), '^(?:dieu\s*\d+[.):\-]?|[ivxlcdm]+[.)]|\d+[.):\-]?)\s*', ''), '[^0-9a-z]', '', 'g') AS h FROM l),
 s AS (SELECT doc_id, min(n) FILTER (contains(a, 'que') OR contains(a, 'und')) AS first, max(n) // 4 + 1 AS pages FROM f GROUP BY 1),
 e AS (SELECT s.doc_id, pages, min(n // 4) FILTER (n > first AND (starts_with(h, 'the') OR starts_with(h, 'der'))) AS last FROM s JOIN f USING (doc_id) GROUP BY 1, 2),
 r AS (SELECT doc_id, pages, last, CASE WHEN last IS NULL THEN pages ELSE least(pages, (last // 2 + 1) * 2) END AS pages_read FROM e)
 SELECT doc_id, pages_read, pages_read < pages OR coalesce(last < pages - 1, false) AS stopped_early FROM r""",
    "counted_run": "SELECT unnest(['returned', 'pieces', 'lines']) AS name, unnest([count(*) FILTER (l_returnflag = 'R'), CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), count(*)])::DOUBLE AS value FROM lineitem",
}
