"""Retrieval over `embeddings` (chunk vectors, label: scope), `orders` (passages with a
validity interval), `nation` (requests with a signing day), `benchmark` against `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import vector_index
from ..sources.cuts import shared_folder
from .audit import table


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every hundredth vector asks for the nearest others of its label."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return R.top_k(q, c, "label", k)


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 5).select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same nearest vectors by way of an inverted file that is built first: probed lists bound the distance, only lists within it are read."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")
    where = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), where, lists=32, steps=3)
    got = vector_index.Index(spark, where).exact(q, 5, 4, ("label",))
    return got.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


def _field_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as fields; several chunks share a text."""
    h = _hits(spark, sf_dir, 8)
    return h.select(F.col("query_id").alias("field_ord"), F.concat(F.lit("f"), F.col("query_id")).alias("field_key"), (F.col("rank") - 1).alias("i"), "chunk_id", F.concat(F.lit("t"), F.col("chunk_id") % 37).alias("text"), "distance")


def guaranteed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.guaranteed(_field_hits(spark, sf_dir), 2, 20).select("key", "distance", "must", F.size("found").cast("long").alias("hits"))


def field_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.field_ranks(R.guaranteed(_field_hits(spark, sf_dir), 2, 20)).select("field_key", "key", F.col("rank").cast("long").alias("rank"))


def coverage_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _field_hits(spark, sf_dir).select("field_key").distinct().unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("field_key")))
    return R.coverage(keys, R.field_ranks(R.guaranteed(_field_hits(spark, sf_dir), 2, 20)), 6)


def _dossier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dossier an order, a field a remainder of its lines' numbers; parts are passages, their suppliers' last digit the text."""
    l = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 3).orderBy("l_extendedprice", "l_partkey", "l_linenumber")
    field = (F.col("l_linenumber") % 3).cast("long")
    return l.select(F.col("l_orderkey").alias("doc_id"), field.alias("field_ord"), F.concat(F.lit("f"), field).alias("field_key"), (F.row_number().over(w) - 1).alias("i"), F.col("l_partkey").alias("chunk_id"), F.concat(F.lit("t"), F.col("l_suppkey") % 7).alias("text"), F.col("l_extendedprice").cast("double").alias("distance"))


def guaranteed_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every dossier in one plan: two of each field are kept whatever the cap of three texts a dossier."""
    got = R.guaranteed(_dossier_hits(spark, sf_dir), 1, 3, "doc_id")
    return got.select("doc_id", "key", "distance", "must", F.size("found").cast("long").alias("hits"))


def dossier_field_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.field_ranks(R.guaranteed(_dossier_hits(spark, sf_dir), 1, 3, "doc_id"), "doc_id")
    return got.select("doc_id", "field_key", "key", F.col("rank").cast("long").alias("rank"))


def valid_topk_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every shipping day and priority the three cheapest orders in force, by status; before the first order none is."""
    l = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    early = table(spark, sf_dir, "region").select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("r_regionkey").cast("int")).alias("day"))
    none = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit(None).cast("date").alias("day"))
    scopes = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("jurisdiction")).distinct()
    days = l.unionByName(early).unionByName(none).withColumn("jurisdiction", F.explode(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]))).join(scopes, "jurisdiction", "left_semi")
    p = _passages(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").cast("double").alias("distance")), "chunk_id")
    got = R.valid_top_k(days, p, 3, ("jurisdiction",), ("doc_type",))
    return got.select("jurisdiction", "doc_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "chunk_id", "distance", F.col("rank").cast("long").alias("rank"), "in_force")


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir, 5).withColumn("field_key", F.col("query_id"))
    scores = h.select("query_id", "chunk_id", (F.col("chunk_id") * 7 % 5).alias("score"))
    return R.rerank(h.drop("rank"), scores).select("field_key", "chunk_id", F.col("i").cast("long").alias("i"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("jurisdiction"), F.col("o_orderstatus").alias("doc_type"), (F.col("o_custkey") % 4).cast("string").alias("reg_set"), start.alias("effective_from"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(start, 30)).alias("effective_to"))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).filter(R.scope("1-URGENT", ["F", "P"], ["1", "2"])).select("chunk_id", "doc_type", "reg_set")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request a nation; one without a day, one before any passage."""
    k = F.col("n_nationkey")
    day = F.when(k % 6 != 5, F.date_add(F.lit("1990-01-01").cast("date"), (k * 150).cast("int")))
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    return table(spark, sf_dir, "nation").select(k.alias("query_id"), day.alias("day"), F.element_at(names, (k % 5 + 1).cast("int")).alias("jurisdiction"))


def in_force_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope and year are the equi-join key, the day is checked on it."""
    j = R.valid_on(_requests(spark, sf_dir), _passages(spark, sf_dir), "jurisdiction")
    return j.groupBy("query_id").agg(F.count("*").alias("passages"), F.max("chunk_id").alias("last"))


def relaxed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relaxed_on(_requests(spark, sf_dir), _passages(spark, sf_dir), "jurisdiction").groupBy("query_id").agg(F.count("*").alias("passages"), F.bool_and("in_force").alias("strict"))


def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.best_chunk(q, d)


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("check_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_partkey")).alias("chunk_id"))


def citation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "part").filter(F.col("p_size") < 40).select(F.col("p_partkey").alias("chunk_id"))
    return R.citation_quality(_citations(spark, sf_dir), sent)


def citation_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "part").filter(F.col("p_size") < 10).select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("source_doc"), F.repeat("p_name", F.lit(150)).alias("text"))
    return R.backfill(_citations(spark, sf_dir), store).select("check_id", "chunk_id", "source_doc", F.length("text_quote").cast("long").alias("chars"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field_key"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name")).alias("label"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("aspect"))
    return R.query_text(c, "contract")


def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold every word of a search, marks and case ignored."""
    from ..functions.text import fold_diacritics

    hay = F.lower(fold_diacritics(F.concat_ws(" ", "p_name", "p_type", "p_brand")))
    words = F.split(F.lower(fold_diacritics(F.lit("RÍNG  Économy"))), r"\s+")
    return table(spark, sf_dir, "part").filter(F.forall(words, lambda w: F.contains(hay, w))).select("p_partkey")


def dpi_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tier above a resolution, else the last: a range lookup in a fixed table."""
    dpi = (F.col("p_size") * 10).cast("int")
    tiers = [("low", 150), ("mid", 300), ("high", 400)]
    pick = F.lit(tiers[-1][0])
    for name, most in sorted(tiers, key=lambda t: -t[1]):
        pick = F.when(dpi < most, name).otherwise(pick)
    return table(spark, sf_dir, "part").select("p_partkey", pick.alias("tier"))


def rank_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey")
    l = table(spark, sf_dir, "lineitem")
    return l.withColumn("rank", F.row_number().over(w) - 1).filter("rank < 2").select("l_orderkey", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


_HITS = """hits AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_sum([(q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) for i in range(1, 65)]), 6) AS distance,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum([(q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) for i in range(1, 65)]), 6), c.vec_id) AS rank
 FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0) WHERE rank <= {0})"""
_G = f"""WITH {_HITS.format(8)}, fh AS (SELECT query_id AS field_ord, 'f' || CAST(query_id AS VARCHAR) AS field_key, rank - 1 AS i, 't' || CAST(chunk_id % 37 AS VARCHAR) AS key, distance FROM hits),
 k AS (SELECT key, bool_or(i < 2) AS must, min(CASE WHEN i >= 2 THEN struct_pack(d := distance, f := field_ord, i := i) END) AS fe, min(distance) AS distance, count(*) AS hits FROM fh GROUP BY 1),
 o AS (SELECT *, row_number() OVER (ORDER BY must DESC, fe, key) AS place, count(*) FILTER (must) OVER () AS m FROM k), g AS (SELECT key, distance, must, hits FROM o WHERE must OR place <= greatest(20, m)),
 fr AS (SELECT field_key, key, CAST(min(i) AS BIGINT) AS rank FROM fh WHERE key IN (SELECT key FROM g) GROUP BY 1, 2)"""
_PASS = "p AS (SELECT o_orderkey AS chunk_id, o_orderpriority AS j, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS t FROM orders)"
_REQ = "q AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 6 <> 5 THEN DATE '1990-01-01' + CAST(n_nationkey * 150 AS INTEGER) END AS day, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][n_nationkey % 5 + 1] AS j FROM nation)"
_FORCE = "(day IS NULL OR (f <= day AND coalesce(t, DATE '9999-12-31') >= day))"
_TOK = "list_filter(list_distinct(regexp_split_to_array(lower(strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+')), lambda t: length(t) >= 4)"
_GD = """WITH fh AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS o, 'f' || CAST(l_linenumber % 3 AS VARCHAR) AS field_key, 't' || CAST(l_suppkey % 7 AS VARCHAR) AS key, CAST(l_extendedprice AS DOUBLE) AS distance,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_extendedprice, l_partkey, l_linenumber) - 1 AS i FROM lineitem),
 k AS (SELECT doc_id, key, bool_or(i < 1) AS must, min(CASE WHEN i >= 1 THEN struct_pack(d := distance, f := o, i := i) END) AS fe, min(distance) AS distance, count(*) AS hits FROM fh GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY must DESC, fe, key) AS place, count(*) FILTER (must) OVER (PARTITION BY doc_id) AS m FROM k),
 g AS (SELECT doc_id, key, distance, must, hits FROM o WHERE must OR place <= greatest(3, m))"""
_VT = """WITH p AS (SELECT o_orderkey AS chunk_id, o_orderpriority AS jurisdiction, o_orderstatus AS doc_type, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 30 ELSE DATE '9999-12-31' END AS t, CAST(o_totalprice AS DOUBLE) AS distance FROM orders),
 d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem UNION ALL SELECT DATE '1970-01-01' + CAST(r_regionkey AS INTEGER) FROM region UNION ALL SELECT NULL),
 m AS (SELECT p.*, d.day, d.day IS NULL OR (f <= d.day AND t >= d.day) AS ok FROM p, d),
 a AS (SELECT jurisdiction, day, bool_or(ok) AS hit FROM m GROUP BY 1, 2),
 r AS (SELECT m.jurisdiction, doc_type, m.day, chunk_id, distance, ok, row_number() OVER (PARTITION BY m.jurisdiction, doc_type, m.day ORDER BY distance, chunk_id) AS rank
  FROM m JOIN a ON a.jurisdiction = m.jurisdiction AND a.day IS NOT DISTINCT FROM m.day WHERE ok OR NOT hit)
 SELECT jurisdiction, doc_type, strftime(day, '%Y-%m-%d') AS day, chunk_id, distance, rank, ok AS in_force FROM r WHERE rank <= 3"""
QUERIES = {
    "knn_topk": knn_topk,
    "indexed_topk": indexed_topk,
    "guaranteed_topk_cap": guaranteed_topk,
    "field_ranks": field_ranks,
    "coverage_at_k": coverage_at_k,
    "guaranteed_by_dossier": guaranteed_dossiers,
    "dossier_field_ranks": dossier_field_ranks,
    "valid_topk_by_day": valid_topk_days,
    "rerank_order": rerank,
    "scope_filter": scope_filter,
    "in_force_interval_join": in_force_join,
    "relaxed_fallback": relaxed_fallback,
    "best_chunk_overlap": best_chunk,
    "citation_precision": citation_precision,
    "citation_backfill_join": citation_backfill,
    "query_texts": query_texts,
    "all_words_filter": all_words,
    "dpi_tiers": dpi_tiers,
    "rank_within": rank_within,
}
SQL = {
    "indexed_topk": f"WITH {_HITS.format(5)} SELECT query_id, chunk_id, distance, rank FROM hits",
    "knn_topk": f"WITH {_HITS.format(5)} SELECT query_id, chunk_id, distance, rank FROM hits",
    "guaranteed_topk_cap": _G + " SELECT key, distance, must, hits FROM g",
    "field_ranks": _G + " SELECT * FROM fr",
    "coverage_at_k": _G + " SELECT count(*) AS fields, round(avg(CASE WHEN c > 0 THEN 1 ELSE 0 END), 4) AS coverage, round(avg(CASE WHEN c >= 6 THEN 1 ELSE 0 END), 4) AS full_coverage, count(*) FILTER (c = 0) AS uncovered FROM (SELECT a.field_key, count(fr.key) AS c FROM (SELECT DISTINCT field_key FROM fh UNION ALL SELECT r_name FROM region) a LEFT JOIN fr ON fr.field_key = a.field_key GROUP BY 1)",
    "guaranteed_by_dossier": _GD + " SELECT * FROM g",
    "dossier_field_ranks": _GD + " SELECT doc_id, field_key, key, CAST(min(i) AS BIGINT) AS rank FROM fh JOIN g USING (doc_id, key) GROUP BY 1, 2, 3",
    "valid_topk_by_day": _VT,
    "rerank_order": f"WITH {_HITS.format(5)} SELECT query_id AS field_key, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id * 7 % 5 DESC, distance, chunk_id) - 1 AS i FROM hits",
    "scope_filter": "SELECT o_orderkey AS chunk_id, o_orderstatus AS doc_type, CAST(o_custkey % 4 AS VARCHAR) AS reg_set FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'P') AND o_custkey % 4 IN (1, 2)",
    "in_force_interval_join": f"WITH {_PASS}, {_REQ} SELECT query_id, count(*) AS passages, max(chunk_id) AS last FROM p JOIN q USING (j) WHERE {_FORCE} GROUP BY 1",
    "relaxed_fallback": f"WITH {_PASS}, {_REQ}, m AS (SELECT *, {_FORCE} AS ok FROM p JOIN q USING (j)), a AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS hit FROM m) SELECT query_id, count(*) AS passages, bool_and(ok) AS strict FROM a WHERE ok OR NOT hit GROUP BY 1",
    "best_chunk_overlap": f"WITH q AS (SELECT item_id, unnest({_TOK.format('text')}) AS t FROM benchmark), d AS (SELECT doc_id, unnest({_TOK.format('text')}) AS t FROM documents), n AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN d USING (t) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT item_id AS query_id, doc_id AS chunk_id, score FROM n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1",
    "citation_precision": "SELECT count(*) AS citations, count(*) FILTER (p) AS known, count(*) FILTER (c IS NOT NULL AND NOT p) AS invented, count(*) FILTER (c IS NULL) AS static, round(count(*) FILTER (p) / nullif(count(c), 0), 4) AS precision FROM (SELECT c, coalesce(c IN (SELECT p_partkey FROM part WHERE p_size < 40), false) AS p FROM (SELECT CASE WHEN l_linenumber % 4 <> 0 THEN l_partkey END AS c FROM lineitem))",
    "citation_backfill_join": "SELECT l_orderkey AS check_id, p_partkey AS chunk_id, p_brand AS source_doc, CAST(least(1200, 150 * length(p_name)) AS BIGINT) AS chars FROM lineitem JOIN part ON l_partkey = p_partkey AND l_linenumber % 4 <> 0 AND p_size < 10",
    "query_texts": "SELECT p_partkey AS field_key, 'contract' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_name END || CASE WHEN p_size % 2 = 0 THEN ' ' || p_type ELSE '' END AS text FROM part",
    "all_words_filter": "SELECT p_partkey FROM part WHERE lower(p_name || ' ' || p_type || ' ' || p_brand) LIKE '%ring%' AND lower(p_name || ' ' || p_type || ' ' || p_brand) LIKE '%economy%'",
    "dpi_tiers": "SELECT p_partkey, CASE WHEN p_size * 10 < 150 THEN 'low' WHEN p_size * 10 < 300 THEN 'mid' ELSE 'high' END AS tier FROM part",
    "rank_within": "SELECT l_orderkey, l_extendedprice, rank FROM (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) - 1 AS rank FROM lineitem) WHERE rank < 2",
}
