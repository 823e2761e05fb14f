"""The regulation corpus over `documents` (texts to chunk), `part` (a registry with files on
disk for some entries) and `pages` (sources to convert)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import pages as P
from ..sources.files import html_text
from .audit import table


def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = C.chunk_paragraphs(d, "\n", 1200)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("chars"), F.sha1("text").alias("sha1"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sha = F.sha2("p_name", 256)
    return table(spark, sf_dir, "part").filter("p_size <> 4").select(
        F.concat(F.lit("doc_"), k).alias("file"),
        F.when(k % 8 == 1, F.lit(None)).when(k % 8 == 2, F.lit("stale")).otherwise(sha).alias("sha256"),
        F.when(k % 6 != 5, F.lit("chief")).alias("approved_by"),
        k.alias("ord"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("reg_set"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_size <> 13").select(F.concat(F.lit("doc_"), k).alias("file"), F.sha2("p_name", 256).alias("sha256"), F.col("p_name").alias("text"))


def registry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.registry_audit(registry(spark, sf_dir), files(spark, sf_dir))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.status_counts(registry_audit(spark, sf_dir))


def registry_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.registry_sync(registry(spark, sf_dir), files(spark, sf_dir))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.approve(registry(spark, sf_dir), files(spark, sf_dir), [f"doc_{i}" for i in range(0, 60, 5)], "board")


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fingerprint(files(spark, sf_dir), "prompt-1", "model-1")


def regulation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.regulation_sets(registry(spark, sf_dir), files(spark, sf_dir))
    return s.select("reg_set", "files", F.sha1(F.array_join("titles", "|")).alias("titles"))


def add_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New uploads: contents that the set holds already, repeats, names that are taken, and names that numbered ones would get."""
    k = F.col("s_suppkey")
    stem = F.concat(F.lit("doc_"), k % 40, F.when(k % 3 == 0, F.concat(F.lit("_"), k % 4)).otherwise(""), F.when(k % 5 == 0, "_2").otherwise(""))
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), k % 25 + 1).alias("reg_set"), stem.alias("stem"), F.sha2(F.concat(F.lit("n"), k % 70), 256).alias("sha256"), k.alias("ord"))
    return C.add_to_set(registry(spark, sf_dir), new).select("reg_set", "file", "ord")


def delete_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry(spark, sf_dir).withColumn("file", F.concat(F.lit("doc_"), F.col("ord") % 1500))
    return C.delete_set(r, "Brand#3")[1]


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    old = table(spark, sf_dir, "part").filter("p_size <= 30").select(k.alias("chunk_id"), F.col("p_name").alias("text"))
    new = table(spark, sf_dir, "part").filter("p_size >= 20").select(k.alias("chunk_id"), F.upper("p_name").alias("text"))
    return C.upsert(old, new)


def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("segment_id"))
    live = table(spark, sf_dir, "customer").filter(F.col("c_nationkey") < 10).select(F.col("c_custkey").alias("segment_id"))
    return C.prune_orphans(rows, live).select("o_orderkey", "segment_id")


def set_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("field_set_id"), F.array(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1), F.concat(F.lit("Brand#"), F.col("s_nationkey"))).alias("regulation_sets"))
    u = C.used_by(fs, registry(spark, sf_dir))
    return u.select("reg_set", F.array_join("used_by", ",").alias("used_by"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.sha1(t).alias("sha1"))


def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.sum("n_chars").cast("long").alias("chars"))


def repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as lines: runs of one word are cut after three."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("line_no", "text"))
    return P.truncate_repeats(w).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("line_no").alias("places"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.lines(table(spark, sf_dir, "documents"))
    s = P.until_anchor(P.from_anchor(r, ["thing", "que"], 2), ["der", "the", "la"])
    return s.groupBy("doc_id").agg(F.count("*").alias("lines"), F.min("line_no").cast("long").alias("first"), F.max("line_no").cast("long").alias("last"))


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_quality(table(spark, sf_dir, "documents")).select("doc_id", F.col("chars").cast("long").alias("chars"), "junk", "trusted")


def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paragraphs(P.lines(table(spark, sf_dir, "documents"))).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (1 - F.col("l_discount") * 8).alias("conf"))
    return P.read_stats(l)


def column_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of a band: discount and tax place them."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("band"), F.monotonically_increasing_id().alias("_x"), (F.col("l_partkey") % 1000 / 1000).alias("left"), (F.col("l_partkey") % 1000 / 1000 + F.col("l_discount")).alias("right"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("box_id")).drop("_x")
    return P.column_segments(b, 0.03).groupBy("doc_id").agg(F.max("segment").cast("long").alias("segments"))


_REG = """reg AS (SELECT 'doc_' || CAST(p_partkey AS VARCHAR) AS file, CASE p_partkey % 8 WHEN 1 THEN NULL WHEN 2 THEN 'stale' ELSE sha256(p_name) END AS sha256, CASE WHEN p_partkey % 6 <> 5 THEN 'chief' END AS approved_by, p_partkey AS ord, p_name AS title, p_brand AS reg_set FROM part WHERE p_size <> 4),
 fil AS (SELECT 'doc_' || CAST(p_partkey AS VARCHAR) AS file, sha256(p_name) AS sha256 FROM part WHERE p_size <> 13)"""
_AUDIT = f"""WITH {_REG} SELECT coalesce(r.file, f.file) AS file, CASE WHEN r.file IS NULL THEN 'unregistered' WHEN f.file IS NULL THEN 'missing_file' WHEN r.sha256 <> f.sha256 THEN 'hash_mismatch' WHEN coalesce(approved_by, '') = '' THEN 'unapproved' ELSE 'ok' END AS status FROM reg r FULL OUTER JOIN fil f ON r.file = f.file"""
_FOLD = "strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D'))"
_LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
QUERIES = {
    "chunk_paragraphs": chunk_paragraphs,
    "registry_audit_full_outer": registry_audit,
    "registry_status_counts": status_counts,
    "registry_sync_anti": registry_sync,
    "registry_approvals": approvals,
    "corpus_fingerprint": corpus_fingerprint,
    "reg_sets_group": regulation_sets,
    "reg_set_additions": add_regulations,
    "reg_set_deletion": delete_regulations,
    "upsert_chunks": upsert_chunks,
    "prune_orphans": prune_orphans,
    "reg_set_usage": set_usage,
    "page_texts": page_texts,
    "chunk_sources": chunk_sources,
    "repeat_run_truncate": repeat_runs,
    "anchor_cuts": anchors,
    "page_quality": page_quality,
    "para_fold_islands": line_paragraphs,
    "read_stats": read_stats,
    "column_segments": column_segments,
}
SQL = {
    "chunk_paragraphs": """WITH RECURSIVE p AS (SELECT doc_id, list_filter([trim(x, ' ' || chr(9) || chr(13) || chr(10)) for x in string_split(text, chr(10))], lambda x: x <> '') AS l FROM documents),
 f AS (SELECT doc_id, l, 1 AS i, 0 AS c, length(l[1]) AS n, [0] AS cs FROM p WHERE len(l) > 0
 UNION ALL SELECT doc_id, l, i + 1, CASE WHEN n + length(l[i + 1]) + 1 <= 1200 THEN c ELSE c + 1 END, CASE WHEN n + length(l[i + 1]) + 1 <= 1200 THEN n + length(l[i + 1]) + 1 ELSE length(l[i + 1]) END,
 list_append(cs, CASE WHEN n + length(l[i + 1]) + 1 <= 1200 THEN c ELSE c + 1 END) FROM f WHERE i < len(l)),
 u AS (SELECT doc_id, unnest(cs) AS c, unnest(l) AS t, unnest(range(len(l))) AS i FROM f WHERE i = len(l)), g AS (SELECT doc_id, c, string_agg(t, chr(10) ORDER BY i) AS text FROM u GROUP BY 1, 2)
 SELECT doc_id, CAST(c AS BIGINT) AS chunk_index, length(text) AS chars, sha1(text) AS sha1 FROM g""",
    "registry_audit_full_outer": _AUDIT,
    "registry_status_counts": f"SELECT s.status, count(a.file) AS n, s.status IN ('missing_file', 'hash_mismatch') AS blocking FROM (SELECT unnest(['missing_file', 'hash_mismatch', 'unapproved', 'unregistered', 'ok']) AS status) s LEFT JOIN ({_AUDIT}) a ON a.status = s.status GROUP BY 1",
    "registry_sync_anti": f"WITH {_REG} SELECT r.file, coalesce(r.sha256, f.sha256) AS sha256, approved_by FROM reg r LEFT JOIN fil f ON r.file = f.file UNION ALL SELECT file, sha256, NULL FROM fil WHERE file NOT IN (SELECT file FROM reg)",
    "registry_approvals": f"WITH {_REG} SELECT r.file, CASE WHEN h THEN f.sha256 ELSE r.sha256 END AS sha256, CASE WHEN h THEN 'board' ELSE approved_by END AS approved_by FROM (SELECT r.*, r.ord < 60 AND r.ord % 5 = 0 AND r.file IN (SELECT file FROM fil) AS h FROM reg r) r LEFT JOIN fil f ON r.file = f.file",
    "corpus_fingerprint": f"WITH {_REG}, h AS (SELECT sha256(file || '|' || sha256) AS h FROM fil), s AS (SELECT count(*) AS n, " + ", ".join(f"CAST(coalesce(sum(CAST('0x' || h[{15 * k + 1}:{15 * k + 15}] AS HUGEINT)), 0) % 1152921504606846976 AS VARCHAR) AS s{k}" for k in range(4)) + " FROM h) SELECT sha256(n || '#' || s0 || '#' || s1 || '#' || s2 || '#' || s3 || '#prompt-1#model-1')[1:16] AS fingerprint FROM s",
    "reg_sets_group": f"WITH {_REG} SELECT reg_set, count(*) AS files, sha1(string_agg(title, '|' ORDER BY ord)) AS titles FROM reg WHERE file IN (SELECT file FROM fil) GROUP BY 1",
    "reg_set_additions": f"""WITH RECURSIVE {_REG}, n AS (SELECT 'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) AS reg_set,
  'doc_' || CAST(s_suppkey % 40 AS VARCHAR) || CASE WHEN s_suppkey % 3 = 0 THEN '_' || CAST(s_suppkey % 4 AS VARCHAR) ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN '_2' ELSE '' END AS stem, sha256('n' || CAST(s_suppkey % 70 AS VARCHAR)) AS sha256, s_suppkey AS ord FROM supplier),
 d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY reg_set, sha256 ORDER BY ord) = 1), e AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.reg_set = d.reg_set AND reg.sha256 = d.sha256)),
 o AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM e),
 walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS reg_set, CAST(NULL AS BIGINT) AS ord, (SELECT list(file) FROM reg) AS taken
  UNION ALL SELECT i, f, reg_set, ord, list_append(taken, f) FROM (SELECT o.i, o.reg_set, o.ord, w.taken, list_filter(list_concat([o.stem], list_transform(range(2, 200), lambda n: o.stem || '_' || CAST(n AS VARCHAR))), lambda c: NOT list_contains(w.taken, c))[1] AS f FROM walk w JOIN o ON o.i = w.i + 1))
 SELECT reg_set, file, ord FROM walk WHERE i > 0""",
    "reg_set_deletion": "WITH r AS (SELECT 'doc_' || CAST(p_partkey % 1500 AS VARCHAR) AS file, p_brand FROM part WHERE p_size <> 4) SELECT DISTINCT file FROM r WHERE p_brand = 'Brand#3' AND file NOT IN (SELECT file FROM r WHERE p_brand <> 'Brand#3')",
    "upsert_chunks": "SELECT p_partkey AS chunk_id, CASE WHEN p_size >= 20 THEN upper(p_name) ELSE p_name END AS text FROM part",
    "prune_orphans": "SELECT o_orderkey, o_custkey AS segment_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)",
    "reg_set_usage": "SELECT reg_set, string_agg(s_name, ',' ORDER BY s_name) AS used_by FROM (SELECT DISTINCT s_name, unnest(['Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR), 'Brand#' || CAST(s_nationkey AS VARCHAR)]) AS reg_set FROM supplier) WHERE reg_set IN (SELECT p_brand FROM part WHERE p_size <> 4) GROUP BY 1",
    "page_texts": r"""SELECT page_id, length(t) AS chars, sha1(t) AS sha1 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
 '(?i)</(p|div|h[1-6]|li|tr|article|section|title)>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10)) AS t FROM pages)""",
    "chunk_sources": "SELECT source, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "repeat_run_truncate": """WITH w AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)), r AS (SELECT *, CASE WHEN t IS NOT DISTINCT FROM lag(t) OVER (PARTITION BY doc_id ORDER BY i) AND i > 0 THEN 0 ELSE 1 END AS n FROM w),
 g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS nth FROM g) SELECT doc_id, count(*) AS kept, CAST(sum(i) AS BIGINT) AS places FROM k WHERE nth <= 3 GROUP BY 1""",
    "anchor_cuts": rf"""WITH {_LINES}, k AS (SELECT *, lower(regexp_replace({_FOLD.format("text")}, '[^0-9A-Za-z]', '', 'g')) AS a, regexp_replace(regexp_replace(lower(trim({_FOLD.format("text")})), '^(?:dieu\s*\d+[.):\-]?|[ivxlcdm]+[.)]|\d+[.):\-]?)\s*', ''), '[^0-9a-z]', '', 'g') AS s FROM lines),
 b AS (SELECT *, min(CASE WHEN a LIKE '%thing%' OR a LIKE '%que%' THEN line_no END) OVER (PARTITION BY doc_id) AS h FROM k), c AS (SELECT * FROM b WHERE h IS NULL OR line_no >= h - 2),
 e AS (SELECT *, min(CASE WHEN s LIKE 'der%' OR s LIKE 'the%' OR s LIKE 'la%' THEN line_no END) OVER (PARTITION BY doc_id) AS z FROM c) SELECT doc_id, count(*) AS lines, min(line_no) AS first, max(line_no) AS last FROM e WHERE z IS NULL OR z = 0 OR line_no < z GROUP BY 1""",
    "page_quality": r"""SELECT doc_id, length(text) AS chars, junk, length(text) >= 200 AND (junk IS NULL OR junk <= 0.06) AS trusted FROM (SELECT doc_id, text, CASE WHEN len(w) >= 20 THEN round(len(list_filter(w, lambda x: regexp_matches(trim(x, '.,;:()[]{}"''-–—/*|'), '\p{L}[^\p{L}\p{N}]\p{L}|\p{Ll}\p{Lu}'))) / len(w), 3) END AS junk
 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) >= 2 AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 2) AS w FROM documents))""",
    "para_fold_islands": rf"""WITH {_LINES}, k AS (SELECT *, trim(text) = '' AS e, regexp_matches(lower(trim(text)), '^((phần|phan|part)\s+((thứ|thu)\s+)?[0-9a-zà-ỹđ]+|(chương|chuong|chapter)\s+[ivxlc0-9]+([^0-9a-zà-ỹđ]|$)|(mục|muc|section)\s+[0-9]+([^0-9a-zà-ỹđ]|$)|(điều|dieu|article)\s+[0-9]+[a-zđ]?\s*[.:])') OR regexp_matches(text, '^\s*([-+*•]|\d{{1,2}}[.)])\s') AS b FROM lines),
 p AS (SELECT *, sum(CASE WHEN e OR b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM k), g AS (SELECT doc_id, para, string_agg(trim(text), ' ' ORDER BY line_no) AS t FROM p WHERE NOT e AND NOT regexp_matches(text, '^\s*-?\s*\d{{1,3}}\s*-?\s*$') GROUP BY 1, 2)
 SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(t)) AS BIGINT) AS chars FROM g GROUP BY 1""",
    "read_stats": "SELECT l_orderkey AS doc_id, count(*) AS num_lines, round(avg(CASE WHEN c < 1 THEN c END), 4) AS avg_confidence, round(min(CASE WHEN c < 1 THEN c END), 4) AS min_confidence, count(*) FILTER (c < 0.6) AS low_lines FROM (SELECT l_orderkey, 1 - l_discount * 8 AS c FROM lineitem) GROUP BY 1",
    "column_segments": """WITH b AS (SELECT l_orderkey AS doc_id, l_partkey % 1000 / 1000 AS l, l_partkey % 1000 / 1000 + l_discount AS r, l_partkey * 100 + l_linenumber AS i FROM lineitem), n AS (SELECT *, CASE WHEN coalesce(l - max(r) OVER (PARTITION BY doc_id ORDER BY l, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.03, true) THEN 1 ELSE 0 END AS new FROM b)
 SELECT doc_id, CAST(sum(new) AS BIGINT) AS segments FROM n GROUP BY 1""",
}
