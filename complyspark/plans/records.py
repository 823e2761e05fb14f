"""Records of dossiers, registries, drafts and logs: functions and operators over rows made from
`orders`, `lineitem`, `part`, `customer`, `supplier` and `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import accuracy as Q
from ..operators import audit as A
from ..operators import corpus as C
from ..operators import extract as E
from ..operators import grounding as G
from ..operators import merging as M
from ..operators import pages as P
from ..operators import retrieval as R
from ..operators import verdicts as V
from ..sources import files as S
from ..streaming import progress as T
from .audit import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, one a line number of an order."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_returnflag").alias("flag"))


_L = "l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_discount) AS d, min(l_tax) AS t, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"
K, N = "l_orderkey", "l_linenumber"


# -- statistics ----------------------------------------------------------------------------------------


def mean_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    a = F.struct(F.when(k % 3 != 0, k % 10 / 10).alias("cer"), F.when(k % 4 == 0, k % 7 / 7).alias("field_accuracy"))
    return A.mean_accuracy(o.select(a.alias("accuracy")), ["cer", "field_accuracy"])


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["cache.embed.hit", "cache.query.miss", "payload.calls", "payload.chars", "payload.fields", "llm.retry.timeout", "llm.retry.length"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), ((F.col(N) - 1) % 7 + 1).cast("int"))
    return A.run_metrics(_lines(spark, sf_dir).select(F.col(K).alias("run_id"), name.alias("name"), (F.col("pk") % 50).alias("n")))


def segment_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)
    return P.segment_confidence(l.select(F.col(K).alias("doc_id"), F.col(N).alias("pos"), F.when(F.col("flag") == "R", "\n").otherwise("x").alias("token"), F.col("d").alias("p"))).select("doc_id", F.col("segment").cast("long").alias("segment"), "conf")


def letter_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("pk") % 3 == 0, F.concat(F.lit("- "), F.col("pk").cast("string"))).otherwise(F.concat(F.lit("điều "), F.col("pk").cast("string")))
    return P.letter_confidence(_lines(spark, sf_dir).select(F.col(K).alias("doc_id"), t.alias("text"), F.col("d").alias("conf")))


def day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "o_orderkey")
    return T.day_cutoff(o, F.lit("1998-01-31").cast("date"), 31).groupBy(F.substring("ts", 1, 10).alias("day")).agg(F.count("*").alias("runs"))


# -- dossiers --------------------------------------------------------------------------------------------


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the documents (orders) of a dossier (customer)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(K), F.col("o_custkey").alias("dossier"))
    v = F.when(F.col("pk") % 5 == 0, "").when(F.col("pk") % 5 == 1, "[]").when(F.col("pk") % 5 == 2, " ").otherwise(F.concat(F.lit("v"), F.col("pk") % 3))
    return _lines(spark, sf_dir).join(o, K).select("dossier", F.concat(F.lit("f"), F.col(N)).alias("field_key"), v.alias("value"), F.col(K).alias("ord"))


_FIELDS = f"{_L}, f AS (SELECT o_custkey AS dossier, 'f' || l_linenumber AS field_key, CASE pk % 5 WHEN 0 THEN '' WHEN 1 THEN '[]' WHEN 2 THEN ' ' ELSE 'v' || (pk % 3) END AS value, l_orderkey AS ord FROM l JOIN orders ON o_orderkey = l_orderkey)"


def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.key_union(_fields(spark, sf_dir))


def golden_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.golden_merge(_fields(spark, sf_dir))


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest_by_key(_fields(spark, sf_dir), ["dossier", "field_key"], "ord").select("dossier", "field_key", "value")


def selected_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).groupBy((F.col(K) % 1000).alias("dossier"), K).agg(F.collect_set(F.concat(F.lit("k"), F.col("pk") % 9)).alias("selected"))
    return M.selected_union(d).select("dossier", F.array_join("keys", ",").alias("keys"))


def machine_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)
    edited = F.col("pk") % 4 == 0
    return l.select(K, N, Q.machine_value(F.col("flag"), edited, F.when(F.col("pk") % 8 == 0, F.concat("flag", F.lit("'")))).alias("machine"))


def blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)
    return V.blocking_fields(l.select(F.col(K).alias("doc_id"), F.when(F.col("pk") % 3 != 0, F.concat(F.lit("f"), F.col("pk") % 2)).alias("block_field"), F.concat(F.lit("C"), F.col("pk") % 7).alias("code"), F.col(N).alias("ord")))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = _lines(spark, sf_dir), F.col("pk")
    kind = F.when(F.col(N) == 1, "declaration").when(F.col(N) == 2, "positive_integer").otherwise("regulated")
    return l.select(F.col(K).alias("doc_id"), F.concat(F.lit("f"), F.col(N)).alias("field_key"), F.when(p % 3 != 0, F.concat(F.lit("v"), p)).alias("value"), kind.alias("check_type"), (p % 2 == 0).alias("selected"), F.col("d").cast("double").alias("confidence"), F.col("flag"))


_REVIEWED = f"{_L}, r AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS field_key, pk % 3 <> 0 AS has, CASE l_linenumber WHEN 1 THEN 'declaration' WHEN 2 THEN 'positive_integer' ELSE 'regulated' END AS kind, pk % 2 = 0 AS selected, d, CASE flag WHEN 'A' THEN 'PASS' WHEN 'N' THEN 'FAIL' ELSE 'NEEDS_SUPPLEMENT' END AS verdict FROM l)"


def checkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.checkable(_reviewed(spark, sf_dir))


def review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reviewed(spark, sf_dir)
    parts = [V.attention_filter(r, w, 0.04).groupBy("check_type").agg(F.count("*").alias("n")).withColumn("shown", F.lit(w)) for w in ("all", "empty", "has", "lowconf")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall verdicts, with selected fields that stayed empty and the guard of dossiers that were never held against a regulation."""
    f = _reviewed(spark, sf_dir)
    v = F.when(F.col("flag") == "A", "PASS").when(F.col("flag") == "N", "FAIL").otherwise("NEEDS_SUPPLEMENT")
    checks = f.filter("value is not null and check_type <> 'declaration'").select("doc_id", "field_key", v.alias("verdict"))
    return V.overall(V.selected_but_empty(checks, f), f)


# -- texts -------------------------------------------------------------------------------------------------


def respelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New spellings: marks put back, a digit changed, another text, one grown too long."""
    k = F.col("p_partkey")
    old = F.concat("p_name", F.lit(" so "), k.cast("string"))
    new = F.when(k % 4 == 0, F.regexp_replace(old, "o", "ô")).when(k % 4 == 1, F.concat(old, F.lit("7"))).when(k % 4 == 2, F.concat(F.lit("=" * 30 + " "), k.cast("string"))).otherwise(F.concat(old, F.repeat(F.lit(" dài"), F.lit(30))))
    return table(spark, sf_dir, "part").select("p_partkey", G.respell_ok(new, old).alias("ok"))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _lines(spark, sf_dir)
    left, bottom = F.col("pk") % 10 / 10, F.col("pk") % 7 / 7
    boxes = b.select(F.col(K).alias("doc_id"), F.col(N).alias("box_id"), left.alias("left"), (left + 0.0625).alias("right"), bottom.alias("bottom"), (bottom + 0.0625).alias("top"))
    return P.inside_region(boxes, 0.2, 0.2, 0.7, 0.9).groupBy("doc_id").agg(F.count("*").alias("inside"))


def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.concat(F.lit("x thời"), F.when(k % 3 == 0, " , ").when(k % 3 == 1, "-").otherwise("; "), F.lit("hạn (1): "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.rlike(t, F.lit(X.label_pattern("thời hạn (1)"))).alias("found"))


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 5 == 0, F.concat(F.lit("## **"), "p_name", F.lit("**"))).when(k % 5 == 1, F.concat(F.lit("| "), "p_name", F.lit(" | `"), "p_brand", F.lit("` |"))).when(k % 5 == 2, F.lit("|---|---|")).when(k % 5 == 3, F.lit("```json")).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" __x__ ")))
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_markdown(t).alias("text"))


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    amount = F.when(k % 3 != 0, (F.col("o_custkey") * 1000).cast("long"))
    shown = G.display_value(F.when(k % 3 == 0, F.when(k % 2 == 0, F.col("o_orderpriority"))), amount, F.lit("USD"), F.when(k % 2 == 0, "năm"), F.when(k % 5 == 0, F.lit("1.000 USD")).otherwise(none))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))


def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None)
    amount = F.when(k % 4 == 0, F.col("o_custkey").cast("double")).when(k % 4 == 1, F.col("o_custkey") + F.lit(0.5))
    value = F.when(k % 4 == 2, F.concat((k % 100).cast("string"), F.lit(".0"))).when(k % 4 == 3, F.concat(F.lit("  "), "o_orderpriority", F.lit("  x ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.value_text(value, amount, F.lit("USD"), F.when(k % 3 == 0, "năm"), none.cast("string")).alias("text"))


def unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, F.concat(F.lit('{"amount": 5, "raw": "'), "p_name", F.lit('"}'))).when(k % 3 == 1, F.lit('{"amount": 5, "raw": " "}')).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.unwrap_object(v).alias("value"))


def reason_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Theo Điều 5. "), F.initcap("p_name"), F.lit(" thiếu; "), F.lower("p_type"), F.lit(".\n- "), F.col("p_brand"), F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(X.split_reason(t)).alias("i", "part"))


def joined_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir).groupBy(K).agg(F.array_sort(F.collect_list(F.struct(N, F.col("flag"), F.col("pk")))).alias("x"))
    halves = l.select(K, F.transform("x", lambda s: s["flag"]).alias("top"), F.concat(F.transform(F.slice("x", -1, 1), lambda s: s["flag"]), F.array(F.lit("tail"))).alias("bottom"))
    return P.join_halves(halves).select(K, F.array_join("lines", "").alias("text"))


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    j = F.to_json(F.struct(F.col("p_name").alias("khoá"), F.struct(F.array(F.concat(F.lit("điều "), k.cast("string")), F.col("p_brand")).alias("b")).alias("a")))
    return S.json_strings(table(spark, sf_dir, "part").select(k.alias("id"), j.alias("json")))


# -- registry and corpus -------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part")
    text = F.concat(F.lit("# "), "p_name", F.lit("\r\n\r\n"), "p_type")
    return s.filter("p_partkey % 6 <> 5").select(F.concat(F.lit("f"), "p_partkey", F.lit(".md")).alias("file"), text.alias("text"), F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256).alias("sha256"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.concat(F.lit("# "), "p_name", F.lit("\n\n"), "p_type")
    return s.filter("p_partkey % 4 <> 3").select(
        F.concat(F.lit("f"), k, F.lit(".md")).alias("file"), F.when(k % 3 == 0, F.col("p_brand")).otherwise("").alias("title"), F.when(k % 5 == 0, "law").alias("doc_type"), F.when(k % 2 == 0, "2010-05-06").alias("effective_from"),
        F.when(k % 7 == 0, "0").otherwise(F.sha2(text, 256)).alias("sha256"), F.when(k % 3 == 1, "who").alias("approved_by"), F.col("p_brand").alias("doc_no"), F.concat(F.lit("s"), k % 3).alias("reg_set"),
        F.when(k % 4 == 1, F.concat(F.lit("gazette "), "p_size")).alias("official_source"), F.when(k % 3 == 1, F.concat(F.lit("2020-01-0"), k % 9 + 1)).alias("approved_at"), F.lit("v1").alias("corpus_version"),
    )


_REG = r"""t AS (SELECT p_partkey AS k, 'f' || p_partkey || '.md' AS file, p_name, p_type, p_brand, p_size, sha256('# ' || p_name || chr(10) || chr(10) || p_type) AS h FROM part), f AS (SELECT * FROM t WHERE k % 6 <> 5),
 r AS (SELECT *, CASE WHEN k % 7 = 0 THEN '0' ELSE h END AS sha256, CASE WHEN k % 3 = 1 THEN 'who' ELSE '' END AS approved_by, 's' || (k % 3) AS reg_set FROM t WHERE k % 4 <> 3)"""


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.file_hashes(_files(spark, sf_dir))


def planned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.plan_entries(_files(spark, sf_dir), _registry(spark, sf_dir), [("f1", "decree")]).select("file", "title", "doc_type", "effective_from")


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_metadata(_files(spark, sf_dir).select("file"), _registry(spark, sf_dir))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, skipped = C.seed(_files(spark, sf_dir), _registry(spark, sf_dir), require_approval=True)
    one = chunks.select("file", F.col("chunk_id").alias("what"), "reg_set")
    return one.unionByName(skipped.select("file", F.col("status").alias("what"), F.lit(None).cast("string").alias("reg_set")))


def audit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.audit_order(C.registry_audit(_registry(spark, sf_dir), _files(spark, sf_dir)))


def unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("field_set_id"), F.array(F.concat(F.lit("r"), F.col("s_suppkey") % 3), F.lit("r1"), F.lit("r9")).alias("regulation_sets"))
    return C.unlink_set(s, "r1").select("field_set_id", F.array_join("regulation_sets", ",").alias("sets"))


def active_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(F.concat(F.lit("set"), k).alias("id"), F.when(k % 3 == 0, "user").otherwise("default").alias("source"), (k * 7919 % 1009).alias("mtime"), (k % 5 != 0).alias("usable"))
    return C.active_set(s, "set2").withColumn("saved", F.lit("set2")).unionByName(C.active_set(s, "set5").withColumn("saved", F.lit("set5")))


def spelling_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return C.corpus_texts(p.select(F.col("p_type").alias("text")), p.select(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("text")))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir).groupBy(K).agg(F.collect_set(F.concat(F.lit("f"), F.col(N))).alias("fields"))
    day = F.when(F.col(K) % 2 == 0, "2024-01-02")
    return l.select(K, G.request_signature("p1", F.lit("abc"), day, F.col("fields")).alias("signature"))


def asked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of dossiers, each distinct one answered once: the least part of its brand."""
    l = _lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_brand"), "pk")
    p = table(spark, sf_dir, "part")
    answer = lambda q: q.join(p.groupBy("p_brand").agg(F.min("p_partkey").alias("best")), "p_brand")
    return R.ask_once(l.select(K, "p_brand"), answer, ["p_brand"]).groupBy(K).agg(F.min("best").alias("best"), F.count("*").alias("asked"))


def query_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir).groupBy(K).agg(F.transform(F.array_sort(F.collect_list(F.struct(N, "flag"))), lambda s: s["flag"]).alias("q"))
    return l.select(K, F.array_join(R.ordered_distinct(F.col("q")), ",").alias("queries"))


# -- pages ---------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of orders with a text layer, and what their images read."""
    l, p = _lines(spark, sf_dir), F.col("pk")
    words = F.concat(F.lit("alpha beta gamma word"), p % 4)
    pages = l.select(F.col(K).alias("doc_id"), F.col(N).alias("page_index"), words.alias("text"), (p % 300).alias("chars"), (p % 3 != 0).alias("trusted"))
    seen = F.when(F.col("flag") == "N", "quite another reading").otherwise(words)
    return pages, l.filter("pk % 5 <> 0").select(F.col(K).alias("doc_id"), F.col(N).alias("page_index"), seen.alias("text"))


_PAGES = f"""{_L}, p AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, 'alpha beta gamma word' || (pk % 4) AS text, pk % 300 AS chars, pk % 3 <> 0 AS trusted, CASE WHEN flag = 'N' THEN 'quite another reading' ELSE 'alpha beta gamma word' || (pk % 4) END AS image, pk % 5 <> 0 AS seen, flag FROM l),
 x AS (SELECT doc_id, arg_max(struct_pack(seen := seen, flag := flag), struct_pack(c := chars, i := -i)) AS b FROM p WHERE trusted GROUP BY 1), v AS (SELECT p.*, trusted AND NOT coalesce(b.seen AND b.flag = 'N', false) AS sure FROM p LEFT JOIN x USING (doc_id))"""


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after the cross-check of each document's densest page: from text or image."""
    pages, images = _pages(spark, sf_dir)
    return P.read_hybrid(P.verify_text_layer(pages, images), images).select("doc_id", "page_index", "source", "text")


def page_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _ = _pages(spark, sf_dir)
    skip = pages.filter("chars % 2 = 0").select("doc_id", "page_index")
    plan = P.read_plan(P.restrict(pages, skip))
    return plan.select("doc_id", F.array_join("text_pages", ",").alias("text_pages"), F.array_join("image_pages", ",").alias("image_pages"))


# -- check sets and drafts -------------------------------------------------------------------------------------


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = _lines(spark, sf_dir), F.col("pk")
    label = F.when(p % 6 == 0, F.concat(F.lit("  Tiền  cọc "), p % 3, F.lit("; "))).when(p % 6 == 1, "Ngày ký").when(p % 6 == 2, "x").otherwise(F.concat(F.lit("Mục "), p % 4))
    kind = F.when(p % 6 == 1, "date").when(p % 2 == 0, "number").otherwise("list")
    return l.select(F.col(K).alias("doc_id"), F.col(N).alias("ord"), label.alias("label"), kind.alias("value_type"), F.when(p % 4 == 0, "declaration").otherwise("any").alias("check_type"), F.when(p % 5 == 0, False).alias("required"), (F.col("flag") == "R").alias("is_signed_date"))


_DRAFTS = f"""{_L}, s AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE pk % 6 WHEN 0 THEN 'Tiền cọc ' || (pk % 3) WHEN 1 THEN 'Ngày ký' WHEN 2 THEN 'x' ELSE 'Mục ' || (pk % 4) END AS label, CASE WHEN pk % 6 = 0 THEN 'money' WHEN pk % 6 = 1 THEN 'date' WHEN pk % 2 = 0 THEN 'number' ELSE 'text' END AS kind,
 CASE WHEN pk % 4 = 0 THEN 'declaration' ELSE 'regulated' END AS chk, CASE WHEN pk % 5 = 0 THEN false ELSE pk % 4 <> 0 END AS req, flag = 'R' AS marked FROM l), d AS (SELECT * FROM s WHERE length(label) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(label) ORDER BY ord) = 1)"""


def sane_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sanitize_drafts(_drafts(spark, sf_dir)).select("doc_id", "ord", "label", "value_type", "check_type", "required", "is_signed_date")


def merged_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.sanitize_drafts(_drafts(spark, sf_dir)).select("doc_id", "ord", "label")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, " ngày KÝ ").when(F.col("o_orderkey") % 3 == 1, " ").otherwise("Khác").alias("label"))
    return E.merge_drafts(rows, d).select("doc_id", "label", "drafted")


def typed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.sanitize_drafts(_drafts(spark, sf_dir)).select(F.col("doc_id").alias("set_id"), F.concat(F.lit("k"), "ord").alias("field_key"), "value_type")
    return E.keys_of_type(d, "money", "date").select("set_id", F.array_join("keys", ",").alias("keys"))


def set_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    entry = F.struct(F.when(k % 4 == 0, "list").otherwise("text").alias("value_type"))
    catalog = F.when(k % 5 == 0, F.create_map().cast("map<string, struct<value_type: string>>")).otherwise(F.create_map(F.lit("a"), entry))
    sets = table(spark, sf_dir, "part").select(F.when(k % 3 == 0, F.concat(F.lit("Set "), k)).otherwise(F.concat(F.lit("set-"), k)).alias("id"), F.when(k % 2 == 0, "name").otherwise(" ").alias("display_name"), catalog.alias("fields_catalog"), F.struct(F.array(F.lit("a")).alias("always_check")).alias("field_check_mode"))
    return S.check_set_problems(sets)


def set_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = _lines(spark, sf_dir), F.col("pk")
    rows = l.select(F.col(K).alias("set_id"), F.concat(F.lit("k"), F.col(N)).alias("field_key"), F.when(p % 5 == 0, " ").otherwise(F.concat(F.lit(" L"), p)).alias("label"), F.when(p % 2 == 0, "a; b,,\nc").otherwise("").alias("alts"), F.lit("text").alias("value_type"), F.lit("regulated").alias("check_type"), (p % 3 == 0).alias("required"))
    return S.check_set_json(rows)


def upload_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_custkey").alias("dossier"), F.col("o_orderkey").alias("ord"), F.concat("o_orderstatus", F.lit(".pdf")).alias("name"), F.encode("o_orderpriority", "UTF-8").alias("content"))
    return S.in_upload_order(f).select("dossier", "ord", "doc_id", F.col("size_bytes").cast("long").alias("size_bytes"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ok = F.concat(F.lit('{"fields": {"a": {"value": "'), "o_orderpriority", F.lit('", "confidence": 0.5}, "b": {"value": {"raw": "r", "amount": 1}, "evidence_quote": "q"}, "z": {"value": "x"}}}'))
    reply = F.when(k % 4 == 0, F.lit("no json")).when(k % 4 == 1, F.lit('{"fields": {}}')).otherwise(ok)
    return E.model_answers(table(spark, sf_dir, "orders").select(k.alias("doc_id"), reply.alias("reply")), ["a", "b"])


QUERIES = {
    "mean_accuracy": mean_accuracy,
    "run_metrics": run_metrics,
    "segment_confidence": segment_confidence,
    "letter_confidence": letter_confidence,
    "day_window_cutoff": day_window,
    "key_union": key_union,
    "golden_merge": golden_merge,
    "latest_rows": latest_rows,
    "selected_union": selected_union,
    "machine_values": machine_values,
    "blocking_fields": blocking,
    "checkable_fields": checkable,
    "review_filter": review_filter,
    "overall_guard": judged,
    "respell_guard": respelled,
    "region_boxes": region_boxes,
    "label_matches": label_matches,
    "markdown_lines": markdown_lines,
    "display_values": display_values,
    "value_texts": value_texts,
    "unwrapped_objects": unwrapped,
    "reason_parts": reason_parts,
    "joined_halves": joined_halves,
    "json_strings": json_texts,
    "file_hashes": file_hashes,
    "planned_entries": planned_entries,
    "chunk_metadata": chunk_metadata,
    "corpus_seed": seeded,
    "audit_places": audit_places,
    "unlinked_sets": unlinked,
    "active_set": active_set,
    "spelling_texts": spelling_texts,
    "request_signatures": signatures,
    "asked_once": asked_once,
    "query_order": query_order,
    "page_routes": page_routes,
    "page_plans": page_plans,
    "sane_drafts": sane_drafts,
    "merged_drafts": merged_drafts,
    "typed_keys": typed_keys,
    "check_set_problems": set_problems,
    "check_set_json": set_json,
    "upload_order": upload_order,
    "model_answers": model_answers,
}
SQL = {
    "mean_accuracy": "SELECT count(*) AS runs, round(avg(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 / 10 END), 4) AS cer, round(avg(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 7 / 7 END), 4) AS field_accuracy FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0",
    "run_metrics": f"""WITH {_L}, c AS (SELECT l_orderkey AS run_id, (l_linenumber - 1) % 7 AS m, pk % 50 AS n FROM l), s AS (SELECT run_id, CAST(coalesce(sum(n) FILTER (m = 0), 0) AS BIGINT) AS hit, CAST(coalesce(sum(n) FILTER (m = 1), 0) AS BIGINT) AS miss, coalesce(sum(n) FILTER (m = 2), 0) AS calls,
 coalesce(sum(n) FILTER (m = 3), 0) AS chars, coalesce(sum(n) FILTER (m = 4), 0) AS fields, CAST(coalesce(sum(n) FILTER (m >= 5), 0) AS BIGINT) AS retry_total FROM c GROUP BY 1)
 SELECT run_id, hit, miss, round(hit / nullif(hit + miss, 0), 3) AS hit_ratio, CAST(floor(chars / 3) AS BIGINT) AS tokens_est, round(fields / nullif(calls, 0), 1) AS fields_per_call, retry_total FROM s""",
    "segment_confidence": f"WITH {_L}, s AS (SELECT *, coalesce(sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM l) SELECT l_orderkey AS doc_id, CAST(g AS BIGINT) AS segment, round(avg(d), 6) AS conf FROM s WHERE flag <> 'R' GROUP BY 1, 2",
    "letter_confidence": f"WITH {_L} SELECT l_orderkey AS doc_id, round(avg(d) FILTER (pk % 3 <> 0), 4) AS avg_confidence FROM l GROUP BY 1",
    "day_window_cutoff": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS runs FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' GROUP BY 1",
    "key_union": f"WITH {_FIELDS} SELECT dossier, field_key, min(ord) AS first_seen FROM f GROUP BY 1, 2",
    "golden_merge": f"WITH {_FIELDS} SELECT dossier, field_key, coalesce(arg_min(value, ord) FILTER (value NOT IN ('', '[]')), arg_max(value, ord)) AS value FROM f GROUP BY 1, 2",
    "latest_rows": f"WITH {_FIELDS} SELECT dossier, field_key, arg_max(value, ord) AS value FROM f GROUP BY 1, 2",
    "selected_union": f"WITH {_L} SELECT l_orderkey % 1000 AS dossier, array_to_string(list_sort(list(DISTINCT 'k' || (pk % 9))), ',') AS keys FROM l GROUP BY 1",
    "machine_values": f"WITH {_L} SELECT l_orderkey, l_linenumber, CASE WHEN pk % 8 = 0 THEN flag || '''' WHEN pk % 4 = 0 THEN NULL ELSE flag END AS machine FROM l",
    "blocking_fields": f"WITH {_L} SELECT l_orderkey AS doc_id, 'f' || (pk % 2) AS block_field, 'C' || (arg_min(pk, l_linenumber) % 7) AS code FROM l WHERE pk % 3 <> 0 GROUP BY 1, 2",
    "checkable_fields": f"WITH {_REVIEWED} SELECT doc_id, count(*) AS total, count(*) FILTER (has) AS checked FROM r WHERE kind <> 'declaration' GROUP BY 1",
    "review_filter": f"WITH {_REVIEWED}, m AS (SELECT kind, unnest(list_filter(['all', CASE WHEN has THEN 'has' ELSE 'empty' END, CASE WHEN has AND d < 0.04 THEN 'lowconf' END], lambda x: x IS NOT NULL)) AS shown FROM r) SELECT kind AS check_type, count(*) AS n, shown FROM m GROUP BY 1, 3",
    "overall_guard": f"""WITH {_REVIEWED}, c AS (SELECT doc_id, verdict FROM r WHERE has AND kind <> 'declaration' UNION ALL SELECT doc_id, 'NEEDS_SUPPLEMENT' FROM r WHERE selected AND NOT has), w AS (SELECT doc_id, bool_or(verdict = 'FAIL') AS f, bool_or(verdict = 'NEEDS_SUPPLEMENT') AS n FROM c GROUP BY 1), a AS (SELECT doc_id, bool_or(kind = 'regulated' AND has) AS asked FROM r GROUP BY 1)
 SELECT doc_id, CASE WHEN coalesce(f, false) THEN 'FAIL' WHEN coalesce(n, false) OR NOT asked THEN 'NEEDS_SUPPLEMENT' ELSE 'PASS' END AS overall_verdict, asked, CASE WHEN NOT asked THEN 'NO_REGULATED_FIELDS' END AS flag FROM a LEFT JOIN w USING (doc_id)""",
    "respell_guard": "SELECT p_partkey, p_partkey % 4 = 0 AS ok FROM part",
    "region_boxes": f"WITH {_L} SELECT l_orderkey AS doc_id, count(*) AS inside FROM l WHERE pk % 10 / 10 + 0.03125 BETWEEN 0.2 AND 0.7 AND 1 - (pk % 7 / 7 + 0.03125) BETWEEN 0.2 AND 0.9 GROUP BY 1",
    "label_matches": "SELECT p_partkey, p_partkey % 3 <> 2 AS found FROM part",
    "markdown_lines": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ': `' || p_brand || '`' WHEN 2 THEN '' WHEN 3 THEN '' ELSE p_name || ' x' END AS text FROM part",
    "display_values": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '1.000 USD' WHEN o_orderkey % 3 <> 0 THEN format('{:,}', o_custkey * 1000) || ' USD' || CASE WHEN o_orderkey % 2 = 0 THEN ' / năm' ELSE '' END WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '—' END AS shown FROM orders""",
    "value_texts": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) || ' USD' || CASE WHEN o_orderkey % 3 = 0 THEN ' năm' ELSE '' END WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '.5 USD' || CASE WHEN o_orderkey % 3 = 0 THEN ' năm' ELSE '' END WHEN 2 THEN CAST(o_orderkey % 100 AS VARCHAR) ELSE o_orderpriority || ' x' END AS text FROM orders",
    "unwrapped_objects": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN p_name END AS value FROM part",
    "reason_parts": "SELECT p_partkey, unnest([0, 1, 2]) AS i, unnest(['Theo Điều 5.', array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ') || ' thiếu; ' || lower(p_type) || '.', '- ' || p_brand || '!']) AS part FROM part",
    "joined_halves": f"WITH {_L} SELECT l_orderkey, string_agg(flag, '' ORDER BY l_linenumber) || 'tail' AS text FROM l GROUP BY 1",
    "json_strings": "SELECT p_partkey AS id, 'điều ' || p_partkey AS value FROM part",
    "file_hashes": f"WITH {_REG} SELECT file, h AS sha256 FROM f",
    "planned_entries": f"WITH {_REG} SELECT f.file, CASE WHEN r.k IS NOT NULL AND f.k % 3 = 0 THEN f.p_brand ELSE f.p_name END AS title, CASE WHEN r.k IS NOT NULL AND f.k % 5 = 0 THEN 'law' WHEN contains(f.file, 'f1') THEN 'decree' ELSE 'other' END AS doc_type, CASE WHEN r.k IS NOT NULL AND f.k % 2 = 0 THEN '2010-05-06' ELSE '2000-01-01' END AS effective_from FROM f LEFT JOIN r USING (k)",
    "chunk_metadata": f"WITH {_REG} SELECT f.file, coalesce(r.p_brand, '') AS doc_no, CASE WHEN r.k % 4 = 1 THEN 'gazette ' || r.p_size ELSE '' END AS official_source, CASE WHEN r.k IS NULL THEN '' ELSE 'v1' END AS corpus_version, coalesce(approved_by, '') AS approved_by, CASE WHEN r.k % 3 = 1 THEN '2020-01-0' || (r.k % 9 + 1) ELSE '' END AS approved_at, coalesce(sha256[1:16], '') AS content_sha256, coalesce(reg_set, '') AS reg_set FROM f LEFT JOIN r USING (k)",
    "corpus_seed": rf"""WITH {_REG}, s AS (SELECT f.*, reg_set, CASE WHEN r.k IS NULL THEN 'unregistered' WHEN sha256 <> f.h THEN 'hash_mismatch' WHEN approved_by = '' THEN 'unapproved' ELSE 'ok' END AS status FROM f LEFT JOIN r USING (k)), c AS (SELECT *, '# ' || p_name || chr(13) || chr(10) || chr(13) || chr(10) || p_type AS t FROM s)
 SELECT file, CASE WHEN status = 'ok' THEN file || '::0::' || sha1(t)[1:12] ELSE status END AS what, CASE WHEN status = 'ok' THEN reg_set END AS reg_set FROM c""",
    "audit_places": f"WITH {_REG}, s AS (SELECT coalesce(f.file, r.file) AS file, CASE WHEN r.k IS NULL THEN 'unregistered' WHEN f.k IS NULL THEN 'missing_file' WHEN sha256 <> f.h THEN 'hash_mismatch' WHEN approved_by = '' THEN 'unapproved' ELSE 'ok' END AS status FROM f FULL JOIN r USING (k)) SELECT file, status, CAST(list_position(['missing_file', 'hash_mismatch', 'unapproved', 'unregistered', 'ok'], status) AS INTEGER) AS severity FROM s",
    "unlinked_sets": "SELECT s_suppkey AS field_set_id, CASE WHEN s_suppkey % 3 = 1 THEN 'r9' ELSE 'r' || (s_suppkey % 3) || ',r9' END AS sets FROM supplier",
    "active_set": "SELECT 'set2' AS id, 'set2' AS saved UNION ALL (SELECT 'set' || c_custkey AS id, 'set5' AS saved FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0 ORDER BY c_custkey * 7919 % 1009 DESC, 'set' || c_custkey DESC LIMIT 1)",
    "spelling_texts": "SELECT p_type AS text FROM part UNION SELECT p_brand FROM part WHERE p_size % 2 = 0",
    "request_signatures": f"WITH {_L} SELECT l_orderkey, sha256('p1#abc#' || CASE WHEN l_orderkey % 2 = 0 THEN '2024-01-02' ELSE '' END || '#' || string_agg('f' || l_linenumber, ',' ORDER BY l_linenumber)) AS signature FROM l GROUP BY 1",
    "asked_once": f"WITH {_L}, b AS (SELECT p_brand, min(p_partkey) AS best FROM part GROUP BY 1) SELECT l_orderkey, min(best) AS best, count(*) AS asked FROM l JOIN part ON p_partkey = pk JOIN b USING (p_brand) GROUP BY 1",
    "query_order": f"WITH {_L}, d AS (SELECT l_orderkey, flag, min(l_linenumber) AS n FROM l GROUP BY 1, 2) SELECT l_orderkey, string_agg(flag, ',' ORDER BY n) AS queries FROM d GROUP BY 1",
    "page_routes": f"WITH {_PAGES} SELECT doc_id, i AS page_index, CASE WHEN sure THEN 'text' ELSE 'image' END AS source, CASE WHEN sure THEN text ELSE image END AS text FROM v WHERE sure OR seen",
    "page_plans": f"WITH {_PAGES}, k AS (SELECT *, bool_or(chars % 2 = 1) OVER (PARTITION BY doc_id) AS left_over FROM p) SELECT doc_id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (trusted), '') AS text_pages, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (NOT trusted), '') AS image_pages FROM k WHERE chars % 2 = 1 OR NOT left_over GROUP BY 1",
    "sane_drafts": f"WITH {_DRAFTS}, w AS (SELECT *, coalesce(min(CASE WHEN kind = 'date' AND marked THEN ord END) OVER (PARTITION BY doc_id), min(CASE WHEN kind = 'date' THEN ord END) OVER (PARTITION BY doc_id)) AS pick FROM d) SELECT doc_id, ord, label, kind AS value_type, chk AS check_type, req AS required, coalesce(ord = pick, false) AS is_signed_date FROM w",
    "merged_drafts": f"WITH {_DRAFTS} SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN ' ngày KÝ ' ELSE 'Khác' END AS label, false AS drafted FROM orders WHERE o_orderkey % 3 <> 1 UNION ALL SELECT doc_id, label, true FROM d LEFT JOIN orders ON o_orderkey = doc_id WHERE NOT (o_orderkey IS NOT NULL AND doc_id % 3 = 0 AND lower(label) = 'ngày ký')",
    "typed_keys": f"WITH {_DRAFTS} SELECT doc_id AS set_id, string_agg('k' || ord, ',' ORDER BY ord) AS keys FROM d WHERE kind IN ('money', 'date') GROUP BY 1",
    "check_set_problems": """SELECT 'set-' || p_partkey AS id, unnest(list_filter([CASE WHEN p_partkey % 2 <> 0 THEN 'no name' END, CASE WHEN p_partkey % 5 = 0 THEN 'no fields' END, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 5 <> 0 THEN 'unknown value type' END, CASE WHEN p_partkey % 5 = 0 THEN 'required field is not in the catalog' END], lambda x: x IS NOT NULL)) AS problem FROM part WHERE p_partkey % 3 <> 0
 UNION ALL SELECT 'Set ' || p_partkey, unnest(list_filter(['bad id', CASE WHEN p_partkey % 2 <> 0 THEN 'no name' END, CASE WHEN p_partkey % 5 = 0 THEN 'no fields' END, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 5 <> 0 THEN 'unknown value type' END, CASE WHEN p_partkey % 5 = 0 THEN 'required field is not in the catalog' END], lambda x: x IS NOT NULL)) FROM part WHERE p_partkey % 3 = 0""",
    "check_set_json": f"""WITH {_L} SELECT l_orderkey AS set_id, '{{"fields_catalog":{{' || string_agg('"k' || l_linenumber || '":{{"label":"L' || pk || '",' || CASE WHEN pk % 2 = 0 THEN '"label_alts":["a","b","c"],' ELSE '' END || '"value_type":"text","check_type":"regulated"}}', ',' ORDER BY l_linenumber)
 || '}},"field_check_mode":{{"always_check":[' || coalesce(string_agg('"k' || l_linenumber || '"', ',' ORDER BY l_linenumber) FILTER (pk % 3 = 0), '') || ']}}}}' AS json FROM l WHERE pk % 5 <> 0 GROUP BY 1""",
    "upload_order": "SELECT o_custkey AS dossier, o_orderkey AS ord, 'doc' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS doc_id, CAST(octet_length(encode(o_orderpriority)) AS BIGINT) AS size_bytes FROM orders",
    "model_answers": "SELECT o_orderkey AS doc_id, unnest(['a', 'b']) AS field_key, unnest([o_orderpriority, 'r']) AS value, unnest([NULL, 'q']) AS quote, unnest([0.5, NULL]) AS confidence FROM orders WHERE o_orderkey % 4 >= 2",
}
