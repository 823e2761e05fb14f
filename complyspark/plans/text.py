"""String, date, number and money functions over `documents`, `benchmark`, `orders` and `part`.

Typed values are made from keys, so that every shape (dates that don't exist, bare
and grouped numbers, notes and periods) occurs in a fixed share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .audit import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.normalize_text(F.concat(F.lit("  \t"), "text", F.lit("\r\n\n\n \t tail\t\t "))), 256).alias("sha"))


def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.sha2(X.fold_diacritics(F.col("text")), 256).alias("folded"), F.sha2(X.accent_fold(F.col("text")), 256).alias("key"), (F.length(X.fold_aligned(F.col("text"))) == F.length("text")).alias("aligned"))


def short_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.take_short_quote(F.col("text")).alias("quote"), X.slug(F.concat_ws(" ", "source", "lang", "text")).alias("slug"), X.mask(F.concat("source", F.col("doc_id").cast("string"))).alias("masked"))


def junk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.junk_ratio(F.col("text")).alias("junk"))


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the golden passage of their number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("golden"))
    d = _docs(spark, sf_dir).withColumn("item_id", F.col("doc_id") % 40)
    return d.join(b, "item_id").select("doc_id", F.round(X.text_agreement(F.col("text"), F.col("golden")), 6).alias("f1"))


def skeleton_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    w = F.substring_index("p_name", " ", 1)
    return p.select("p_partkey", X.skeleton(w).alias("skeleton"), X.is_subsequence(X.skeleton(w), w).alias("inside"), X.match_case(F.upper(w), F.col("p_name")).alias("upper"), X.match_case(F.initcap(w), F.col("p_name")).alias("first"))


def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit(" ,; "), "text", F.lit(" – ")))
        .when(k % 6 == 1, F.lit("Điền theo thực tế"))
        .when(k % 6 == 2, F.lit(" -:. "))
        .when(k % 6 == 3, F.concat(F.lit("nội   dung chính của bên B "), k.cast("string"), F.lit(" theo phụ lục 05 của hợp đồng")))
        .when(k % 6 == 4, F.lit("theo phụ lục 05"))
        .otherwise(F.lit("2024-05-15"))
    )
    return _docs(spark, sf_dir).select("doc_id", X.clean_value(raw, "theo phu luc").alias("value"), X.is_template_hint(raw).alias("hint"), X.is_boilerplate_clause(F.when(k % 2 == 0, F.lit("Theo quy định của pháp luật.")).otherwise(raw)).alias("boilerplate"))


def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rules = [("widget", "decree"), ("ring", "circular"), ("bolt", "law")]
    return p.select("p_partkey", X.infer_doc_type(F.col("p_name"), rules, "other").alias("doc_type"), X.title_of(F.col("p_name"), F.concat(F.lit("x\n## "), F.col("p_type"), F.lit("\ny"))).alias("title"), X.roman((F.col("p_size") * 37) % 3999 + 1).alias("roman"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin like headings of each kind, and some that only seem to."""
    p = table(spark, sf_dir, "part")
    heads = ("Chương IV ", "Điều ", "MỤC 2 ", "Phần thứ nhất ", "dieu 7b: ", "Điều 5 quy định ", "Chương trình ", "section 3a ", "  Article 12 . ", "Phần", "")
    line = F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("p_partkey") % len(heads) + 1).cast("int")), F.when(F.col("p_partkey") % len(heads) == 1, F.concat("p_size", F.element_at(F.array(*[F.lit(x) for x in (".", " ", ":")]), (F.col("p_size") % 3 + 1).cast("int")), F.lit(" "))).otherwise(""), "p_name")
    return p.select("p_partkey", X.heading_level(line).alias("level"), X.strip_numbering(F.concat(F.lit("Điều "), "p_size", F.lit(". "), "p_name")).alias("rest"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"), X.content_hash(F.concat("text", F.lit("\r\n"))).alias("sha256"))


def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    other = F.concat_ws(" ", F.reverse("p_brand"), F.substring("p_name", 3, 99))
    return p.select("p_partkey", F.levenshtein("p_name", other).cast("long").alias("chars"))


# -- dates, numbers, money -----------------------------------------------------------------------------


def _date_text() -> Column:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    dmy = F.date_format(d, "d/M/yyyy")
    return (
        F.when(k % 6 == 0, F.concat(F.lit("signed on "), dmy))
        .when(k % 6 == 1, F.concat(F.lit("31/02/2025 then "), F.date_format(d, "dd-MM-yyyy")))
        .when(k % 6 == 2, F.concat(F.lit("ngày "), F.date_format(d, "d"), F.lit(" tháng "), F.date_format(d, "M"), F.lit(" năm "), F.date_format(d, "yyyy")))
        .when(k % 6 == 3, F.concat(F.lit("tháng "), F.date_format(d, "MM/yyyy")))
        .when(k % 6 == 4, F.date_format(d, "yyyy-M-d"))
        .otherwise(F.concat(F.lit("8 gio/ngay, "), k.cast("string"), F.lit(" gio/tuan")))
    )


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _date_text()
    return table(spark, sf_dir, "orders").select("o_orderkey", N.parse_date_any(t).alias("any_date"), N.normalize_signed_date(t).alias("signed"), N.date_to_int(t, 99991231).alias("as_int"))


def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    whole = F.floor("o_totalprice").cast("long")
    t = (
        F.when(k % 5 == 0, F.concat(F.lit("luong: "), whole, F.lit(" usd/tháng (khoan "), k, F.lit(")")))
        .when(k % 5 == 1, F.concat(whole, F.lit(" jpy")))
        .when(k % 5 == 2, F.concat(F.lit("so "), k % 2000))
        .when(k % 5 == 3, F.concat(F.lit("EUR: "), whole, F.lit(" x")))
        .otherwise(F.lit("none"))
    )
    m = N.parse_money(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", m["amount"].alias("amount"), m["currency"].alias("currency"), m["period"].alias("period"), m["note"].alias("note"))


def _number_text() -> Column:
    k = F.col("o_orderkey")
    return F.when(k % 7 == 0, k.cast("string")).when(k % 7 == 1, F.concat(k % 900 + 1, F.lit(".000"))).when(k % 7 == 2, F.lit("2.5")).when(k % 7 == 3, F.concat(k, F.lit(".00"))).when(k % 7 == 4, F.concat(F.lit("-"), k)).when(k % 7 == 5, F.lit("")).otherwise(F.lit("five"))


def to_int_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _number_text()
    rule = N.check_positive_integer(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.to_int(t).alias("n"), rule["verdict"].alias("verdict"), N.parse_int(t).alias("digits"))


def numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, F.concat(k, F.lit(",50"))).when(k % 4 == 1, F.lit("1.234,5")).when(k % 4 == 2, F.lit("Hà  Nội")).otherwise(F.lit(""))
    b = F.when(k % 4 == 0, F.concat(k, F.lit(".5"))).when(k % 4 == 1, F.lit("1,234.5")).when(k % 4 == 2, F.lit("thanh pho ha noi")).otherwise(F.when(k % 8 == 3, F.lit("")).otherwise(F.lit("x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.numeric(a).alias("x"), N.numeric(b).alias("y"), N.values_match(a, b).alias("same"))


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "number").when(k % 3 == 1, "date").otherwise("text")
    v = F.when(k % 3 == 0, F.concat(k * 37, F.lit(" nguoi"))).when(k % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.col("o_orderpriority"))
    m = N.manual_value(F.when(k % 3 == 0, (k * 37).cast("string")).otherwise(v), kind)
    p = F.element_at(F.array(F.lit("/month"), F.lit("tháng"), F.lit("NAM"), F.lit("day"), F.lit("x")), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.coerce_typed(v, kind).alias("coerced"), m["value"].alias("manual"), m["error"].alias("error"), N.clean_period(p).alias("period"), N.fit_context(k.cast("int")).alias("ctx"))


def signed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    own = F.when(k % 3 == 0, d).otherwise(F.lit(""))
    v = N.signed_date_of(own, d, k % 3 == 1, (k % 10) / 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("signed"), F.date_format(N.parse_iso(v), "yyyyMMdd").alias("compact"))


_A = "strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D'))"
_DT = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-01') ELSE {0} END"""
QUERIES = {
    "text_normalize": text_normalize,
    "fold_text": fold_text,
    "short_quote": short_quote,
    "junk_ratio": junk_ratio,
    "token_f1": token_f1,
    "skeleton_words": skeleton_words,
    "clean_values": clean_values,
    "doc_types": doc_types,
    "heading_levels": heading_levels,
    "chunk_ids_sha1": hashes,
    "edit_distances": edit_distances,
    "date_parse": date_parse,
    "money_parse": money_parse,
    "to_int_rule": to_int_rule,
    "numeric_match": numeric_match,
    "typed_values": typed_values,
    "signed_dates": signed_dates,
}
SQL = {
    "text_normalize": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace('  ' || chr(9) || text || chr(13) || chr(10) || chr(10) || chr(10) || ' ' || chr(9) || ' tail' || chr(9) || chr(9) || ' ', '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS sha FROM documents""",
    "fold_text": f"SELECT doc_id, sha256({_A.format('text')}) AS folded, sha256(lower(regexp_replace({_A.format('text')}, '[^0-9A-Za-z]', '', 'g'))) AS key, true AS aligned FROM documents",
    "short_quote": rf"""SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:25], ' ') AS quote, trim(regexp_replace(lower({_A.format("source || ' ' || lang || ' ' || text")}), '[^a-z0-9]+', '-', 'g'), '-') AS slug, '••••' || right(source || CAST(doc_id AS VARCHAR), 4) AS masked FROM documents""",
    "junk_ratio": r"""SELECT doc_id, CASE WHEN len(w) >= 20 THEN round(len(list_filter(w, lambda x: regexp_matches(trim(x, '.,;:()[]{}"''-–—/*|'), '\p{L}[^\p{L}\p{N}]\p{L}|\p{Ll}\p{Lu}'))) / len(w), 3) END AS junk
 FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) >= 2 AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 2) AS w FROM documents)""",
    "token_f1": f"""SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) END AS f1 FROM (SELECT doc_id,
 list_filter(list_distinct(regexp_split_to_array(lower({_A.format("d.text")}), '[^a-z0-9]+')), lambda t: length(t) >= 3) AS a, list_filter(list_distinct(regexp_split_to_array(lower({_A.format("b.text")}), '[^a-z0-9]+')), lambda t: length(t) >= 3) AS b
 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)""",
    "skeleton_words": "SELECT p_partkey, translate(w, 'aeiouy', '') AS skeleton, true AS inside, upper(p_name) AS upper, upper(p_name[1]) || p_name[2:] AS first FROM (SELECT *, split_part(p_name, ' ', 1) AS w FROM part)",
    "clean_values": r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN nullif(regexp_replace(trim(' ,; ' || text || ' – ', E',;:.–—•·- \t"''“”‘’'), '\s+', ' ', 'g'), '') WHEN 3 THEN 'nội dung chính của bên B ' || CAST(doc_id AS VARCHAR) WHEN 4 THEN 'theo phụ lục 05' WHEN 5 THEN '2024-05-15' END AS value,
 doc_id % 6 = 1 AS hint, doc_id % 2 = 0 AS boilerplate FROM documents""",
    "doc_types": """SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 'decree' WHEN p_name LIKE '%ring%' THEN 'circular' WHEN p_name LIKE '%bolt%' THEN 'law' ELSE 'other' END AS doc_type, p_type AS title,
 repeat('M', CAST(floor(n / 1000) AS INT)) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][CAST(floor(n / 100) % 10 AS INT) + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][CAST(floor(n / 10) % 10 AS INT) + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][CAST(n % 10 AS INT) + 1] AS roman
 FROM (SELECT *, (p_size * 37) % 3999 + 1 AS n FROM part)""",
    "heading_levels": r"""WITH l AS (SELECT *, lower(trim(['Chương IV ', 'Điều ', 'MỤC 2 ', 'Phần thứ nhất ', 'dieu 7b: ', 'Điều 5 quy định ', 'Chương trình ', 'section 3a ', '  Article 12 . ', 'Phần', ''][p_partkey % 11 + 1]
  || CASE WHEN p_partkey % 11 = 1 THEN CAST(p_size AS VARCHAR) || ['.', ' ', ':'][p_size % 3 + 1] || ' ' ELSE '' END || p_name)) AS t FROM part)
 SELECT p_partkey, CAST(CASE WHEN regexp_matches(t, '^(phần|phan|part)\s+') OR regexp_matches(t, '^(chương|chuong|chapter)\s+[ivxlc0-9]+([^0-9a-zà-ỹđ]|$)') THEN 2
  WHEN regexp_matches(t, '^(mục|muc|section)\s+[0-9]+([^0-9a-zà-ỹđ]|$)') OR regexp_matches(t, '^(điều|dieu|article)\s+[0-9]+[a-zđ]?\s*[.:]') THEN 3 END AS INTEGER) AS level, lower(p_name) AS rest FROM l""",
    "chunk_ids_sha1": "SELECT doc_id, source || '::' || CAST(doc_id AS VARCHAR) || '::' || sha1(text)[1:12] AS chunk_id, sha256(replace(text || chr(13) || chr(10), chr(13) || chr(10), chr(10))) AS sha256 FROM documents",
    "edit_distances": "SELECT p_partkey, CAST(levenshtein(p_name, reverse(p_brand) || ' ' || p_name[3:]) AS BIGINT) AS chars FROM part",
    "date_parse": f"SELECT o_orderkey, {_DT.format('NULL')} AS any_date, CASE WHEN o_orderkey % 6 = 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE coalesce({_DT.format('NULL')}, '') END AS signed, CAST(CASE WHEN length(g) >= 8 THEN CAST(g[1:8] AS INTEGER) ELSE 99991231 END AS INTEGER) AS as_int"
    " FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%-d%-m%Y') WHEN 1 THEN '31022025' WHEN 2 THEN strftime(o_orderdate, '%-d%-m%Y') WHEN 3 THEN strftime(o_orderdate, '%m%Y') WHEN 4 THEN strftime(o_orderdate, '%Y%-m%-d') ELSE '8' || CAST(o_orderkey AS VARCHAR) END AS g FROM orders)",
    "money_parse": """SELECT o_orderkey, CASE WHEN k IN (0, 1, 3) THEN w WHEN k = 2 AND (s = 0 OR s >= 1000) THEN s END AS amount, CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'JPY' WHEN 3 THEN 'EUR' END AS currency,
 CASE WHEN k = 0 THEN 'tháng' END AS period, CASE WHEN k = 0 THEN 'khoan ' || CAST(o_orderkey AS VARCHAR) END AS note FROM (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(floor(o_totalprice) AS BIGINT) AS w, o_orderkey % 2000 AS s FROM orders)""",
    "to_int_rule": """SELECT o_orderkey, n, CASE WHEN k = 5 THEN 'NEEDS_SUPPLEMENT' WHEN n >= 1 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE k WHEN 2 THEN 25 WHEN 3 THEN o_orderkey * 100 WHEN 4 THEN o_orderkey ELSE n END AS digits
 FROM (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(CASE o_orderkey % 7 WHEN 0 THEN o_orderkey WHEN 1 THEN (o_orderkey % 900 + 1) * 1000 WHEN 3 THEN o_orderkey WHEN 4 THEN -o_orderkey END AS BIGINT) AS n FROM orders)""",
    "numeric_match": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey + 0.5 WHEN 1 THEN 1234.5 END :: DOUBLE AS x, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey + 0.5 WHEN 1 THEN 1234.5 END :: DOUBLE AS y, NOT (o_orderkey % 4 = 3 AND o_orderkey % 8 <> 3) AS same FROM orders""",
    "typed_values": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN length(CAST(o_orderkey * 37 AS VARCHAR)) <= 6 THEN CAST(o_orderkey * 37 AS VARCHAR) END WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS coerced,
 CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey * 37 <= 1000000 THEN CAST(o_orderkey * 37 AS VARCHAR) END WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS manual,
 CASE WHEN o_orderkey % 3 = 0 AND o_orderkey * 37 > 1000000 THEN 'number out of range' END AS error, ['tháng', 'tháng', 'năm', 'ngày', NULL][o_orderkey % 5 + 1] AS period, CAST(least(32768, greatest(4096, ceil(o_orderkey / 4096) * 4096)) AS INTEGER) AS ctx FROM orders""",
    "signed_dates": """SELECT o_orderkey, s AS signed, CASE WHEN s <> '' THEN replace(s, '-', '') END AS compact FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 IN (0, 1) OR o_orderkey % 10 >= 5 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS s FROM orders)""",
}
