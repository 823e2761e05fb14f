"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query (trigrams.py). The
index has a posting (trigram, document) for every trigram that some query names;
postings are intersected per alternative of a query, the documents that answer a
query are candidates of its rule, and candidates are verified with the expression
itself. Rules without a mandatory trigram scan every document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, doc_id, keyed, release
from .trigrams import trigram_query


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: leftmost non-overlapping matches; least: code points
    that group `group` of a match must have, else the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


_KEYS = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), "[aA][pP][iI]_?[kK][eE][yY]"])
BASE = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    # runs of 32 or more are the same spans as all runs [0-9a-f]+ without the short ones
    Rule("hex", "[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: `_id, _k, trigram`, for the trigrams that the rules' queries name,
    over lower-cased whole texts (`_id, _k, text`); null texts have none."""
    grams = sorted({g for r in rules for a in trigram_query(r.pattern) or [] for g in a})
    has = F.filter(F.array([F.lit(g) for g in grams]), lambda g: F.contains(F.col("low"), g))
    return docs.select("_id", "_k", F.lower("text").alias("low")).select("_id", "_k", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`_id, _k, rules` (numbers): the documents whose postings answer a rule's query.
    The queries are a table of fixed size, as many rows as the rules have trigrams."""
    spark = index.sparkSession
    rows = [(n, k, g, len(a)) for n, r in enumerate(rules) for k, a in enumerate(trigram_query(r.pattern) or []) for g in sorted(a)]
    query = spark.createDataFrame(rows, "rule int, alternative int, trigram string, need int")
    met = index.join(F.broadcast(query), "trigram").groupBy("_id", "_k", "rule", "alternative").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return met.filter("n = need").groupBy("_id", "_k").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, number: int, asked: Column) -> Column:
    """Spans of one rule as an array of (start, rule, end), code points, end exclusive:
    the parts between matches and the matches themselves add up to positions."""
    text, pat = F.col("text"), rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all(text, '{pat}', 0)"
    keep = f"regexp_extract_all(text, '{pat}', {rule.group})"
    expr = f"""aggregate(
        transform(arrays_zip({found}, {keep}, slice(split(text, '{pat}', -1), 1, size({found}))), z -> named_struct('m', z['0'], 'v', z['1'], 'g', z['2'])),
        named_struct('pos', 0, 'out', cast(array() as array<struct<start:int,rule:int,end:int>>)),
        (acc, x) -> named_struct(
            'pos', acc.pos + length(x.g) + length(x.m),
            'out', if(length(x.v) < {rule.least}, acc.out, concat(acc.out, array(named_struct('start', acc.pos + length(x.g), 'rule', {number}, 'end', acc.pos + length(x.g) + length(x.m)))))),
        acc -> acc.out)"""
    none = F.expr("cast(array() as array<struct<start:int,rule:int,end:int>>)")
    return F.when(asked & F.regexp_like(text, F.lit(rule.pattern)), F.expr(expr)).otherwise(none)


def _scan(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`rows` (`_id, _k, text`, others) with `spans`; null texts are read as empty."""
    named = cut(candidates(postings(rows, rules), rules))
    release(rows.sparkSession)
    both = rows.withColumn("_null", F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit(""))).join(named, ["_id", "_k"], "left")
    parts = []
    for n, r in enumerate(rules):
        indexed = trigram_query(r.pattern) is not None
        parts.append(_spans(r, n, F.coalesce(F.array_contains("rules", n), F.lit(False)) if indexed else F.lit(True)))
    return both.withColumn("spans", F.array_sort(F.concat(*parts))).drop("rules")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`_id, _k, spans` of every row of `docs` (`doc_id`, `text`): spans are
    (start, rule, end), by start, then rule.

    Null and empty texts have no span; very long ones are scanned whole. Spans that tie are ordered by rule. Repeated
    rows and null ids are rows of their own; other columns are ignored, whatever they are called; an empty table gives no rows."""
    return _scan(keyed(docs, "doc_id", "text"), rules).select("_id", "_k", "spans")


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array([F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of `docs`, every span in `text` (overlapping ones as one) replaced by
    `mark`; `n_chars`, where there is such a column, follows. Other columns stay, whatever they are called,
    and so do texts without a span, null and empty ones too; repeated rows are masked alike; an empty table stays empty."""
    others = [c for c in docs.columns if c != "text"]
    rows = keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")), "doc_id", "text", "_row")
    folded = F.expr(
        f"""aggregate(spans, named_struct('pos', 0, 'parts', cast(array() as array<string>)),
        (a, s) -> if(s.end <= a.pos, a, named_struct('pos', s.end, 'parts',
            if(s.start < a.pos, a.parts, concat(a.parts, array(substring(text, a.pos + 1, s.start - a.pos), '{mark}'))))),
        a -> concat(array_join(a.parts, ''), substring(text, a.pos + 1)))"""
    )
    out = _scan(rows, rules).withColumn("text", F.when(F.col("_null"), F.lit(None).cast("string")).when(F.size("spans") > 0, folded).otherwise(F.col("text")))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        own = F.col("_row").getField(c)
        if c == "n_chars":
            own = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return out.select(*[column(c) for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scan` of all of `documents`; odd input as there."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    count = [F.expr(f"cast(size(filter(spans, s -> s.rule = {n})) as bigint)").alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return found.select(doc_id(), *count, F.sha2(_joined(base, RULES), 256).alias("base_sha256"), _joined(F.col("spans"), RULES).alias("spans"))


def _oracle() -> str:
    def one(n: int, r: Rule) -> str:
        p = r.pattern.replace("\\x20", " ").replace("'", "''")
        m, v, g = f"regexp_extract_all(text, '{p}', 0)", f"regexp_extract_all(text, '{p}', {r.group})", f"string_split_regex(text, '{p}')"
        start = "coalesce(list_sum([length(y) for y in g[1:i]]), 0) + coalesce(list_sum([length(y) for y in m[1:i-1]]), 0)"
        return (
            f"SELECT doc_id, {n} AS rule, '{r.kind}' AS kind, {start} AS s, {start} + length(m[i]) AS e FROM "
            f"(SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {m} AS m, {v} AS v, {g} AS g FROM documents WHERE regexp_matches(text, '{p}'))) WHERE length(v[i]) >= {r.least}"
        )

    hits = " UNION ALL ".join(one(n, r) for n, r in enumerate(RULES))
    named = "kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR)"
    counts = ", ".join(f"count(*) FILTER (rule = {n}) AS n_{r.kind}" for n, r in enumerate(BASE))
    return (
        f"WITH h AS ({hits}), a AS (SELECT doc_id, {counts}, string_agg({named}, ',' ORDER BY s, rule) FILTER (rule < {len(BASE)}) AS base, string_agg({named}, ',' ORDER BY s, rule) AS spans FROM h GROUP BY doc_id) "
        f"SELECT d.doc_id, {', '.join(f'CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"
    )


SQL = _oracle()
