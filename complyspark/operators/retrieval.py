"""Retrieval of regulation passages: scope and validity filters, exact top-k by
distance, guaranteed coverage by field, citations.

Vectors are compared inside code generation (zip_with and aggregate). A query
set is small and stated, so it is the side that meets all chunks of its scope;
the scope is the join key, hence no cross product of the whole corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def scope(jurisdiction: str | None, doc_types: list[str], sets: list[str]) -> Column:
    """Conjunction of the given restrictions; an empty list is none."""
    cond = F.lit(True)
    if jurisdiction:
        cond = cond & (F.col("jurisdiction") == jurisdiction)
    if doc_types:
        cond = cond & F.col("doc_type").isin(doc_types)
    if sets:
        cond = cond & F.col("reg_set").isin(sets)
    return cond


def in_force(day: Column) -> Column:
    """Whether a passage is in force on a day; an open end is null; without a day all are."""
    return day.isNull() | ((F.col("effective_from") <= day) & (F.coalesce(F.col("effective_to"), F.lit("9999-12-31").cast("date")) >= day))


def valid_on(days: DataFrame, chunks: DataFrame, *on: str) -> DataFrame:
    """Chunks in force on each day (`day` and other columns; null: all of them) among those with equal `on`.
    A stab join with the year as equi-join key: an interval is a row a year, open ends up to the last day asked for."""
    asked = days.select("day", *[c for c in days.columns if c != "day"])
    known = asked.filter("day is not null").withColumn("_y", F.year("day"))
    last = known.agg(F.coalesce(F.max("_y"), F.lit(0)).alias("_last"))
    start, end = F.year("effective_from"), F.least(F.year(F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))), F.col("_last"))
    by_year = chunks.crossJoin(F.broadcast(last)).withColumn("_y", F.explode(F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))))  # one row
    names = [*asked.columns, *[c for c in chunks.columns if c not in on]]
    dated = by_year.join(known, ["_y", *on]).filter(in_force(F.col("day"))).select(names)
    open_ = asked.filter("day is null")
    if on:
        undated = chunks.join(open_, list(on))
    else:  # all chunks, once for all that ask without a day
        undated = chunks.crossJoin(F.broadcast(open_.distinct().limit(1)))
    return dated.unionByName(undated.select(names))


def relaxed_on(queries: DataFrame, chunks: DataFrame, *on: str) -> DataFrame:
    """Rows of `valid_on` with `in_force` true; for queries (`query_id`) that have none all chunks of their scope (`on`), with false."""
    valid = valid_on(queries, chunks, *on).withColumn("in_force", F.lit(True))
    rest = queries.join(valid.select("query_id").distinct(), "query_id", "left_anti")
    return valid.unionByName(rest.join(chunks, list(on)).withColumn("in_force", F.lit(False)))


LEVELS = 23
"""Spans of days double from one day up: 2 ** 22 days reach from year 1 to year 9999."""
FIRST_DAY = "0001-01-01"
ANY_DAY = -1
"""The level of passages asked for without a day."""


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def spans_of(start: Column, end: Column) -> Column:
    """An interval of days, both ends in it, as at most two spans a level (`level, span`) that lie side by side: span s
    of level l are the days from s * 2 ** l on, 2 ** l of them."""
    a, b = _day_number(start), _day_number(end) + 1
    parts = []
    for level in range(LEVELS):
        width = 1 << level
        left, right = F.ceil(a / width).cast("long"), F.floor(b / width).cast("long")
        one = F.lit(level).alias("level")
        parts += [F.when((left < right) & (left % 2 == 1), F.struct(one, left.alias("span"))), F.when((left < right) & (right % 2 == 1), F.struct(one, (right - 1).alias("span")))]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def spans_at(day: Column) -> Column:
    """The spans that a day lies in, one a level; without a day the one that holds all passages."""
    n = _day_number(day)
    of = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda l: F.struct(l.alias("level"), F.floor(n / F.pow(F.lit(2.0), l)).cast("long").alias("span")))
    return F.when(day.isNull(), F.array(F.struct(F.lit(ANY_DAY).alias("level"), F.lit(0).cast("long").alias("span")))).otherwise(of)


def valid_top_k(days: DataFrame, passages: DataFrame, k: int, on: tuple[str, ...] = (), by: tuple[str, ...] = (), cut: Callable[[DataFrame], DataFrame] = lambda kept: kept) -> DataFrame:
    """`on, by, day, chunk_id, distance, rank, in_force`: of each day and each `by` (a field, say) the `k` nearest passages in force.

    `days`: distinct (`on`, `day`), null: all passages; `passages`: `on`, `by`, chunk_id, distance, effective_from, effective_to (null: open).
    A day of a scope on which none is in force has the nearest of all, with in_force false.

    Each passage stands in the few spans of days that make up its validity, and each span keeps its own k nearest: a
    day's k nearest are among those of the spans it lies in, one a level. So what meets before the
    choice grows with the passages and with the days, never with their product. What the spans keep is read several times:
    `cut` may write it once."""
    last = F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))
    anyway = F.array(F.struct(F.lit(ANY_DAY).alias("level"), F.lit(0).cast("long").alias("span")))
    spread = passages.select(*on, *by, "chunk_id", "distance", F.explode(F.concat(anyway, spans_of(F.col("effective_from"), last))).alias("_s")).select(*on, *by, "chunk_id", "distance", "_s.*")
    near = Window.partitionBy(*on, *by, "level", "span").orderBy("distance", "chunk_id")
    kept = cut(spread.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k).drop("_r"))
    key = [*on, "level", "span"]
    asked = days.select(*on, "day").distinct()
    strict = asked.select(*on, "day", F.explode(spans_at(F.col("day"))).alias("_s")).select(*on, "day", "_s.*").join(kept, key)
    strict = strict.withColumn("_day", F.coalesce("day", F.lit(FIRST_DAY).cast("date"))).withColumn("_known", F.col("day").isNotNull())
    best = Window.partitionBy(*on, *by, "_known", "_day").orderBy("distance", "chunk_id")
    strict = strict.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("in_force", F.lit(True))
    columns = [*on, *by, "day", "chunk_id", "distance", "rank", "in_force"]
    met = strict.filter("_known").select(*on, "day").distinct()
    without = asked.filter("day is not null").join(met, [*on, "day"], "left_anti").withColumn("level", F.lit(ANY_DAY)).withColumn("span", F.lit(0).cast("long"))
    free = Window.partitionBy(*on, *by, "day").orderBy("distance", "chunk_id")
    relaxed = without.join(kept, key).withColumn("rank", F.row_number().over(free)).withColumn("in_force", F.lit(False))
    return strict.select(columns).unionByName(relaxed.select(columns))


SPLIT = 16
"""Parts of a scope's chunks where the caller names no other number: a scope that holds most of them is as many tasks."""
PART_ROWS = 100_000


def parts_for(chunks: DataFrame, on: str, rows: int = PART_ROWS) -> int:
    """Parts that leave about `rows` chunks of the largest scope in each: one count by scope, to be had when a store is loaded."""
    most = chunks.groupBy(on).count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-most // rows))


def top_k(queries: DataFrame, chunks: DataFrame, on: str, k: int, split: int = SPLIT) -> DataFrame:
    """The k nearest chunks of each query among those with the same `on`, ties by id.

    `queries`: query_id, vec, `on`; `chunks`: chunk_id, embedding, `on`. Chunks of a scope are dealt to `split` parts, every
    query meets each part, keeps its k best there, and these are merged."""
    parts = chunks.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(split)).cast("int"))
    asked = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
    pairs = parts.join(asked, [on, "part"]).select("query_id", "chunk_id", F.round(squared_distance(F.col("vec"), F.col("embedding")), 6).alias("distance"))
    # rank <= k under a row_number: Spark keeps at most k rows a query and task before the shuffle
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Order of each field's hits by a pairwise score, stable on ties; single hits keep theirs."""
    w = Window.partitionBy("field_key")
    o = w.orderBy(F.col("score").desc_nulls_last(), "distance", "chunk_id")
    joined = hits.join(scores, ["query_id", "chunk_id"], "left").withColumn("n", F.count("*").over(w))
    return joined.withColumn("i", F.row_number().over(o) - 1).drop("n")


def guaranteed(hits: DataFrame, g: int, cap: int, *by: str) -> DataFrame:
    """The passages of each request (`by`; none: one request): every field's first `g` (never cut), then others by
    distance up to `cap` texts of the request. One row a text: least distance, its chunk, and the
    rank in each field that found it.

    `hits`: `by`, field_ord, field_key, i (0-based rank), chunk_id, text, distance. All requests are one plan: of the texts that
    are not guaranteed at most `cap` a request pass a group limit in each task, and the room that a request's
    guaranteed ones leave is looked up by its key."""
    h = hits.withColumn("key", F.coalesce(F.nullif(F.btrim("text"), F.lit("")), F.col("chunk_id").cast("string")))
    one = h.groupBy(*by, "key").agg(
        F.bool_or(F.col("i") < g).alias("must"),
        F.min(F.when(F.col("i") >= g, F.struct("distance", "field_ord", "i"))).alias("first_extra"),
        F.min("distance").alias("distance"),
        F.min_by("chunk_id", F.struct("distance", "field_ord", "i", "chunk_id")).alias("chunk_id"),
        F.collect_list(F.struct("field_key", "i")).alias("found"),
    )
    must = one.filter("must")
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("first_extra", "key")
    extra = one.filter(~F.col("must")).withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= cap)
    taken = must.groupBy(*by).agg(F.count("*").alias("_taken"))
    room = extra.join(taken, list(by), "left") if by else extra.crossJoin(F.broadcast(taken))  # without requests: one row
    extra = room.filter(F.col("_place") + F.coalesce("_taken", F.lit(0)) <= cap)
    columns = [*by, "key", "chunk_id", "distance", "must", "found"]
    return must.select(columns).unionByName(extra.select(columns))


def field_ranks(chosen: DataFrame, *by: str) -> DataFrame:
    """`by, field_key, key, rank`: the best rank of each chosen passage in each field of its request."""
    return chosen.select(*by, "key", F.explode("found").alias("f")).groupBy(*by, "f.field_key", "key").agg(F.min("f.i").alias("rank"))


def coverage(keys: DataFrame, ranks: DataFrame, g: int) -> DataFrame:
    """Of all fields: the share with a passage, the share with `g`, and how many have none."""
    n = keys.join(ranks.groupBy("field_key").agg(F.count("*").alias("c")), "field_key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return n.agg(
        F.count("*").alias("fields"),
        F.round(F.avg((F.col("c") > 0).cast("int")), 4).alias("coverage"),
        F.round(F.avg((F.col("c") >= g).cast("int")), 4).alias("full_coverage"),
        F.count_if(F.col("c") == 0).alias("uncovered"),
    )


def best_chunk(queries: DataFrame, chunks: DataFrame, least: int = 2) -> DataFrame:
    """For each query the chunk with most common tokens (at least `least`), the first of equals.

    Tokens are the join key; one that most chunks have meets as many rows as its share of them. Two chunks that
    hold the same of the queries' tokens score alike, so such a set of tokens is one row, named by its
    least chunk: common tokens alone make few sets, and copies one."""
    q = queries.select("query_id", F.explode(tokens(F.col("text"), 4)).alias("token"))
    asked = q.select("token").distinct()
    c = chunks.select("chunk_id", F.explode(tokens(F.col("text"), 4)).alias("token")).join(asked, "token", "left_semi")
    sets = c.groupBy("chunk_id").agg(F.array_sort(F.collect_set("token")).alias("tokens")).filter(F.size("tokens") >= least)
    named = sets.groupBy("tokens").agg(F.min("chunk_id").alias("chunk_id"))
    n = q.join(named.select("chunk_id", F.explode("tokens").alias("token")), "token").groupBy("query_id", "chunk_id").agg(F.count("*").alias("score")).filter(F.col("score") >= least)
    return n.groupBy("query_id").agg(F.max_by("chunk_id", F.struct(F.col("score"), -F.col("chunk_id"))).alias("chunk_id"), F.max("score").alias("score"))


def backfill(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations with their content from the store; unknown ids go."""
    return citations.join(chunks, "chunk_id").select("check_id", "chunk_id", "source_doc", F.substring("text", 1, 1200).alias("text_quote"))


def citation_quality(citations: DataFrame, sent: DataFrame) -> DataFrame:
    """Citations, how many name a passage that was sent, invented and automatic ones, and precision."""
    c = citations.join(sent.select(F.col("chunk_id").alias("known")).distinct(), F.col("chunk_id") == F.col("known"), "left")
    named = F.col("chunk_id").isNotNull()
    return c.agg(
        F.count("*").alias("citations"),
        F.count_if(named & F.col("known").isNotNull()).alias("known"),
        F.count_if(named & F.col("known").isNull()).alias("invented"),
        F.count_if(~named).alias("static"),
        F.round(F.try_divide(F.count_if(named & F.col("known").isNotNull()), F.count_if(named)), 4).alias("precision"),
    )


def query_text(catalog: DataFrame, kind: str) -> DataFrame:
    """One query a field: document kind, label, aspect."""
    return catalog.select("field_key", F.concat_ws(" ", F.lit(kind), F.nullif(F.btrim("label"), F.lit("")), F.nullif(F.btrim("aspect"), F.lit(""))).alias("text"))


def ask_once(queries: DataFrame, answer, key: list[str]) -> DataFrame:
    """`queries` with what `answer` (a function of distinct queries, keyed by `key`) finds: equal queries of
    any number of requests are asked once, the distinct table takes the place of a memo."""
    return queries.join(answer(queries.select(*key).distinct()), key)


def ordered_distinct(queries: Column) -> Column:
    """Queries in order, each once."""
    return F.array_distinct(queries)
