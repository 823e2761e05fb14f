"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

Every document of a source is to be taken target / size-of-source times. The
whole part is taken outright; of the fractional parts, pairs of one source
transfer mass, weighted by size, until one of the two is integral: the words
taken stay the same in every transfer and each document's expectation is kept.
A block of bounded size leaves one fractional document; these residuals are
combined in blocks again, in a reduction tree, until one a source is left, which
goes to its nearer side. Blocks follow descending size, so that long
documents are settled by shorter ones and the last residual is a short one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, discard, doc_id, keyed, keyed_rows, release

FAN_IN = 128
"""Documents of a block, about (twice that: at most, but for chance)."""
WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3.0
EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """`_id, _k, source, size`: words of every whole text; null texts have none."""
    out = keyed(docs, "doc_id", "source", "text")
    return out.select("_id", "_k", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """`source, source_size, target`: sources by code point, null last, weigh
    `weights`, repeating. A target stops at `most` times its source's size and
    the excess is shared anew by weight until none is above, which is one level
    of target a weight: the caps below it hold, all other sources get level * weight.

    One row a source passes the window, never one a document."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    per = per.withColumn("level", F.first(free, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _fold(seed: int) -> Column:
    """Pivotal steps through the array `a` of (_id, _k, size, p), 0 < p < 1: struct of
    `open` (the one still fractional, or null) and `done` (the others, `one` 0 or 1).

    Mass is in words: `up` may move from the next document to the open one, `down`
    the other way; `up` is chosen with probability down / (up + down), which
    keeps both expectations."""
    item = "struct<_id:bigint,_k:int,size:bigint,p:double>"
    frac = lambda v: f"({v} > {EPS!r} and {v} < {1 - EPS!r})"
    keep = lambda e, p: f"named_struct('_id', {e}._id, '_k', {e}._k, 'size', {e}.size, 'p', {p})"
    draw = f"shiftrightunsigned(xxhash64(x._id, x._k, acc.open._id, acc.open._k, {seed}), 11) * {2.0**-53!r}"
    after = f"""named_struct(
        'open', case when {frac("n.p")} then {keep("acc.open", "n.p")} when {frac("n.q")} then {keep("x", "n.q")} end,
        'done', concat(acc.done, filter(array(
            named_struct('_id', acc.open._id, '_k', acc.open._k, 'one', if({frac("n.p")}, -1, if(n.p > 0.5, 1, 0))),
            named_struct('_id', x._id, '_k', x._k, 'one', if({frac("n.q")} and not {frac("n.p")}, -1, if(n.q > 0.5, 1, 0)))), r -> r.one >= 0)))"""
    moved = _let("n", "named_struct('p', acc.open.p + t / acc.open.size, 'q', x.p - t / x.size)", after)
    chosen = _let("t", f"if({draw} < m.down / (m.up + m.down), m.up, -m.down)", moved)
    masses = "named_struct('up', least((1 - acc.open.p) * acc.open.size, x.p * x.size), 'down', least(acc.open.p * acc.open.size, (1 - x.p) * x.size))"
    zero = f"named_struct('open', cast(null as {item}), 'done', cast(array() as array<struct<_id:bigint,_k:int,one:int>>))"
    return F.expr(f"aggregate(a, {zero}, (acc, x) -> if(acc.open is null, named_struct('open', {keep('x', 'x.p')}, 'done', acc.done), {_let('m', masses, chosen)}))")


def _round(items: DataFrame, blocks: int, seed: int) -> DataFrame:
    """`_id, _k, one` of all fractional documents: `items` has `source, block, _id, _k, size, p`."""
    parts: list[DataFrame] = []
    while True:
        a = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("w"), "_id", "_k", "size", "p"))).alias("a")
        level = cut(items.groupBy("source", "block").agg(a).select("source", "block", _fold(seed).alias("r")).select("source", "block", "r.open", "r.done"))
        parts.append(level.select(F.explode("done").alias("e")).select("e.*"))
        left = level.filter("open is not null")
        if blocks <= 1:
            rest = left.select("open._id", "open._k", F.when(F.col("open.p") >= 0.5, 1).otherwise(0).alias("one"))
            out = rest
            for x in parts:
                out = out.unionByName(x)
            return out
        items = left.select("source", F.floor(F.col("block") / FAN_IN).cast("long").alias("block"), "open.*")
        blocks = -(-blocks // FAN_IN)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES, seed: int = 9) -> DataFrame:
    """`_id, _k, source, size, source_size, target, copies`: how often each row of
    `docs` (`doc_id`, `source`, `text`) is taken.

    Null sources are one source; null and empty texts have size 0 and are never taken beyond
    the whole part; very long texts count whole. Ties in size are ordered by a hash of ids. Repeated rows and null ids are rows
    of their own; other columns are ignored, whatever they are called; an empty table gives no rows.
    The draws hash ids and a seed, so reruns agree."""
    spark = docs.sparkSession
    sized = cut(sizes(docs))
    goal = cut(targets(sized, weights, most))
    t = goal.select(F.col("source").alias("s"), "source_size", "target")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    row = sized.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("f", f)
    row = row.withColumn("whole", F.floor(F.col("f") + EPS).cast("int"))
    row = row.withColumn("p", F.when(F.col("size") > 0, F.col("f") - F.col("whole")).otherwise(0.0))
    row = cut(row.drop("f"))
    open_rows = row.filter(F.col("p") > EPS)
    # place in its source by descending size, from counts by size; equal sizes lie in the order of a hash
    by_size = open_rows.groupBy("source", "size").agg(F.count("*").alias("c"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    by_size = cut(by_size.withColumn("before", F.sum("c").over(down) - F.col("c")).select(F.col("source").alias("s"), F.col("size").alias("z"), "c", "before"))
    last = by_size.agg(F.max(F.col("before") + F.col("c"))).first()[0] or 1
    items = open_rows.join(by_size, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    place = F.col("before") + F.expr(f"shiftrightunsigned(xxhash64(_id, _k, {seed}), 11) * {2.0**-53!r} * c")
    items = items.select("source", F.floor(place / FAN_IN).cast("long").alias("block"), "_id", "_k", "size", "p")
    most_blocks = -(-int(last) // FAN_IN)
    ones = _round(items, most_blocks, seed)
    out = cut(row.join(ones, ["_id", "_k"], "left").select("_id", "_k", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("one", F.lit(0))).alias("copies")))
    discard(sized, goal, row)
    release(spark)
    return out


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES, seed: int = 9) -> DataFrame:
    """The rows of `docs`, all columns as they are and whatever they are called, each as often as the mix takes it; odd
    input as in `mix`."""
    take = mix(docs, weights, most, seed).filter("copies > 0").select("_id", "_k", "copies")
    rows = keyed_rows(docs, "source", "text").select("_id", "_k", "_row").join(take, ["_id", "_k"])
    return rows.select("_row", F.explode(F.expr("sequence(1, copies)"))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mix` of all of `documents`; odd input as there."""
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(doc_id(), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
