"""Shards by proportional stratified interleaving.

The rows of each source are shuffled by a seed and ranked; a row's fraction is the middle of its
rank in its source's rows, (rank + 1/2) / rows. Sorted by fraction, the sources lie interleaved in proportion
all along the order, so any cut of it into runs gives shards that match the mixture: of each source a shard
has its share to within one row at either end.

The shuffle orders texts by a seeded hash, then rows of one text by a seeded hash of their id: rows
of a source with equal texts lie side by side and stay in one shard, unless there are more of them than
a shard has room for or a cut falls among them. `together=False` shuffles rows whatever their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, cut, discard, doc_id, keyed, keyed_rows, release
from .order import ranked

SHARDS = 16
SEED = 11


def _thin(docs: DataFrame, seed: int, together: bool) -> DataFrame:
    """`_id, _k, source, size, text_crc32, _text, _own`: what shuffles a row, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    thin = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.xxhash64(F.lit(seed), text) if together else F.lit(0).cast("long")).alias("_text"),
        F.xxhash64(F.lit(seed), own).alias("_own"),
    )
    return keyed(thin, "doc_id", "source", "_text", "size", "text_crc32", "_own")


def _cuts(law: str, shards: int) -> Column:
    """The shard of place `_rank` of `_size` rows, or of the middle of `size` bytes after `_bytes` of `_total`."""
    if law == "rows":
        return F.expr(f"(_rank * {shards}) div _size")
    return F.expr(f"least({shards - 1}, ((2 * _bytes + size) * {shards}) div (2 * _total))")


def assign(docs: DataFrame, shards: int = SHARDS, law: str = "rows", seed: int = SEED, together: bool = True) -> DataFrame:
    """`_id, _k, source, size, text_crc32, shard, slot` of every row of `docs` (`doc_id`, `source`, `text`).

    law `rows`: counts of shards are at most one apart; law `bytes`: shards end as near as whole rows let them to equal
    sums of `size` (UTF-8 bytes of the text and one). `slot` numbers a shard's rows from 0 in interleaved order.

    A null source is a source of its own; null texts are empty; very long texts count whole (they never leave the scan). Rows that
    repeat an id, null ids included, are rows of their own; rows alike in all that is used are interchangeable. Fewer rows
    than shards leave shards without rows. Other columns are ignored, whatever they are called; an empty table gives no rows."""
    if law not in ("rows", "bytes") or shards < 1:
        raise ValueError("law is rows or bytes, shards 1 or more")
    thin = _thin(docs, seed, together)
    in_source = ranked(thin, "source", "_text", "_own", "_id", "_k")
    fraction = (2 * F.col("_rank") + 1) / (2 * F.col("_size"))
    lined = in_source.select("_id", "_k", "source", "size", "text_crc32", fraction.alias("_fraction"), F.xxhash64(F.lit(seed), "_no").alias("_tie"), F.col("_no").alias("_stratum"), F.lit(0).alias("_all"))
    placed = ranked(lined, "_all", "_fraction", "_tie", "_stratum").drop("_no", "_all", "_tie", "_stratum")
    if law == "rows":
        start = F.expr(f"(shard * _size + {shards - 1}) div {shards}")
        out = placed.withColumn("shard", _cuts(law, shards))
        return out.select("_id", "_k", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_rank") - start).alias("slot"))
    placed = cut(placed.withColumn("_block", F.expr("_rank div 65536")))
    before = placed.groupBy("_block").agg(F.sum("size").alias("_sum"))
    from pyspark.sql import Window

    up = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for 65,536 rows of the table
    before = before.withColumn("_earlier", F.coalesce(F.sum("_sum").over(up), F.lit(0)))
    total = placed.agg(F.sum("size").alias("_total"))
    inside = Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, "_block").crossJoin(F.broadcast(total))  # one row
    out = cut(summed.withColumn("_bytes", F.col("_earlier") + F.col("_in")).withColumn("shard", _cuts(law, shards).cast("int")))
    first = out.groupBy("shard").agg(F.min("_rank").alias("_first"))
    done = cut(out.join(F.broadcast(first), "shard").select("_id", "_k", "source", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")))  # a row a shard
    discard(placed, out)
    release(docs.sparkSession)
    return done


def sharded(docs: DataFrame, shards: int = SHARDS, law: str = "rows", seed: int = SEED, together: bool = True) -> DataFrame:
    """`shard`, `slot` and `row` (the whole row as a struct, whatever its columns are called) of every row of `docs`; odd input as in
    `assign`."""
    rows = _keyed_like(docs, seed, together)
    return assign(docs, shards, law, seed, together).select("_id", "_k", "shard", "slot").join(rows, ["_id", "_k"]).select("shard", "slot", F.col("_row").alias("row"))


def _keyed_like(docs: DataFrame, seed: int, together: bool) -> DataFrame:
    """Whole rows under the keys that `assign` gives them."""
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return keyed_rows(docs).select("_id", "_k", "_row")
    with_row = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("doc_id", "source", "text", "_row")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    with_row = with_row.select("doc_id", "source", (F.xxhash64(F.lit(seed), text) if together else F.lit(0).cast("long")).alias("_text"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(seed), own).alias("_own"), "_row")
    return keyed(with_row, "doc_id", "source", "_text", "size", "text_crc32", "_own", "_row").select("_id", "_k", "_row")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "rows", seed: int = SEED, together: bool = True) -> None:
    """The columns of `docs` as Parquet, a folder `shard=<n>` a shard; files of a shard follow its slots, so reading
    them by name gives the interleaved order. A shard's rows are ranges of slots: as many tasks as it needs."""
    rows = sharded(docs, shards, law, seed, together).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(F.col("shard"), "row.*").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`assign` of all of `documents` to 16 shards by the law `rows`; odd input as there."""
    got = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(doc_id(), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
