"""Repeated byte strings by distributed prefix doubling.

Doubling from every byte would sort a row a byte in each round, so positions are first
thinned without loss (windows.py): what survives are the windows of contexts that differ
around one anchor, and of these the positions at every STEP-th offset from the anchor.
A surviving position starts with the name of its first ANCHOR bytes. Then, at growing offsets,
Spark groups and sorts the pairs (rank at a position, rank at the position + offset), a pair's
place in that order is the new rank, positions whose pair is unique leave, and so do
those whose partner has left: 64, 128 and 176 bytes. The last step goes past the threshold
to all `length` bytes: each of the up to STEP windows that hold the 176 bytes adds its own bytes
beside them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, doc_id, keyed, release, signed, utf8
from .windows import BLOCKS, SEGMENT, Shape, as_wholes, blocks, covered, index, range_hash, settled, span_lists, with_representatives

LENGTH, ANCHOR, STEP = 200, 64, 16
GRID = BLOCKS + ", r1 long, r2 long"


def offsets(shape: Shape) -> list[int]:
    """Offsets of the rounds: each doubles the length of ranked prefixes, the last one stops
    at what all windows of a block have in common. Multiples of `step`."""
    if shape.k % shape.step:
        raise ValueError(f"an anchor of {shape.k} is no multiple of {shape.step}")
    h, out = shape.k, []
    while (o := min(h, (shape.w - shape.step + 1 - h) // shape.step * shape.step)) > 0:
        out.append(o)
        h += o
    if not out:
        raise ValueError(f"strings of {shape.w} are too short for anchors of {shape.k}")
    return out


def _grid(shape: Shape):
    """Blocks with the first pair of names at their position, and for each run the positions
    after its last block (no windows there) that are partners in later rounds."""
    first, *later = offsets(shape)
    tail = sum(later) // shape.step

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sym, at, cols in blocks(b, shape):
                name, ctx, nth = cols[2].to_numpy(), cols[3].to_numpy(), cols[4].to_numpy()
                end = np.flatnonzero(np.append((name[1:] != name[:-1]) | (ctx[1:] != ctx[:-1]), True))
                t = np.repeat(end, tail)
                more = np.tile(np.arange(1, tail + 1), len(end))
                none = pa.array(np.zeros(len(t), np.int64))
                extra = [x.take(pa.array(t)) for x in cols[:4]] + [pa.array((nth[t] - more).astype(np.int32)), none, none.cast(pa.int32()), none, pa.ListArray.from_arrays(pa.array(np.zeros(len(t) + 1, np.int32)), pa.array([], pa.int64()))]
                for own, p in ((cols, at), (extra, at[t] + shape.step * more)):
                    pair = [signed(range_hash(sym, p + o, p + o + shape.k, SEGMENT)) for o in (0, first)]
                    yield pa.RecordBatch.from_arrays([*own, *pair], names=[c.split()[0] for c in GRID.split(", ")])

    return f


def reranked(pairs: DataFrame) -> DataFrame:
    """`name, ctx, b, rank` of the positions whose pair (`r1, r2`) isn't unique among the positions
    with one offset (b) to one anchor (name). The rank is the pair's place in Spark's sort
    of all pairs that stay; positions are counted before they are shuffled, so a pair may be frequent."""
    key = ["name", "b", "r1", "r2"]
    ranks = cut(pairs.groupBy(*key).count().filter("count > 1").drop("count").orderBy(*key).withColumn("rank", F.monotonically_increasing_id()))
    out = cut(pairs.join(ranks, key).select("name", "ctx", "b", "rank"))
    discard(ranks)
    release(pairs.sparkSession)
    return out


def doubled(grid: DataFrame, shape: Shape) -> DataFrame:
    """`name, ctx, b, rank` after all rounds: positions whose longest ranked prefix occurs again."""
    _, *later = offsets(shape)
    now = reranked(grid.select("name", "ctx", "b", "r1", "r2"))
    for o in later:
        k = o // shape.step
        partner = F.first("rank").over(Window.partitionBy("name", "ctx").orderBy("b").rangeBetween(-k, -k))
        after = reranked(now.select("name", "ctx", "b", F.col("rank").alias("r1"), partner.alias("r2")).filter("r2 is not null"))
        discard(now)
        now = after
    return now


def repeated_bytes(docs: DataFrame, shape: Shape) -> DataFrame:
    """`_id, _k, spans` of the texts (`docs`: `_id, _k, text`) with repeated strings of shape.w
    bytes: spans (s, n), n such strings from byte s on."""
    spark = docs.sparkSession
    found = index(docs, shape)
    grid = cut(with_representatives(docs, found).mapInArrow(_grid(shape), GRID))
    discard(found.representatives)
    release(spark)
    last = doubled(grid, shape)
    live = cut(grid.filter("n > 0").drop("r1", "r2").join(last, ["name", "ctx", "b"]).select("_id", "_k", "s", "n", "full", "wins", "rank"))
    discard(grid, last)
    release(spark)
    inside, used = settled(live, ["rank"])
    every = as_wholes(found).drop("f").unionByName(inside.drop("f"))
    out = cut(every.groupBy("_id", "_k").agg(F.collect_list(F.struct("s", "n")).alias("spans")))
    release(spark)
    discard(live, *used)
    found.drop()
    return out


def _strip(length: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(2))
            raw = data.tobytes()
            lo, s, n = span_lists(b.column(3))
            size, gone, spans, sha, rest = [], [], [], [], []
            for i in range(b.num_rows):
                text = raw[offs[i] : offs[i + 1]]
                removed = pieces = 0
                kept = text
                if lo[i + 1] > lo[i]:
                    at, to = covered(len(text), s[lo[i] : lo[i + 1]], n[lo[i] : lo[i + 1]], length)
                    keep, pos = [], 0
                    for x, y in zip(at.tolist(), to.tolist(), strict=True):
                        keep.append(text[pos:x])
                        removed += y - x
                        pieces += 1
                        pos = y
                    kept = b"".join([*keep, text[pos:]])
                size.append(len(text))
                gone.append(removed)
                spans.append(pieces)
                sha.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(rest, pa.binary())],
                names=["_id", "_k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return f


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept` (bytes): whole
    documents as UTF-8 without each byte under a `length`-byte string that
    starts anywhere else too.

    Null and empty texts: no bytes, nothing removed. Very long texts: positions are read in
    segments, none is cut. Ties: a string that repeats goes everywhere, so order doesn't matter.
    Repeated rows (of an id or whole) are documents of their own and both lose their text.
    Cuts may fall inside a character. An empty table gives no rows; other columns are ignored, whatever
    they are called."""
    own = keyed(docs, "doc_id", "text")
    found = repeated_bytes(own, Shape(length, anchor, STEP, False))
    out = own.join(found, ["_id", "_k"], "left").select("_id", "_k", "text", "spans").mapInArrow(_strip(length), "_id long, _k int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


#: The same by comparing every string of 200 bytes with all others; texts as hexadecimal digits.
SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 win AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 400]) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
 dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
 mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM dup),
 run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark) GROUP BY doc_id, g),
 gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
 cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(d.h[2 * before + 1:2 * a], '' ORDER BY a) AS t FROM gap JOIN d USING (doc_id) GROUP BY 1)
 SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE coalesce(t, '') || h[2 * last + 1:] END)) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`remove_repeated_bytes` of all of `documents`; odd input as there."""
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
