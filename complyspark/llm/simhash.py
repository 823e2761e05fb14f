"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Fingerprints at distance 3 or
less are within distance 1 of each other in one segment at least, so each table
is probed with the segment's Hamming ball of radius 1, and hits are verified on
all 64 bits. Of a pair that differs in one bit of a segment only the side with
the 0 probes, which halves the ball. Only distinct fingerprints enter: copies,
however many, are one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, components, cut, discard, doc_id, keyed, keyed_rows, lean, release, utf8

SHINGLE, DISTANCE, SEED = 3, 3, 42


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text; without words it is zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = ends[len(words) - n :].tolist()
    ones = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for a in range(0, n, 65536):
        codes = np.fromiter((h(joined[s:e], seed) for s, e in zip(starts[a : a + 65536], stops[a : a + 65536], strict=True)), np.uint64, min(n, a + 65536) - a)
        ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _scan(shingle: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(2))
            view = memoryview(data)
            codes = [fingerprint(bytes(view[offs[i] : offs[i + 1]]), shingle) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.int64())], names=["_id", "_k", "fp"])

    return f


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`src`, `dst`: pairs of distinct fingerprints (`fp`, distinct longs) at most
    `distance` (3 or less) bits apart, each once."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 serve distances up to 3")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: low(F.shiftrightunsigned(c, 32))
    seg = F.explode(F.array(F.struct(F.lit(0).alias("t"), low(F.col("fp")).alias("v")), F.struct(F.lit(1).alias("t"), high(F.col("fp")).alias("v")))).alias("e")
    table = fps.select("fp", seg).select("fp", "e.t", "e.v")
    flips = F.expr("transform(filter(sequence(0, 31), i -> (v & shiftleft(1L, i)) = 0), i -> v | shiftleft(1L, i))")
    probe = table.select(F.col("fp").alias("src"), "t", F.explode(F.concat(F.array("v"), flips)).alias("v"), F.col("v").alias("own"))
    hit = F.bit_count(F.col("src").bitwiseXOR(F.col("fp"))) <= distance
    once = (F.col("own") != F.col("v")) | (F.col("src") < F.col("fp"))
    first = (F.col("t") == 0) | (F.bit_count(low(F.col("src")).bitwiseXOR(low(F.col("fp")))) > 1)
    other = table.select(F.col("fp"), F.col("t").alias("t2"), F.col("v").alias("v2"))
    return probe.join(other, (F.col("t") == F.col("t2")) & (F.col("v") == F.col("v2")) & hit & once & first).select("src", F.col("fp").alias("dst"))


def groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """`_id, _k, fp, comp, component_id`: fingerprint of every whole text of `docs`
    (`doc_id`, `text`), its linked group (least fingerprint) and that group's least id
    (null is the smallest, as NULL_ID).

    Null, empty and wordless texts have fingerprint 0 and link like any other. Very long texts are hashed in
    parts, none is cut. Ties: texts with one fingerprint are one row until the end. Repeated
    rows are rows of their own with the same group. Other columns are ignored, whatever they are called; an
    empty table gives no rows."""
    spark = docs.sparkSession
    marks = cut(keyed(docs, "doc_id", "text").mapInArrow(lean(_scan(shingle)), "_id long, _k int, fp long"))
    distinct = cut(marks.groupBy("fp").agg(F.min("_id").alias("low")))
    release(spark)
    tied = components(links(distinct.select("fp"), distance))
    label = distinct.join(tied, distinct.fp == tied.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("comp"))
    least = label.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = cut(label.join(least, "comp").select("fp", "comp", "component_id"))
    release(spark)
    discard(distinct)
    return marks.join(named, "fp")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs`, all columns as they are, without near copies: of each
    group the row with the least id (of rows that repeat it, the first by text) stays."""
    stay = groups(docs, shingle, distance).groupBy("comp").agg(F.min(F.struct("_id", "_k")).alias("s")).select("s._id", "s._k")
    return keyed_rows(docs, "text").select("_id", "_k", "_row").join(stay, ["_id", "_k"], "left_semi").select("_row.*")


def digest(docs: DataFrame) -> DataFrame:
    """`doc_id, fingerprint` (16 hexadecimal digits), `component_id` of every row."""
    least = F.when(F.col("component_id") != F.lit(NULL_ID), F.col("component_id"))
    return groups(docs).select(doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), least.alias("component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`groups` of all of `documents`; a component whose least id is null has a null `component_id`."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
