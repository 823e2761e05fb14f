"""Shared pieces of the training-data operators: row keys, durable cuts of the
lineage, Arrow text buffers, word splitting and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_ID = -(2**63)
CHUNK = 1 << 20
"""Bytes of text handled at once by the vectorised passes."""
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


# -- durable intermediate tables -------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session (tests, bench) has one of its
    own; a cluster, whose executors don't share a local folder, is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: recovery from a lost
    executor then restarts from the written table, not from the inputs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_parts(spark: SparkSession, parts: Iterable[DataFrame], by: str = "") -> DataFrame:
    """`cut` of all `parts` in one table, written one after the other; shuffles of a part go before the next one comes. With `by`
    the rows lie in buckets by that column, so that joins by it move the other side alone; the session's catalog then
    holds a name of the table until it is discarded."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cut_{uuid.uuid4().hex}"
    path, table = f"{shared_dir(spark)}/{name.replace('_', '-')}", f"spark_catalog.default.{name}"
    for part in parts:
        if by:
            part.repartition(n, by).write.format("parquet").mode("append").option("path", path).bucketBy(n, by).saveAsTable(table)
        else:
            part.write.mode("append").parquet(path)
        schema = part.schema
        del part
        release(spark)
    out = spark.table(table) if by else spark.read.schema(schema).parquet(path)
    out._cut_path = path
    if by:
        out._cut_table = table
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are out of scope."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*cuts: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            if table := getattr(df, "_cut_table", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


BATCH_ROWS = 1000


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches hold whole texts: at most BATCH_ROWS rows each, so that a worker's
    memory doesn't follow the 10,000 rows of Spark's default. It stays set, as plans run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f`, giving freed memory back to the system after a partition: workers are used again."""

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return g


# -- row keys ----------------------------------------------------------------------


def keyed(docs: DataFrame, id_col: str = "doc_id", *carry: str) -> DataFrame:
    """Columns `_id`, `_k` and `carry`, one row per input row, unique by (`_id`, `_k`).

    `_id` is the id (null: the smallest long), `_k` numbers rows that repeat an
    id, in the order of their carried columns but `_row`; it is 0 where ids are unique,
    which a count over the id column alone finds out."""
    lean_batches(docs.sparkSession)
    out = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), *carry)
    repeats = out.groupBy("_id").count().filter("count > 1").limit(1).count()
    if not repeats:
        return out.select("_id", F.lit(0).cast("int").alias("_k"), *carry)
    from pyspark.sql import Window

    order = [F.col(c) for c in carry if c != "_row"] or [F.lit(0)]
    return out.select("_id", (F.row_number().over(Window.partitionBy("_id").orderBy(*order)) - 1).cast("int").alias("_k"), *carry)


def keyed_rows(docs: DataFrame, *carry: str) -> DataFrame:
    """`_id, _k`, `carry` and the whole row as the struct `_row`, whatever its columns are called."""
    with_row = docs.select("doc_id", *carry, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return keyed(with_row, "doc_id", *carry, "_row")


def doc_id() -> F.Column:
    return F.when(F.col("_id") != F.lit(NULL_ID), F.col("_id")).alias("doc_id")


# -- Arrow text ----------------------------------------------------------------------


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `size` bytes, or one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of concatenated texts, and each
    text's first word index (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = _SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    st, en = ~sep, ~sep
    st[1:] &= sep[:-1] | edge[1:-1]
    en[:-1] &= sep[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# -- hashing ----------------------------------------------------------------------------

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 2**64)
_pows = np.ones(1, U64), np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pows
    if len(_pows[0]) < n:
        m = max(n, 1 << 16)
        a, b = np.full(m, _MUL, U64), np.full(m, _INV, U64)
        a[0] = b[0] = 1
        _pows = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pows[0][:n], _pows[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


class Rolling:
    """Karp-Rabin hashes modulo 2**64 of any [s, e) of a symbol sequence."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(U64))


LONG_WORD = 256
"""Bytes from which a word is hashed by XXH64 on its own."""


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word under a seed: its bytes, eight at a time, each chained into a bijective mixer. Unlike a
    polynomial, no pattern of repeats in a word cancels out; another seed parts words that met under this one."""
    n = ends - starts
    h = mix(n.astype(U64) * U64(_MUL) + U64((seed * 0xD1342543DE82EF95 + 1) % 2**64))
    if not len(n):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live, at = np.flatnonzero((n > 0) & (n <= LONG_WORD)), 0
    while len(live):
        left = n[live] - at
        block = eight[starts[live] + at]
        short = left < 8
        block[short] &= (U64(1) << (8 * left[short]).astype(U64)) - U64(1)
        h[live] = mix(h[live] ^ block)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), (seed + 0x5DEECE66D) % 2**64)
    return h


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


# -- connected components ------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges of one partition, as (root, node) stars."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(x), find(y)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 65536):
        part = nodes[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], pa.int64()), pa.array(part, pa.int64())], names=["src", "dst"])


SALTS = 8
"""Parts that the neighbours of a node are dealt to."""


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`node`, `component` (smallest node reachable) for every node on an edge
    (`src`, `dst`: non-null longs, any direction).

    Each partition first reduces its edges to a spanning forest, then large-star
    and small-star steps alternate over written tables until nothing changes.
    Minima are partial aggregates, so a node with a third of all edges is
    pre-aggregated, and they join back by node and one of SALTS parts of its
    neighbours; no list of edges or nodes reaches the driver."""
    schema = "src long, dst long"
    spark = edges.sparkSession
    now = cut(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst").mapInArrow(_forest, schema))
    for _ in range(rounds):
        both = now.select("src", "dst").unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m")).withColumnRenamed("src", "u")
        # only larger neighbours move on, so the part of a node that they belong to is known before the join
        parts = low.withColumn("salt", F.explode(F.array([F.lit(k) for k in range(SALTS)])))
        salted = both.filter("dst > src").withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
        large = salted.join(parts, (salted.src == parts.u) & (salted.salt == parts.salt)).select(F.col("m").alias("src"), "dst")
        # two plans of half the size: with each stage that ends the driver keeps the metrics of a whole plan anew
        mid = cut(large.distinct())
        # small star: every node's lower neighbours are tied to the least of them
        low2 = mid.groupBy("dst").agg(F.min("src").alias("m")).withColumnRenamed("dst", "u")
        small = mid.join(low2, mid.dst == low2.u).select("m", "src", "dst")
        small = small.select(F.col("m").alias("src"), F.explode(F.array("src", "dst")).alias("dst")).filter("src <> dst").distinct()
        after = cut(small)
        inner = after.select(F.col("src").alias("dst")).distinct()
        unsettled = after.groupBy("dst").count().filter("count > 1").select("dst").unionByName(after.join(inner, "dst", "left_semi").select("dst"))
        settled = unsettled.isEmpty()
        discard(now, mid)
        now = after
        release(spark)
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("dst").alias("node"), F.col("src").alias("component")).unionByName(roots)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
