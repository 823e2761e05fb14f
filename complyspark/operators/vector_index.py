"""An inverted file over vectors: coarse centres, a list of vectors for each, probed lists instead of all.

Built once as a table and reused. A list's radius (its farthest vector) tells which lists can hold a nearer vector
than those found so far, so the same table also answers exactly: a few lists bound the k-th distance, then just
those within that bound are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import squared_distance

LISTS_AT_MOST = 4096
"""Centres travel to every task: this many at most, whatever the number of vectors."""


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = np.argmin(half - x[i : i + 8192] @ centres.T, axis=1)
    return out


def _sums(centres: np.ndarray):
    """Lloyd's step in a task: for each list the sum and the number of the task's vectors that are nearest to its centre."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            x = _matrix(b.column(0), centres.shape[1])
            own = _nearest(x, centres)
            np.add.at(total, own, x)
            count += np.bincount(own, minlength=len(centres))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["list", "n", "total"])

    return f


def centres_of(vectors: DataFrame, lists: int, steps: int = 5, seed: int = 7) -> np.ndarray:
    """`lists` coarse centres of `vectors` (`chunk_id`, `embedding`): the vectors of least seeded hash to begin with, then `steps` Lloyd
    steps over all vectors, each summed in tasks first. The driver gets a row a list and dimension, at most LISTS_AT_MOST lists."""
    if not 0 < lists <= LISTS_AT_MOST:
        raise ValueError(f"lists is 1 to {LISTS_AT_MOST}")
    known = vectors.filter(usable(F.col("embedding")))
    first = known.select("embedding").distinct().orderBy(F.xxhash64(F.lit(seed), "embedding")).limit(lists).collect()
    centres = np.array([r[0] for r in first], np.float64)
    if not len(centres):
        return np.zeros((0, 0))
    for _ in range(steps):
        part = known.select("embedding").mapInArrow(_sums(centres), "list long, n long, total array<double>")
        summed = part.select("list", "n", F.posexplode("total").alias("d", "x")).groupBy("list", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        after = centres.copy()
        for r in summed.collect():  # lists * dimensions
            after[r["list"], r["d"]] = r["x"] / r["n"]
        if np.allclose(after, centres, rtol=0, atol=1e-12):
            break
        centres = after
    return centres


def usable(v: Column) -> Column:
    """Vectors without nulls, infinities or NaN."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _listed(centres: np.ndarray, probes: int):
    """Adds to each vector its `probes` nearest lists with their distances, nearest first."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(b.num_columns - 1), centres.shape[1])
            d = np.sqrt(np.maximum(((x[:, None, :] - centres[None]) ** 2).sum(2) if len(centres) * len(x) * centres.shape[1] < 1 << 24 else (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0))
            order = np.argsort(d, axis=1, kind="stable")[:, :probes]
            near = np.take_along_axis(d, order, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order.tolist(), pa.list_(pa.int64())), pa.array(near.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, "lists", "away"])

    return f


def _with_lists(rows: DataFrame, vec: str, centres: np.ndarray, probes: int) -> DataFrame:
    rest = [c for c in rows.columns if c != vec]
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.select(*rest, vec).dtypes)
    return rows.select(*rest, vec).mapInArrow(_listed(centres, probes), f"{fields}, lists array<bigint>, away array<double>")


def build(vectors: DataFrame, path: str, lists: int, steps: int = 5, seed: int = 7) -> None:
    """Writes the index of `vectors` (`chunk_id`, `embedding` and what else they carry: scopes) to `path`: `lists/` with every usable vector
    under its list, `centres/` with a row a list (centre, radius, vectors)."""
    spark = vectors.sparkSession
    centres = centres_of(vectors, lists, steps, seed)
    known = vectors.filter(usable(F.col("embedding")))
    if not len(centres):
        known.withColumn("list", F.lit(0).cast("long")).withColumn("away", F.lit(0.0)).limit(0).write.mode("overwrite").parquet(f"{path}/lists")
        spark.createDataFrame([], "list long, centre array<double>, radius double, vectors long").write.mode("overwrite").parquet(f"{path}/centres")
        return
    rows = _with_lists(known, "embedding", centres, 1)
    rows = rows.select(*[c for c in rows.columns if c not in ("lists", "away")], F.col("lists")[0].alias("list"), F.col("away")[0].alias("away"))
    # a list of any length is as many files as its vectors need: ranges of (list, hash)
    rows.repartitionByRange("list", F.xxhash64("chunk_id")).write.mode("overwrite").parquet(f"{path}/lists")
    stats = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("vectors"))
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list long, centre array<double>")
    table.join(stats, "list", "left").select("list", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("vectors", F.lit(0)).cast("long").alias("vectors")).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


class Index:
    """A written index. `parts`: tasks that the vectors of one list are dealt to, from the longest list's length."""

    ROWS = 50_000
    SLACK = 1e-6
    """Distances of lists and of vectors are rounded differently: bounds give this much."""

    def __init__(self, spark, path: str):
        self.lists = spark.read.parquet(f"{path}/lists")
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # LISTS_AT_MOST rows
        self.centres = np.array([r.centre for r in rows], np.float64)
        self.radius = [float(r.radius) for r in rows]
        self.parts = max([1, *(-(-r.vectors // self.ROWS) for r in rows)])

    def _meet(self, probed: DataFrame, on: list[str]) -> DataFrame:
        """`query_id, chunk_id, distance` of queries and the vectors of their lists."""
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(self.parts)).cast("int")
        asked = probed.withColumn("_part", F.explode(F.array([F.lit(i) for i in range(self.parts)])))
        pairs = self.lists.drop("away").withColumn("_part", part).join(asked, ["list", "_part", *on])
        return pairs.select("query_id", "chunk_id", F.round(squared_distance(F.col("vec"), F.col("embedding")), 6).alias("distance"))

    @staticmethod
    def _best(pairs: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, probes: int, on: tuple[str, ...] = ()) -> DataFrame:
        """`query_id, chunk_id, distance, rank`: the k nearest of each query (`query_id`, `vec`, `on`) within its `probes` nearest lists,
        among vectors with equal `on`; distances are exact, only the choice of lists is not."""
        if not len(self.centres):
            return self._best(self._meet(queries.withColumn("list", F.lit(0).cast("long")), list(on)), k)
        near = _with_lists(queries.select("query_id", *on, "vec"), "vec", self.centres, probes)
        probed = near.select("query_id", *on, "vec", F.explode("lists").alias("list"))
        return self._best(self._meet(probed, list(on)), k)

    def exact(self, queries: DataFrame, k: int, probes: int, on: tuple[str, ...] = ()) -> DataFrame:
        """The k nearest of each query as a scan of all vectors finds them. What `probes` lists give bounds the k-th distance; a list
        whose centre is farther away than that and its radius holds nothing nearer. Queries for which the probed lists hold
        less than k read all lists of their scope."""
        if not len(self.centres):
            return self.search(queries, k, probes, on)
        near = _with_lists(queries.select("query_id", *on, "vec"), "vec", self.centres, len(self.centres))
        every = near.select("query_id", *on, "vec", F.posexplode(F.arrays_zip("lists", "away")).alias("_order", "p")).select("query_id", *on, "vec", "_order", F.col("p.lists").alias("list"), F.col("p.away").alias("away"))
        first = self._best(self._meet(every.filter(F.col("_order") < probes).drop("_order", "away"), list(on)), k)
        bound = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.sqrt(F.max("distance") + self.SLACK)).alias("bound"))
        radius = F.element_at(F.array(*[F.lit(r) for r in self.radius]), (F.col("list") + 1).cast("int"))
        more = every.filter(F.col("_order") >= probes).join(bound, "query_id", "left")
        more = more.filter(F.col("bound").isNull() | (F.col("away") - radius <= F.col("bound") + self.SLACK))
        rest = self._best(self._meet(more.select("query_id", *on, "vec", "list"), list(on)), k)
        return self._best(first.drop("rank").unionByName(rest.drop("rank")), k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, on: tuple[str, ...] = ()) -> int:
        """How many lists `search` must probe to find that share of the true k nearest of these queries: measured against `exact`, by the
        place of each true neighbour's list in its query's order. A stated set of queries stands for those to come."""
        if not len(self.centres):
            return 1
        near = _with_lists(queries.select("query_id", "vec"), "vec", self.centres, len(self.centres))
        order = near.select("query_id", F.posexplode("lists").alias("_order", "list"))
        true = self.exact(queries, k, max(1, len(self.centres) // 4), on).select("query_id", "chunk_id").join(self.lists.select("chunk_id", "list"), "chunk_id")
        found = true.join(order, ["query_id", "list"]).groupBy("_order").count().orderBy("_order").collect()  # a row a list
        total, so_far = sum(r["count"] for r in found), 0
        for r in found:
            so_far += r["count"]
            if so_far >= recall * total:
                return r["_order"] + 1
        return len(self.centres)
