"""Embedding near-duplicates by iterative quantisation.

A rotation is learned that makes binary codes balanced and close to the rotated
vectors (ITQ). Codes are cut into `TABLES` segments, each a Hamming table. A
vector probes, in every table, the codes that differ in bits where its own
rotated components are small, and what it meets is reranked with the original
vectors in double precision.

Which bits to flip is not guessed: unit vectors with cosine c differ by at most
d2 = 2 - 2c, so in one of m segments by at most d2 / m, and the squares of the
components that change sign there sum to at most d2 / 2m on one of the two
sides. That side's probe reaches the other's code, so no link is lost. A vector
with more probes than `PROBES` in a segment (nearly zero there) is compared with
all of its label in blocks instead. Blocks are formed alike for every table:
buckets are split into chunks, and chunk meets chunk in a task of bounded size,
which returns sums of links and a spanning forest, never its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, discard, keyed, release

COSINE = 0.98
BITS, TABLES = 64, 4
SAMPLE = 20_000
"""Vectors that the rotation is learned from, at most: those with the least hash of their id."""
ROUNDS = 30
LENGTHS = 64
"""Vector lengths that get a rotation, the most frequent ones; vectors of others are compared in blocks, all of them."""
PROBES = 512
CHUNK_ROWS = 1024
BUNDLE = 2048
"""Vectors for each bundle of small buckets of a label and table."""


def itq(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 4) -> np.ndarray:
    """A d x b matrix with orthonormal columns (b: the lesser of bits and d): principal
    directions, then the rotation that brings rotated vectors close to their signs."""
    d = sample.shape[1]
    b = min(bits, d)
    _, vec = np.linalg.eigh(sample.T @ sample) if len(sample) else (None, np.eye(d))
    top = vec[:, ::-1][:, :b]
    rng = np.random.default_rng(seed)
    rot = np.linalg.qr(rng.standard_normal((b, b)))[0]
    v = sample @ top
    for _ in range(rounds if len(sample) else 0):
        u, _, wt = np.linalg.svd(np.where(v @ rot >= 0, 1.0, -1.0).T @ v)
        rot = (u @ wt).T
    return top @ rot


class Codes:
    """Rotated unit vectors, their segments and the probes of each."""

    def __init__(self, rotation: np.ndarray, cosine: float, tables: int = TABLES):
        self.rotation, self.cosine = rotation, cosine
        self.segments = [s for s in np.array_split(np.arange(rotation.shape[1]), tables) if len(s)]
        self.room = (2 - 2 * cosine) / (2 * len(self.segments))

    def turn(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.rotation

    def probes(self, y: np.ndarray, most: int = PROBES) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For every segment (number, rows, codes, home?), and which rows are wild."""
        out, wild = [], np.zeros(len(y), bool)
        limit = self.room * (1 + 1e-6) + 1e-12
        for t, seg in enumerate(self.segments):
            v = y[:, seg]
            code = (v >= 0) @ (np.int64(1) << np.arange(len(seg), dtype=np.int64))
            sq = v * v
            order = np.argsort(sq, axis=1, kind="stable")
            sq = np.take_along_axis(sq, order, 1)
            bit = np.int64(1) << order.astype(np.int64)
            rows, codes, total, last = np.arange(len(y)), code, np.zeros(len(y)), np.full(len(y), -1)
            parts = [(rows, codes, np.ones(len(y), bool))]
            count = np.ones(len(y), np.int64)
            at = np.arange(len(seg))
            while len(rows):
                ok = (at[None, :] > last[:, None]) & (total[:, None] + sq[rows] <= limit)
                i, j = np.nonzero(ok)
                count += np.bincount(rows[i], minlength=len(y))
                over = count > most
                wild |= over
                keep = ~over[rows[i]]
                i, j = i[keep], j[keep]
                rows, codes, total, last = rows[i], codes[i] ^ bit[rows[i], j], total[i] + sq[rows[i], j], j
                parts.append((rows, codes, np.zeros(len(rows), bool)))
            out.append((t, *(np.concatenate(z) for z in zip(*parts, strict=True))))
        return out, wild

    def owner(self, ya: np.ndarray, yb: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The one table that counts each pair of rows, and who meets the other's code there:
        0 both share it, 1 the first probes, 2 the second."""
        table, who = np.full(len(a), -1), np.zeros(len(a), np.int64)
        for t, seg in enumerate(self.segments):
            x, y = ya[:, seg], yb[:, seg]
            diff = (x >= 0) != (y >= 0)
            sx, sy = (x * x * diff).sum(1), (y * y * diff).sum(1)
            new = (table < 0) & (np.minimum(sx, sy) <= self.room)
            table[new] = t
            side = np.where(~diff.any(1), 0, np.where((sx < sy) | ((sx == sy) & (a < b)), 1, 2))
            who[new] = side[new]
        return table, who


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


CODED = "node long, label string, d int, tbl int, code long, home boolean"


def _code_rows(codes: dict[int, Codes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(part: pa.RecordBatch, at: np.ndarray, tbl: int, code: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        own = part.take(pa.array(at))
        return pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(np.full(len(at), tbl, np.int32)), pa.array(code), pa.array(home)], names=[c.split()[0] for c in CODED.split(", ")])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                length = part.column(2).to_numpy()
                for d in np.unique(length).tolist():
                    at = np.flatnonzero(length == d)
                    wild = np.ones(len(at), bool)
                    if d in codes:
                        found, wild = codes[d].probes(codes[d].turn(_matrix(part.column(3).take(pa.array(at)), d)))
                        for t, r, code, home in found:
                            tame = ~wild[r]
                            yield rows(part, at[r[tame]], t, code[tame], home[tame])
                    w = at[wild]
                    yield rows(part, w, -1, np.zeros(len(w), np.int64), np.zeros(len(w), bool))

    return f


def _block(every: dict[int, Codes], cosine: float) -> Callable[[pa.Table], pa.Table]:
    """Links of one block of a large bucket, or of a bundle of small ones of one table, as
    (node, links) sums and (node, other) forest edges."""

    def f(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        tbl, d = int(t.column("tbl")[0].as_py()), int(t.column("d")[0].as_py())
        codes = every.get(d)
        lo, hi = int(t.column("lo")[0].as_py()), int(t.column("hi")[0].as_py())
        code = t.column("code").to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        node, home, chunk, copies = (t.column(c).to_numpy()[order] for c in ("node", "home", "chunk", "copies"))
        x = _matrix(t.column("vec"), d)[order]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))
        links = np.zeros(len(node), np.int64)
        parent = np.arange(len(node))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def settle() -> None:
            """Of the pairs met so far, those that this table counts."""
            if not pairs:
                return
            i, j = (np.concatenate(z) for z in zip(*pairs, strict=True))
            pairs.clear()
            if tbl >= 0:
                owner, who = codes.owner(codes.turn(x[i]), codes.turn(x[j]), node[i], node[j])
                roles = np.where(who == 0, home[i] & home[j], np.where(who == 1, ~home[i] & home[j], home[i] & ~home[j]))
                i, j = i[(owner == tbl) & roles], j[(owner == tbl) & roles]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)

        held = 0
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first, second = (a + np.flatnonzero(chunk[a:z] == k) for k in (lo, hi))
            for s in range(0, len(first), 256):
                rows = first[s : s + 256]
                i, j = np.nonzero(unit[rows] @ unit[second].T >= cosine)
                i, j = rows[i], second[j]
                keep = (node[i] != node[j]) & (home[i] | home[j] if tbl >= 0 else ~home[i] | ~home[j])
                if lo == hi:
                    keep &= i < j
                if keep.any():
                    pairs.append((i[keep], j[keep]))
                    held += int(keep.sum())
                if held > 100_000:
                    settle()
                    held = 0
        settle()
        got = np.flatnonzero(links)
        roots = np.array([find(int(i)) for i in got], np.int64)
        return pa.table({"node": pa.array(node[got]), "links": pa.array(links[got]), "other": pa.array(node[roots] if len(got) else node[:0])})

    return f


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every row of `vectors` (`vec_id`,
    `embedding`, `label` of any simple type).

    Rows are compared when labels are equal and not null, and vectors of one length.
    Null and empty vectors, zero ones and those with a null or non-finite component link with nothing. Very
    long vectors are read whole. Ties: equal vectors are one class, compared
    once and linked with each other. Repeated rows are vectors of their own; a null id is named null and is
    the smallest. Other columns are ignored, whatever they are called; an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = keyed(vectors, "vec_id", "label", "embedding").select("_id", "_k", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    sound = F.expr("label is not null and size(vec) > 0 and forall(vec, c -> c is not null and not isnan(c) and abs(c) < double('Infinity')) and exists(vec, c -> c <> 0)")
    rows = cut(rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("d", F.size("vec")))
    alone = rows.filter("not ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    # a class has a number of its own, kept by the written table
    classes = rows.filter("ok").groupBy("label", "d", "vec").agg(F.count("*").alias("copies"), F.min("_id").alias("low"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "label", "d", "vec", "copies", "low"))
    release(spark)
    lengths = classes.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    codes = {}
    for r in lengths:
        sample = classes.filter(F.col("d") == r["d"]).select("low", "vec").orderBy(F.xxhash64("low"), "low", "vec").limit(SAMPLE).select("vec").toArrow().column(0)
        x = _matrix(sample, r["d"])
        codes[r["d"]] = Codes(itq(x / np.linalg.norm(x, axis=1, keepdims=True), bits), cosine, tables)
    key = ["label", "d", "tbl", "code"]
    coded = cut(classes.select("node", "label", "d", "vec").mapInArrow(_code_rows(codes), CODED))
    # wild vectors: one bucket a label, with all of its vectors as homes
    wild = coded.filter("tbl < 0")
    homes = classes.join(wild.select("label", "d").distinct(), ["label", "d"], "left_semi").select("node", "label", "d", F.lit(-1).alias("tbl"), F.lit(0).cast("long").alias("code"), F.lit(True).alias("home"))
    homes = homes.join(wild.select("node"), "node", "left_anti").select(coded.columns).unionByName(wild)
    every = coded.filter("tbl >= 0").unionByName(homes)
    bucket = every.groupBy(*key).agg(F.count("*").alias("n"), F.max("home").alias("any")).filter("n > 1 and (any or tbl < 0)").select(*key, F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks"))
    met = every.join(bucket, key).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    met = met.withColumn("o", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("lo", F.least("chunk", "o")).withColumn("hi", F.greatest("chunk", "o"))
    # small buckets share a task: a bundle is a hash of codes; the blocks of a large one stand alone
    bundles = max(1, -(-classes.count() // BUNDLE))
    met = met.withColumn("bundle", F.when(F.col("chunks") > 1, F.col("code") + bundles).otherwise(F.pmod(F.xxhash64("code"), F.lit(bundles)))).drop("o", "chunks", "label", "d")
    blocks = met.join(classes.select("node", "label", "d", "vec", "copies"), "node")
    linked = cut(blocks.groupBy("label", "d", "tbl", "bundle", "lo", "hi").applyInArrow(_block(codes, cosine), "node long, links long, other long"))
    release(spark)
    tied = components(linked.select(F.col("node").alias("src"), F.col("other").alias("dst")))
    degree = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(degree, "node", "left").join(tied, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    least = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = cut(named.join(least, "comp").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    release(spark)
    discard(coded, linked, classes)
    out = rows.filter("ok").join(named, ["label", "vec"]).select("_id", "n_links", "component_id")
    return _named(out.unionByName(alone))


def _named(rows: DataFrame) -> DataFrame:
    from .common import NULL_ID

    vec_id = lambda c: F.when(F.col(c) != F.lit(NULL_ID), F.col(c))
    return rows.select(vec_id("_id").alias("vec_id"), "n_links", vec_id("component_id").alias("component_id"), (F.col("_id") == F.col("component_id")).alias("kept"))


#: The same by comparing all pairs of a label.
SQL = """WITH RECURSIVE e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
 r AS (SELECT vec_id AS v, vec_id AS o FROM e UNION SELECT r.v, l.b FROM r JOIN l ON r.o = l.a), c AS (SELECT v, min(o) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
 SELECT v AS vec_id, coalesce(n, 0) AS n_links, component_id, v = component_id AS kept FROM c LEFT JOIN n ON v = a"""


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` of all of `embeddings`; odd input as there."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
