"""A Merkle manifest of a dataset, and an authentication path for every row by fractal traversal.

A row's leaf is the hash of its fields. The leaves of a source, in the order of their ids, form a tree
whose nodes are hashes of 16 children (the last run of a level: fewer); the roots of the sources form one more.

Spark sorts thin rows (id and hashes, no texts) and cuts each source into aligned blocks of 16 ** 3 leaves. Blocks
are hashed to their roots, and these level by level to subroots and root, by aggregates of 16 rows. Coming down
again, each node adds its run to its parent's path: the upper proof of every block. In a block a traversal keeps a stack of
existing subtrees, those on the way to the current leaf, and of desired ones, their right neighbours, which grow by one leaf
a step; it emits the leaves' paths one after the other and appends the block's upper proof. It holds a
few runs of 16 nodes, whatever the block's length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .order import ranked

ARITY = 16
BLOCK_HEIGHT = 3
"""Levels of an aligned block: 4,096 leaves."""
TOP = 15
"""Levels of a source at most: 16 ** 15 rows are beyond the numbers of rows that Spark counts."""
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


# -- leaves --------------------------------------------------------------------------


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column, columns: Sequence[str] = COLUMNS) -> Column:
    """The leaf of a row whose `text` is as given: each field as its bytes' number, a colon and itself, a null one as a dash."""
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in columns]), 256)


def lowered(text: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


# -- a block's traversal ----------------------------------------------------------------


class Subtree:
    """The nodes of levels `low` to `high - 1` under one node of level `high`; grows leaf by leaf."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.kept: list[list[str]] = [[] for _ in range(low, high)]
        self.open: list[list[str]] = [[] for _ in range(high)]

    def push(self, digest: str, level: int = 0) -> None:
        while level < self.high:
            if level >= self.low:
                self.kept[level - self.low].append(digest)
            run = self.open[level]
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = hashed(*run) if level + 1 < self.high else ""
            run.clear()
            level += 1

    def close(self) -> None:
        """The runs that the end of the leaves left short become nodes too."""
        for level in range(self.high - 1):
            run = self.open[level]
            if run:
                digest = hashed(*run)
                run.clear()
                self.push(digest, level + 1)


def traverse(leaves: Sequence[str], height: int, span: int = 1) -> Iterator[list[tuple[list[str], int]]]:
    """For each leaf its path, level by level: the run of its node and the node's place there. `height`: levels of
    the tree, all of whose leaves these are; `span`: levels of a subtree."""
    bands = [(low, min(low + span, height)) for low in range(0, height, span)]
    n = len(leaves)
    existing, desired, fed = [], [], []
    for low, high in bands:
        width = ARITY**high
        now = Subtree(low, high)
        for i in range(min(width, n)):
            now.push(leaves[i])
        now.close()
        existing.append(now)
        desired.append(Subtree(low, high))
        fed.append(width)
    for i in range(n):
        path = []
        for (low, high), tree in zip(bands, existing, strict=True):
            start = i - i % ARITY**high
            for level in range(low, high):
                at = (i - start) // ARITY**level
                first = at - at % ARITY
                path.append((tree.kept[level - low][first : first + ARITY], at - first))
        yield path
        for k, (low, high) in enumerate(bands):
            if fed[k] < n:
                desired[k].push(leaves[fed[k]])
                fed[k] += 1
            if (i + 1) % ARITY**high == 0:
                desired[k].close()
                existing[k], desired[k] = desired[k], Subtree(low, high)


def fold(digest: str, path: Sequence[tuple[Sequence[str], int]]) -> str:
    """The root that a node's digest gives with its siblings."""
    for run, at in path:
        digest = hashed(*run[:at], digest, *run[at + 1 :])
    return digest


def siblings(path: Sequence[tuple[Sequence[str], int]]) -> list[str]:
    return [d for run, at in path for d in (*run[:at], *run[at + 1 :])]


# -- upper levels, distributed -------------------------------------------------------------


def height_of(size: Column) -> Column:
    """Levels above `size` leaves: 0 for one."""
    return sum((size > F.lit(ARITY**k)).cast("int") for k in range(TOP))


def _joined(run: Column) -> Column:
    return F.sha2(F.array_join(run, ""), 256)


def block_roots(rows: DataFrame, height: int = BLOCK_HEIGHT) -> DataFrame:
    """`tree, height, idx, digest`: the root of each aligned block of leaves (`tree, height, _rank, leaf`)."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "leaf"))), lambda s: s["leaf"])
    out = rows.groupBy("tree", "height", F.expr(f"_rank div {ARITY**height}").alias("idx")).agg(in_order.alias("a"))
    for level in range(height):
        runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size(a) - 1) div {ARITY}")), lambda i: _joined(F.slice("a", i * ARITY + 1, F.lit(ARITY))))
        out = out.withColumn("a", F.when(F.col("height") > level, runs).otherwise(F.col("a")))
    return out.select("tree", "height", "idx", F.col("a")[0].alias("digest"))


def climb(nodes: DataFrame, lowest: int, top: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level from `lowest` to `top` - 1 (`tree, height, run, kids`), and each tree's root (`tree, height, digest`)."""
    runs: list[DataFrame] = []
    roots = nodes.filter(F.col("height") <= lowest).select("tree", "height", "digest")
    for level in range(lowest, top):
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda s: s["digest"])
        run = cut(nodes.filter(F.col("height") > level).groupBy("tree", "height", F.expr(f"idx div {ARITY}").alias("run")).agg(kids.alias("kids")))
        runs.append(run)
        nodes = run.select("tree", "height", F.col("run").alias("idx"), _joined(F.col("kids")).alias("digest"))
        roots = roots.unionByName(nodes.filter(F.col("height") == level + 1).select("tree", "height", "digest"))
    return runs, roots


def descend(runs: list[DataFrame], tops: DataFrame, lowest: int) -> DataFrame:
    """`tree, idx, path` of every node of level `lowest`: from `tops` (`tree, height, path`: what lies above each root) down,
    each node adds its run and its place in it."""
    start = tops.select("tree", "height", F.lit(0).cast("long").alias("idx"), "path")
    known = start.filter(F.col("height") == lowest + len(runs)) if runs else start
    for k in range(len(runs) - 1, -1, -1):
        level = lowest + k
        above = known.select("tree", F.col("idx").alias("run"), "path")
        down = runs[k].join(above, ["tree", "run"]).select("tree", "height", "run", "kids", "path", F.posexplode("kids").alias("at", "own"))
        step = F.array(F.struct(F.col("kids").alias("run"), F.col("at").alias("at")))
        known = down.select("tree", "height", (F.col("run") * ARITY + F.col("at")).alias("idx"), F.concat(step, "path").alias("path"))
        here = start.filter(F.col("height") == level) if k else start.filter(F.col("height") <= level)
        known = known.unionByName(here)
    return known.select("tree", "idx", "path")


PATH = "array<struct<run:array<string>,at:int>>"


# -- the manifest -----------------------------------------------------------------------------


def _paths(rows: pa.Table, above: pa.Table, with_proof: bool) -> pa.Table:
    """A block's rows with their paths' digests; `above` is the block's row of upper proofs."""
    rows = rows.sort_by("_rank")
    up = [(step["run"], step["at"]) for step in above.column("path")[0].as_py()]
    subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
    over = "".join(siblings(up))
    leaves, now = rows.column("leaf").to_pylist(), rows.column("now").to_pylist()
    height = min(rows.column("height")[0].as_py(), BLOCK_HEIGHT)
    clean = fold(leaves[0], [*next(traverse(leaves, height)), *up])
    digest, folded, proofs = [], [], []
    for own, given, path in zip(leaves, now, traverse(leaves, height), strict=True):
        proof = "".join(siblings(path)) + over
        digest.append(sha256(proof.encode()).hexdigest())
        folded.append(fold(given, [*path, *up]))
        if with_proof:
            proofs.append([proof[i : i + 64] for i in range(0, len(proof), 64)])
    if clean != root:
        raise RuntimeError("a block's path does not lead to the root")
    n = len(leaves)
    columns = {"doc_id": rows.column("doc_id"), "leaf": rows.column("leaf"), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(digest), "folded_root": pa.array(folded)}
    return pa.table(columns | ({"proof": pa.array(proofs, pa.list_(pa.string()))} if with_proof else {}))


def manifest(docs: DataFrame, now: Column | None = None, with_proof: bool = False) -> DataFrame:
    """`doc_id, leaf, subroot, root, proof_sha256, folded_root` of every row of `docs`, with `proof` (the siblings'
    digests, from the leaf's level up) if asked for. `now`: the text as it is found now; `folded_root` is the root that
    it leads to with the untampered siblings, so a row is verified where it equals `root`.

    Null fields are dashes, so a null text and an empty one differ; null ids come first, and rows that repeat an id are leaves of their own in
    the order of their digests; a null source is a source of its own; very long texts are hashed in the scan and
    travel no further. Other columns are ignored, whatever they are called; an empty table gives no rows."""
    text = F.col("text")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(text).alias("leaf"), leaf(text if now is None else now).alias("now"))
    place = ranked(thin, "source", "doc_id", "leaf", "now")
    rows = cut(place.select("doc_id", "leaf", "now", F.col("_no").alias("tree"), "_rank", height_of(F.col("_size")).alias("height")))
    top = rows.agg(F.max("height")).first()[0]
    if top is None:
        return _shaped(rows.limit(0).select("doc_id", "leaf", *[F.col("leaf").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")]), with_proof)
    runs, roots = climb(block_roots(rows), BLOCK_HEIGHT, max(top, BLOCK_HEIGHT))
    roots = cut(roots)
    # the tree of the sources: one tree whose leaves are the subroots, a row a source
    n = roots.count()
    levels = sum(n > ARITY**k for k in range(TOP))
    over, last = climb(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(levels).alias("height"), F.col("tree").alias("idx"), "digest"), 0, levels)
    above = descend(over, last.select("tree", "height", F.expr(f"cast(array() as {PATH})").alias("path")), 0)
    tops = roots.join(above.select(F.col("idx").alias("tree"), "path"), "tree")
    blocks = descend(runs, tops.select("tree", "height", "path"), BLOCK_HEIGHT)
    root = last.select(F.col("digest").alias("root"))
    proofs = blocks.join(roots.select("tree", F.col("digest").alias("subroot")), "tree").crossJoin(F.broadcast(root))  # one row
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", proof array<string>" if with_proof else "")
    by = rows.withColumn("idx", F.expr(f"_rank div {ARITY**BLOCK_HEIGHT}")).groupBy("tree", "idx")

    def paths(left: pa.Table, right: pa.Table) -> pa.Table:
        return _paths(left, right, with_proof)

    return by.cogroup(proofs.groupBy("tree", "idx")).applyInArrow(paths, schema)


def _shaped(df: DataFrame, with_proof: bool) -> DataFrame:
    return df.withColumn("proof", F.expr("cast(array() as array<string>)")) if with_proof else df


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`manifest` of all of `documents`, where every fifth text (by crc32 of the id) is found in lower case; odd input
    as there. A null id's row is not tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    got = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.when(tampered, lowered(F.col("text"))).otherwise(F.col("text")))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same manifest in SQL: crc32 bit by bit, levels and paths by recursion.
SQL = """
WITH RECURSIVE d AS (
    SELECT *, sha256(concat(f_id, f_source, f_lang, f_chars, f_text)) AS leaf, sha256(concat(f_id, f_source, f_lang, f_chars, f_lowered)) AS lowered,
        coalesce(xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 5 = 0, false) AS tampered
    FROM (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS f_id, coalesce(strlen(source) || ':' || source, '-') AS f_source,
        coalesce(strlen(lang) || ':' || lang, '-') AS f_lang, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS f_chars, coalesce(strlen(text) || ':' || text, '-') AS f_text,
        coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS f_lowered FROM documents)),
leaves AS (
    SELECT doc_id, leaf, if(tampered, lowered, leaf) AS found, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
nodes AS (
    SELECT tree, 0 AS level, idx, leaf AS digest, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16),
runs AS (SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS kids FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
upper_nodes AS (
    SELECT 0 AS level, tree AS idx, digest, (SELECT count(*) FROM subroots) AS n FROM subroots
    UNION ALL
    SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 16),
upper_runs AS (SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS kids FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 16),
walk AS (
    SELECT doc_id, leaf, tree, 0 AS level, idx, found, '' AS proof, 0 AS steps FROM leaves
    UNION ALL
    SELECT doc_id, leaf, tree, w.level + 1, w.idx // 16, sha256(array_to_string(list_concat(kids[1 : w.idx % 16], [found], kids[w.idx % 16 + 2 :]), '')),
        proof || array_to_string(list_concat(kids[1 : w.idx % 16], kids[w.idx % 16 + 2 :]), ''), steps + 1
    FROM walk w JOIN runs r USING (tree, level) WHERE r.run = w.idx // 16),
done AS (SELECT w.* FROM walk w JOIN (SELECT tree, max(level) AS level FROM nodes GROUP BY tree) USING (tree, level)),
upper_walk AS (
    SELECT doc_id, leaf, tree, 0 AS level, tree AS idx, found, proof FROM done
    UNION ALL
    SELECT doc_id, leaf, tree, w.level + 1, w.idx // 16, sha256(array_to_string(list_concat(kids[1 : w.idx % 16], [found], kids[w.idx % 16 + 2 :]), '')),
        proof || array_to_string(list_concat(kids[1 : w.idx % 16], kids[w.idx % 16 + 2 :]), '')
    FROM upper_walk w JOIN upper_runs r USING (level) WHERE r.run = w.idx // 16)
SELECT w.doc_id, w.leaf, s.digest AS subroot, u.digest AS root, sha256(w.proof) AS proof_sha256, w.found AS folded_root, w.found = u.digest AS verified
FROM upper_walk w JOIN subroots s USING (tree) JOIN (SELECT * FROM upper_nodes WHERE n = 1) u ON w.level = u.level
"""
