"""Groups of near copies: word shingles whose Jaccard similarity is 0.8 or more, by SimHash, completed exactly.

Every set has a SimHash of BITS bits: of 64 about ten differ at 0.8, and so do those of unrelated short
texts; of 512 about 78 differ there, and 256 of unrelated texts. Multi-index tables, each on three bytes of
the fingerprint, bring together sets that agree in one of them. A bucket's sets are
held against its middle, which meets most others in all tables: by Hamming distance, then by their shingles, first with the nearest one, then with
all others that are in another group yet.

A SimHash can miss a pair, so an exact search follows over what it has left in different groups: in any fixed order of all
shingles, two sets at 0.8 share one of the first n - ceil(0.8 n) + 1 of each. The order
puts what is frequent last, in a sample and then among these first shingles of all sets, which changes the cost, never the result. In lists
of more than one group all are held against the one that is near to most sets so far (the pivot). Two that are both near it are in one group already; of the others only pairs are compared whose
distances from the pivot differ by 0.2 at most (Jaccard distance is a metric) and that
aren't in one group yet, so a large group costs its size, not its square. Such a pair must also be able to reach the
similarity from its places in the common order: what two sets share is at most the shingle they meet at and all behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, chunks, components, cut, cut_parts, discard, keyed, keyed_rows, lean, mix, release, signed, utf8, word_bounds, word_hashes

SHINGLE = 5
NUM, DEN = 4, 5
"""The least similarity, 4/5, as whole numbers: comparisons are exact."""
SAMPLE_DOCS, FREQUENT, TABLE = 10_000, 4, 200_000
"""Documents sampled for the order, occurrences there of a frequent shingle, and how many of those are told apart."""
SEEN = 500_000
PARTS = 4
"""Sets are compared in at most so many rounds, so that a round's shuffles go before the next ones come."""
READS = 8
"""Texts whose sets are compared are gathered in at most so many rounds, for the same reason."""
FULL = 100_000_000
"""Shingles of all texts from which on all these rounds are taken. Smaller tables take fewer: the driver keeps the plan and
the metrics of each round's queries, whatever their size."""
WIDTH = 5
"""Bytes of a shingle's hash that travel in a set: two of n shingles of a pair are taken for one with a chance of n * n / 2 ** 40."""
BITS = 512
SALTS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TABLES = np.add.outer(np.arange(BITS // 8), (0, 7, 20)) % (BITS // 8)
"""The bytes of a fingerprint that each table is on: two tables have one in common at most."""
DISTANCE = 126
"""Bits in which near sets may differ: at the least similarity 78 on average, with a deviation of 8."""


def shingle_sets(col: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles (ASCII letters in lower case);
    fewer words than a shingle are one, no words give the empty set."""
    data, offs = utf8(col)
    for i, j in chunks(offs):
        part = data[offs[i] : offs[j]]
        part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        starts, ends, first = word_bounds(part, offs[i : j + 1] - offs[i])
        words = word_hashes(part, starts, ends)
        rolled = Rolling(words)
        every = np.arange(max(0, len(words) - shingle + 1))
        codes = rolled.of(every, every + shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(codes[a : b - shingle + 1])
            else:
                yield rolled.of(np.array([a]), np.array([b])) if b > a else codes[:0]


def set_id(codes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(codes.tobytes(), 7)).view(np.int64))


def simhash(codes: np.ndarray) -> bytes:
    """BITS bits: each is 1 where more than half of the shingles have it in their hashes."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(codes), 255):  # as many as a byte counts
        own = mix(codes[a : a + 255, None] ^ SALTS)
        ones += np.add.reduce(np.unpackbits(own.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(codes), bitorder="little").tobytes()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set in its bucket of every table."""
    for b in batches:
        fps = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
        keys = fps[:, TABLES].astype(np.int64) @ np.array([1, 1 << 8, 1 << 16]) + (np.arange(len(TABLES)) << 24)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), len(TABLES)))], names=["key", "sid"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p, q = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.bitwise_count(p ^ q).sum(1, dtype=np.int64))], names=["src", "dst", "d"])


def alike(prints: DataFrame) -> DataFrame:
    """`src, dst, d`: the pairs of a bucket's middle and each other set of it, at most DISTANCE bits (`d`) apart, once. The middle
    is what meets most others in all tables: copies of one text are nearer to it than to each other.
    `prints`: `sid, n, fp`, one row a set."""
    by_key = Window.partitionBy("key")
    held = prints.select("sid", "fp").mapInArrow(lean(_buckets), "key long, sid long").withColumn("size", F.count("*").over(by_key))
    held = cut(held.filter("size > 1"))
    met = held.join(held.groupBy("sid").agg(F.sum("size").alias("weight")), "sid").withColumn("mid", F.max(F.struct("weight", "sid")).over(by_key)["sid"])
    pairs = met.filter("sid <> mid").select(F.col("mid").alias("src"), F.col("sid").alias("dst")).distinct()
    a = prints.select(F.col("sid").alias("src"), F.col("n").alias("m"), F.col("fp").alias("p"))
    b = prints.select(F.col("sid").alias("dst"), "n", F.col("fp").alias("q"))
    met = pairs.join(a, "src").join(b, "dst").filter(_fit("m", "n")).select("src", "dst", "p", "q")
    return met.mapInArrow(lean(_distances), "src long, dst long, d long").filter(F.col("d") <= DISTANCE)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = list(shingle_sets(b.column(0)))
        codes, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([signed(codes), pa.array(n, pa.int64())], names=["code", "n"])


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes (sorted) and ranks (1 the rarest) of shingles that are frequent in a sample; at most TABLE."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64("_id", "_k"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    count = some.mapInArrow(lean(_frequent), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    got = count.orderBy(F.desc("n"), "code").limit(TABLE).toArrow()
    codes = got.column("code").to_numpy().view(np.uint64)
    at = np.argsort(codes)
    return codes[at], (len(codes) - np.arange(len(codes)))[at].astype(np.int32)


def ordered(held: DataFrame, known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`known` and `rank` with the shingles that are frequent in the prefixes of all sets, at most TABLE, in front of those of
    the sample: the rarest has rank 1 again."""
    count = held.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    got = count.orderBy(F.desc("n"), "key").limit(TABLE).select("key").toArrow().column("key").to_numpy().view(np.uint64)
    new = got[::-1][~np.isin(got[::-1], known)]
    codes = np.concatenate([new, known[np.argsort(rank, kind="stable")]])
    at = np.argsort(codes)
    return codes[at], (at + 1).astype(np.int32)


def prefix(codes: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first codes in the common order: of two sets at the least similarity one is in both prefixes."""
    n = len(codes)
    if not n:
        return codes
    order = np.zeros(n, np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        order = np.where(known[at] == codes, rank[at], 0)
    return codes[np.argsort(order, kind="stable")[: n + NUM * -n // DEN + 1]]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sizes, fps = [], [], []
        for c in shingle_sets(b.column(2)):
            ids.append(set_id(c))
            sizes.append(len(c))
            fps.append(simhash(c))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary())], names=["_id", "_k", "sid", "n", "fp"])


def _postings(known: np.ndarray, rank: np.ndarray):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, sids, sizes = [np.zeros(0, np.uint64)], [], []
            for c in shingle_sets(b.column(0)):
                s = set_id(c)
                if s in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(s)
                keys.append(prefix(c, known, rank))
                sids.append(s)
                sizes.append(len(c))
            times = [len(k) for k in keys[1:]]
            place = np.concatenate([np.zeros(0, np.int32), *[np.arange(t, dtype=np.int32) for t in times]])
            cols = [signed(np.concatenate(keys)), pa.array(np.repeat(np.array(sids, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int32), times)), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "sid", "n", "pos"])

    return f


def packed(codes: np.ndarray) -> bytes:
    """The upper WIDTH bytes of sorted hashes."""
    short = np.unique(codes >> np.uint64(8 * (8 - WIDTH)))
    return short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(raw: pa.Scalar) -> np.ndarray:
    short = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, WIDTH)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :WIDTH] = short
    return wide.view("<u8").ravel()


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(c) for c in shingle_sets(b.column(1))], pa.binary())], names=["sid", "codes"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shared, total = [], []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = unpacked(x), unpacked(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            shared.append(both)
            total.append(len(p) + len(q) - both)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["src", "dst", "shared", "total"])


def rounds(most: int, shingles: int) -> int:
    """How many of at most `most` rounds a table with so many shingles takes."""
    return max(1, min(most, -(-most * shingles // FULL)))


@dataclass
class Rounds:
    """A function of the round, and how many rounds there are."""

    n: int
    of: Callable[[int], DataFrame]

    def __call__(self, k: int) -> DataFrame:
        return self.of(k)


def _of_round(df: DataFrame, k: int, n: int, *by: str) -> DataFrame:
    """The rows of `df` that round `k` of `n` takes, dealt by the columns `by`."""
    return df.filter(F.pmod(F.xxhash64(*by, F.lit(11)), F.lit(n)) == k) if n > 1 else df


def _in_rounds(spark: SparkSession, met: Rounds) -> DataFrame:
    """`src, dst, shared, total` of the rows `src, dst, p, q` of all rounds."""
    compared = lambda k: met(k).select("src", "dst", "p", "q").mapInArrow(lean(_shared), "src long, dst long, shared long, total long")
    return cut_parts(spark, (compared(k) for k in range(met.n)))


BUCKETS = 256


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a set fall into each of BUCKETS, as 16-bit counts (the greatest: that many or more)."""
    for b in batches:
        counts = [np.minimum(np.bincount((unpacked(x) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 65535).astype("<u2").tobytes() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.binary())], names=["sid", "sketch"])


def may_be_near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets with these bucket counts (a row each) can be near: no bucket holds more common
    shingles than the lesser of its two counts."""
    most = np.minimum(p, q).sum(1)
    total = p.sum(1) + q.sum(1) - most
    return (DEN * most >= NUM * total) | (p == 65535).any(1) | (q == 65535).any(1)


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p, q = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, BUCKETS).astype(np.int64) for k in (2, 3))
        keep = pa.array(may_be_near(p, q))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["src", "dst"])


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that their sketches don't rule out: sketches are shuffled in place of sets."""
    sketches = cut(sets.select("sid", "codes").mapInArrow(lean(_sketches), "sid long, sketch binary"))
    a = sketches.select(F.col("sid").alias("src"), F.col("sketch").alias("p"))
    b = sketches.select(F.col("sid").alias("dst"), F.col("sketch").alias("q"))
    out = cut(pairs.join(a, "src").join(b, "dst").select("src", "dst", "p", "q").mapInArrow(lean(_open_pairs), "src long, dst long"))
    release(sets.sparkSession)
    discard(sketches)
    return out


def _between(pairs: DataFrame, tied: DataFrame) -> DataFrame:
    """The pairs (`src, dst`) of sets that aren't in one group so far."""
    a, b = (tied.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in ("src", "dst"))
    return pairs.join(a, "src", "left").join(b, "dst", "left").filter("coalesce(src_in, src) <> coalesce(dst_in, dst)").select("src", "dst")


def _compared(pairs: DataFrame, sets: DataFrame, parts: int, done: DataFrame | None = None) -> DataFrame:
    """Sizes of intersection and union of each pair of sets (`src, dst`) that isn't `done` yet, in `parts` rounds. The set of
    `src` goes to that of `dst`; sets of no pair stay where they are."""
    spark = sets.sparkSession
    pairs = pairs.select("src", "dst")
    pairs = cut(pairs.join(done.select("src", "dst"), ["src", "dst"], "left_anti") if done else pairs)
    release(spark)
    a = sets.select(F.col("sid").alias("src"), F.col("codes").alias("p"))
    b = lambda k: _of_round(sets, k, parts, "sid").select(F.col("sid").alias("dst"), F.col("codes").alias("q"))
    # a hash table of the pairs, which are narrow: nothing sorts the sets
    out = _in_rounds(spark, Rounds(parts, lambda k: a.join(_of_round(pairs, k, parts, "dst").hint("shuffle_hash"), "src").join(b(k), "dst")))
    discard(pairs)
    return out


def _sets(rows: DataFrame, one: DataFrame, reads: int) -> DataFrame:
    """`sid, codes` of the texts in `one` (`_id, _k, sid`), in buckets by `sid`, gathered in `reads` rounds."""
    part = lambda df, k: _of_round(df, k, reads, "_id", "_k")
    texts = (part(rows, k).join(part(one, k), ["_id", "_k"]).select("sid", "text") for k in range(reads))
    return cut_parts(rows.sparkSession, (t.mapInArrow(lean(_codes), "sid long, codes binary") for t in texts), "sid")


NEAR = f"{DEN} * shared >= {NUM} * total"


def _fit(m: str, n: str) -> str:
    """SQL: whether sets of these sizes can be near."""
    return f"({DEN} * least({m}, {n}) >= {NUM} * greatest({m}, {n}))"


def _reach(x: str, y: str) -> str:
    """SQL: whether sets that share a shingle at these places of the common order (from 0) can be near if it is their first common one:
    behind it at most the rest of the shorter remainder is common. Near sets pass at their first common shingle, so none is lost."""
    return f"({DEN + NUM} * least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {NUM} * ({x}.n + {y}.n))"


def _untied(lists: DataFrame, tied: DataFrame, by_key) -> DataFrame:
    """Lists of more than one group so far, with the group (`comp`) of each member."""
    named = lists.join(tied, lists.sid == tied.node, "left").select(*[lists[c] for c in lists.columns], F.coalesce("component", lists.sid).alias("comp"))
    return named.withColumn("lo", F.min("comp").over(by_key)).withColumn("hi", F.max("comp").over(by_key)).filter("lo <> hi").drop("lo", "hi")


def _pivoted(lists: DataFrame, degree: DataFrame, by_key) -> DataFrame:
    """Each list's `pivot`, the set that is near to most others so far (`degree`: `node, links`), and whether a member can be near it by size (`fit`)."""
    named = lists.join(degree, lists.sid == degree.node, "left").withColumn("mid", F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "sid", "n")).over(by_key))
    return named.select(*[lists[c] for c in lists.columns], F.col("mid.sid").alias("pivot"), F.expr(f"sid <> mid.sid and {_fit('n', 'mid.n')}").alias("fit"))


def groups(docs: DataFrame) -> DataFrame:
    """`_id, _k, comp`: the group of every whole text of `docs` (`doc_id`, `text`), that is
    all that near copies link, also by way of others.

    Null, empty and blank texts have no words and are one group. Very long texts are sets of all their shingles. Pairs that tie with
    the least similarity are near. Repeated rows and null ids are rows of their own. Other columns are ignored; an empty
    table gives no rows."""
    spark = docs.sparkSession
    rows = keyed(docs, "doc_id", "text")
    marks = cut(rows.mapInArrow(lean(_marks), "_id long, _k int, sid long, n int, fp binary"))
    shingles = marks.agg(F.sum("n")).first()[0] or 0
    parts, reads = rounds(PARTS, shingles), rounds(READS, shingles)
    prints = cut(marks.select("sid", "n", "fp").distinct())
    pairs = cut(alike(prints))
    release(spark)
    discard(prints)
    known, rank = frequent(rows)
    postings = lambda known, rank: rows.select("text").mapInArrow(lean(_postings(known, rank)), "key long, sid long, n int, pos int")
    known, rank = ordered(postings(known, rank), known, rank)
    release(spark)
    held = postings(known, rank)
    by_key = Window.partitionBy("key")
    lists = held.select("key", "sid", "n", "pos", F.min("sid").over(by_key).alias("low"), F.max("sid").over(by_key).alias("last")).filter("low <> last")
    lists = cut(lists.select("key", "sid", "n", "pos").distinct())
    release(spark)
    some_list = lists.select("sid").unionByName(pairs.select(F.explode(F.array("src", "dst")).alias("sid"))).distinct()
    one = marks.groupBy("sid").agg(F.min(F.struct("_id", "_k")).alias("s")).join(some_list, "sid", "left_semi").select("sid", "s._id", "s._k")
    one = cut(one)
    release(spark)
    sets = _sets(rows, one, reads)
    # the nearest by SimHash is compared first: it ties most groups, and their other pairs need no more
    nearest = pairs.groupBy("dst").agg(F.min(F.struct("d", "src")).alias("p")).select("p.src", "dst")
    first = _compared(nearest, sets, parts)
    release(spark)
    some = cut(components(first.filter(NEAR).select("src", "dst")))
    more = _compared(_between(pairs, some), sets, parts, first)
    release(spark)
    by_simhash = first.unionByName(more)
    same = cut(components(by_simhash.filter(NEAR).select("src", "dst")))
    degree = cut(by_simhash.filter(NEAR).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("links")))
    left = cut_parts(spark, (_pivoted(_untied(_of_round(lists, k, parts, "key"), same, by_key), degree, by_key) for k in range(parts)))
    discard(lists, one, degree)
    stars = left.filter("fit").select(F.col("pivot").alias("src"), F.col("sid").alias("dst")).distinct()
    second = _compared(stars, sets, parts, by_simhash)
    release(spark)
    known_pairs = by_simhash.unionByName(second)
    tied = cut(components(known_pairs.filter(NEAR).select("src", "dst")))
    far = known_pairs.select(F.col("src").alias("pivot"), F.col("dst").alias("sid"), F.expr(NEAR).alias("near"), (1 - F.col("shared") / F.col("total")).alias("d"))
    told = lambda k: _untied(_of_round(left.drop("comp"), k, parts, "key"), tied, by_key).filter("sid <> pivot").join(far, ["pivot", "sid"], "left")
    open_ = cut_parts(spark, (told(k).select("key", "sid", "n", "pos", "comp", F.coalesce("near", F.lit(False)).alias("near"), "d") for k in range(parts)))
    discard(left)
    x, y = open_.filter("not near").alias("x"), open_.alias("y")
    # sets of unlike size aren't held against the pivot: without a distance all are compared
    fits = F.expr(f"x.comp <> y.comp and (y.near or x.sid < y.sid) and coalesce(abs(x.d - y.d) <= {1 - NUM / DEN} + 1e-9, true) and {_fit('x.n', 'y.n')} and {_reach('x', 'y')}")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & fits).select(F.least("x.sid", "y.sid").alias("src"), F.greatest("x.sid", "y.sid").alias("dst")).distinct()
    rest = _possible(rest, sets)
    others = _compared(rest, sets, parts)
    release(spark)
    found = components(known_pairs.unionByName(others).filter(NEAR).select("src", "dst"))
    out = cut(marks.join(found, marks.sid == found.node, "left").select("_id", "_k", F.coalesce("component", "sid").alias("comp")))
    release(spark)
    discard(marks, pairs, sets, first, some, more, same, second, tied, open_, rest, others)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, without near copies: of each
    group the row with the least id (null: the least of all; of rows that repeat it, the first by text) stays. Columns may be
    called anything; other odd input as in `groups`."""
    stay = groups(docs).groupBy("comp").agg(F.min(F.struct("_id", "_k")).alias("s")).select("s._id", "s._k")
    return keyed_rows(docs, "text").select("_id", "_k", "_row").join(stay, ["_id", "_k"], "left_semi").select("_row.*")
