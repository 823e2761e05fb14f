"""The index of windows of w consecutive symbols (words or bytes) that may occur more than once.

A lossless sample keeps the work far below one row a position. In every window
the k-gram with the least hash (leftmost of equals) is its anchor; equal windows
have equal anchors at equal offsets. Consecutive windows with one anchor form
its run, and the symbols under a run are the run's context. Then:

* an anchor whose k-gram is nowhere else has no repeated window (dropped);
* runs with equal contexts repeat as a whole (one row per context, pre-aggregated
  in each task before any shuffle);
* only where one k-gram has several contexts must their representatives be looked into:
  byte by byte sorted prefixes (suffix_dedup.py), or windows near the ends of
  factors (substring_dedup.py).

Names are 64-bit hashes; contexts and windows are compared only within one name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, U64, Rolling, chunks, cut, discard, mix, release, signed, utf8, word_bounds, word_hashes

POS = (1 << 24) - 1
SEGMENT = 1 << 20


@dataclass(frozen=True)
class Shape:
    """w: symbols of a window; k: symbols of an anchor; step: windows of a block;
    words: symbols are words, else bytes; salt: changes all names, and those of words from their bytes on."""

    w: int
    k: int
    step: int
    words: bool
    salt: int = 0

    def symbols(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol codes of concatenated texts and each text's first symbol (n + 1)."""
        if not self.words:
            return mix(BYTE_CODES ^ U64(self.salt))[data], offs
        starts, ends, first = word_bounds(data, offs)
        return word_hashes(data, starts, ends, self.salt), first


def runs(sym: np.ndarray, first: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(row, name, ctx, s1, n, a) of every run: its text, its anchor's and its
    context's hash, its first window's start in the text, its number of windows,
    and its anchor's offset in the first one."""
    w, k = shape.w, shape.k
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(0, len(sym) - w + 1), SEGMENT):
        seg = sym[lo : lo + SEGMENT + w - 1]
        n = len(seg) - w + 1
        if n <= 0:
            break
        roll = Rolling(seg)
        p = np.arange(len(seg) - k + 1)
        grams = roll.of(p, p + k)
        key = (grams & U64(~POS & (2**64 - 1))) | p.astype(U64)
        per = w - k + 1
        pad = np.full((len(key) + per - 1) // per * per, U64(2**64 - 1))
        pad[: len(key)] = key
        block = pad.reshape(-1, per)
        down = np.minimum.accumulate(block, axis=1).ravel()
        up = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(up[:n], down[per - 1 : per - 1 + n]) & U64(POS)).astype(np.int64)
        s = np.arange(lo, lo + n)
        row = np.searchsorted(first, s, "right") - 1 if len(first) > 2 else np.zeros(n, np.int64)
        ok = s + w <= first[row + 1]
        head = ok.copy()
        head[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        tail = ok.copy()
        tail[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
        h, t = np.flatnonzero(head), np.flatnonzero(tail)
        if len(h):
            out.append((row[h], grams[at[h]], roll.of(h, t + w), h + lo - first[row[h]], t - h + 1, at[h] - h))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z.astype(U64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ks = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, offs = utf8(b.column(2))
            for i, j in chunks(offs):
                sym, first = shape.symbols(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                row, name, ctx, s1, n, a = runs(sym, first, shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i + row]), pa.array(ks[i + row], pa.int32()), signed(name), signed(ctx), pa.array(s1, pa.int64()), pa.array(n, pa.int32()), pa.array(a, pa.int32())],
                    names=["_id", "_k", "name", "ctx", "s1", "n", "a"],
                )

    return f


RUNS = "_id long, _k int, name long, ctx long, s1 long, n int, a int"


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of rows reduced to one row per (name, ctx): how many, and the least (_id, _k, s1)."""

    def reduce(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        c = {x: t.column(x).to_numpy() for x in t.column_names}
        o = np.lexsort((c["s1"], c["_k"], c["_id"], c["ctx"], c["name"]))
        name, ctx = c["name"][o], c["ctx"][o]
        head = np.ones(len(o), bool)
        head[1:] = (name[1:] != name[:-1]) | (ctx[1:] != ctx[:-1])
        h = np.flatnonzero(head)
        m = np.diff(np.append(h, len(o)))
        first = o[h]
        return pa.RecordBatch.from_arrays([pa.array(c[x][first]) for x in t.column_names] + [pa.array(m, pa.int64())], names=[*t.column_names, "m"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 400_000:
            yield reduce(held)
            held, rows = [], 0
    if rows:
        yield reduce(held)


def range_hash(sym: np.ndarray, s: np.ndarray, e: np.ndarray, segment: int) -> np.ndarray:
    """Hashes of sym[s : e], whatever the length of sym: sums run over one segment at a time."""
    out = np.empty(len(s), U64)
    part = s // segment
    reach = int((e - s).max()) if len(s) else 0
    for x in np.unique(part):
        at = part == x
        roll = Rolling(sym[x * segment : (x + 1) * segment + reach])
        out[at] = roll.of(s[at] - x * segment, e[at] - x * segment)
    return out


@dataclass
class Index:
    """hits: runs (RUNS) whose k-gram is elsewhere too. contexts: `name, ctx, m, _id, _k, s1, n, a`,
    how often a context occurs and its first place. representatives: those of names with several contexts."""

    hits: DataFrame
    contexts: DataFrame
    representatives: DataFrame

    def drop(self) -> None:
        discard(self.hits, self.contexts, self.representatives)


def index(docs: DataFrame, shape: Shape) -> Index:
    """The index of all texts of `docs` (`_id, _k, text`). Each text, name or context may hold any
    share of the rows: counts are pre-aggregated, and what joins back is one row a run."""
    spark = docs.sparkSession
    scan = cut(docs.mapInArrow(_scan(shape), RUNS))
    names = cut(scan.select("name").groupBy("name").count().filter("count > 1").select("name"))
    release(spark)
    hits = cut(scan.join(names, "name", "left_semi").select(*scan.columns))
    discard(scan, names)
    release(spark)
    contexts = cut(
        hits.mapInArrow(_locally, RUNS + ", m long")
        .groupBy("name", "ctx")
        .agg(F.sum("m").alias("m"), F.min(F.struct("_id", "_k", "s1")).alias("f"), F.max("n").alias("n"), F.max("a").alias("a"))
        .select("name", "ctx", "m", "f._id", "f._k", "f.s1", "n", "a")
    )
    several = contexts.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name")
    representatives = cut(contexts.join(several, "name", "left_semi").select(*contexts.columns))
    release(spark)
    return Index(hits, contexts, representatives)


def with_representatives(docs: DataFrame, found: Index) -> DataFrame:
    """`_id, _k, text, at`: the texts that hold representatives, and these as (name, ctx, s1, n, a)."""
    at = found.representatives.groupBy("_id", "_k").agg(F.collect_list(F.struct("name", "ctx", "s1", "n", "a")).alias("at"))
    return docs.join(at, ["_id", "_k"]).select("_id", "_k", "text", "at")


BLOCKS = "_id long, _k int, name long, ctx long, b int, s long, n int, full long, wins array<long>"


def blocks(b: pa.RecordBatch, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[pa.Array]]]:
    """For the texts of one batch of `with_representatives`: row, symbols, where each block's
    common part starts, and the columns of BLOCKS. Windows of a representative are taken
    in blocks of `step` by their offset to the anchor (b: offset // step); all windows
    of a block hold the w - step + 1 symbols from its last window's start on."""
    w, step = shape.w, shape.step
    data, offs = utf8(b.column(2))
    lists = b.column(3)
    loffs = lists.offsets.to_numpy()
    loffs = loffs - loffs[0]
    name, ctx, s1, n, a = (lists.flatten().field(x).to_numpy(zero_copy_only=False) for x in range(5))
    ids, ks = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
    for i in range(b.num_rows):
        sym, _ = shape.symbols(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
        for lo in range(loffs[i], loffs[i + 1], 1024):
            z = min(loffs[i + 1], lo + 1024)
            k = np.repeat(np.arange(lo, z), n[lo:z])
            nth = np.arange(len(k)) - (np.cumsum(n[lo:z]) - n[lo:z])[k - lo]
            s = s1[k] + nth
            block = (a[k] - nth) // step
            head = np.ones(len(k), bool)
            head[1:] = (k[1:] != k[:-1]) | (block[1:] != block[:-1])
            h = np.flatnonzero(head)
            many = np.diff(np.append(h, len(k)))
            last = s1[k[h]] + a[k[h]] - step * block[h]
            m = len(h)
            yield (
                i,
                sym,
                last,
                [
                    pa.array(np.full(m, ids[i])),
                    pa.array(np.full(m, ks[i], np.int32)),
                    pa.array(name[k[h]]),
                    pa.array(ctx[k[h]]),
                    pa.array(block[h], pa.int32()),
                    pa.array(s[h]),
                    pa.array(many, pa.int32()),
                    signed(range_hash(sym, s[h], s[h] + many - 1 + w, SEGMENT) + (a[k[h]] - nth[h]).astype(U64)),
                    pa.ListArray.from_arrays(pa.array(np.append(h, len(k)), pa.int32()), signed(range_hash(sym, s, s + w, SEGMENT))),
                ],
            )


def place() -> F.Column:
    return F.struct("_id", "_k", "s")


def settled(live: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Windows of `live` (BLOCKS, a class of equal common parts in `key`) that occur more than once,
    as `_id, _k, s, n, f`: n windows from s on, and the first place of what they are. Blocks
    that are equal settle as a whole; windows are compared one by one in one representative of
    each block, and only in classes of several blocks. And what to discard after."""
    fulls = cut(live.groupBy(*key, "full").agg(F.count("*").alias("m"), F.min(place()).alias("f")))
    whole = live.drop("wins").join(fulls.filter("m > 1"), [*key, "full"]).select("_id", "_k", "s", "n", "f")
    several = fulls.groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    apart = live.join(several, key, "left_semi").join(fulls.select(*key, "full", "f"), [*key, "full"]).filter(place() == F.col("f"))
    single = cut(apart.select("_id", "_k", *key, "s", F.posexplode("wins").alias("i", "win")).select("_id", "_k", *key, (F.col("s") + F.col("i")).alias("s"), "win"))
    more = single.groupBy(*key, "win").agg(F.count("*").alias("c"), F.min(place()).alias("f")).filter("c > 1").drop("c")
    one = single.join(more, [*key, "win"]).select("_id", "_k", "s", F.lit(1).alias("n"), "f")
    return whole.unionByName(one), [fulls, single]


def as_wholes(found: Index) -> DataFrame:
    """Runs whose context is elsewhere too, as `_id, _k, s, n, f`."""
    known = found.contexts.filter("m > 1").select("name", "ctx", F.struct("_id", "_k", F.col("s1").alias("s")).alias("f"))
    return found.hits.join(known, ["name", "ctx"]).select("_id", "_k", F.col("s1").alias("s"), "n", "f")


def covered(length: int, s: np.ndarray, n: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [a, b) of symbols under the windows s .. s + n - 1."""
    o = np.argsort(s, kind="stable")
    a, b = s[o], (s + n - 1 + w)[o]
    b = np.maximum.accumulate(b)
    head = np.ones(len(a), bool)
    head[1:] = a[1:] > b[:-1]
    h = np.flatnonzero(head)
    return a[h], np.minimum(b[np.append(h[1:] - 1, len(a) - 1)], length)


def span_lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (n + 1), starts and counts of a column of lists of (s, n)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
    flat = col.flatten()
    return np.append(0, np.cumsum(size)), flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)

