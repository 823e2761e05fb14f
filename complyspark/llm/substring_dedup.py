"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference is the corpus itself; its index (windows.py) lies in hash partitions, the reference
blocks: for each run of windows with one anchor, and for each window where one anchor has several
contexts, the first place of it. All runs of a document are looked up in all blocks by one
join. A document is then factored greedily, left to right: of the matches at a position the
one that reaches furthest along one reference document is the factor, and parsing goes on where it
ends. Windows across a factor's end lie in no factor; they are checked there, one match after the
other. Factors, and matches across their ends, of at least `window` words are duplicate spans.

Matches are found by names and accepted by words: the words under a match and those at its reference
place must have one BLAKE2 digest. If names ever collided, the parse runs again under other names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, doc_id, keyed, lean, release, signed, utf8
from .windows import BLOCKS, SEGMENT, Shape, as_wholes, blocks, covered, index, place, range_hash, settled, with_representatives

WINDOW, ANCHOR, STEP = 20, 5, 4
TRIES = 3


# -- lookups ---------------------------------------------------------------------------------


def _blocks(shape: Shape):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sym, at, cols in blocks(b, shape):
                core = signed(range_hash(sym, at, at - shape.step + 1 + shape.w, SEGMENT))
                yield pa.RecordBatch.from_arrays([*cols, core], names=[c.split()[0] for c in BLOCKS.split(", ")] + ["core"])

    return f


def lookups(docs: DataFrame, shape: Shape) -> DataFrame:
    """`_id, _k, at`: for each text the windows that start earlier too, as (s, n, id, k, t):
    n windows from word s on, first seen in document (id, k) from word t on."""
    spark = docs.sparkSession
    found = index(docs, shape)
    own = cut(with_representatives(docs, found).mapInArrow(_blocks(shape), BLOCKS + ", core long").drop("ctx"))
    discard(found.representatives)
    release(spark)
    key = ["name", "b", "core"]
    more = cut(own.groupBy(*key).count().filter("count > 1").drop("count"))
    live = cut(own.join(more, key, "left_semi").select("_id", "_k", "s", "n", "full", "wins", *key))
    discard(own, more)
    release(spark)
    inside, used = settled(live, key)
    every = as_wholes(found).unionByName(inside).filter(place() != F.col("f"))
    out = cut(every.groupBy("_id", "_k").agg(F.collect_list(F.struct("s", "n", F.col("f._id").alias("id"), F.col("f._k").alias("k"), F.col("f.s").alias("t"))).alias("at")))
    release(spark)
    discard(live, *used)
    found.drop()
    return out


# -- the parse of one document ------------------------------------------------------------------


def chains(s: np.ndarray, n: np.ndarray, ref: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lookups that go on along one reference, joined: (a, b, ref, shift), windows [a, b) match at word a + shift of ref."""
    shift = t - s
    o = np.lexsort((s, shift, ref))
    s, e, ref, shift = s[o], (s + n)[o], ref[o], shift[o]
    head = np.ones(len(s), bool)
    # within one diagonal windows are disjoint, so the end of the row before is the end so far
    head[1:] = (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1]) | (s[1:] > e[:-1])
    h = np.flatnonzero(head)
    return s[h], np.maximum.reduceat(e, h), ref[h], shift[h]


def factors(a: list[int], b: list[int], window: int) -> list[tuple[int, int, int]]:
    """The greedy parse: (chain, first word, words) of every factor and of every match across a factor's end.

    a, b: chains in order of `a`; windows [a, b) match. Words between factors are literals."""
    out: list[tuple[int, int, int]] = []
    i, k, best, end = 0, 0, -1, 0  # best: the chain seen so far that reaches furthest

    def longest(at: int) -> None:
        nonlocal k, best
        while k < len(a) and a[k] <= at:
            if best < 0 or b[k] > b[best]:
                best = k
            k += 1

    while True:
        longest(i)
        if best < 0 or b[best] <= i:
            if k == len(a):
                return out
            i = a[k]
            continue
        out.append((best, i, b[best] - i + window - 1))
        w, end = b[best], b[best] + window - 1
        while w < end:  # windows that start before the factor's end and go beyond it
            longest(w)
            if b[best] > w:
                to = min(b[best], end)
                out.append((best, w, to - w + window - 1))
                w = to
            elif k < len(a) and a[k] < end:
                w = a[k]
            else:
                break
        i = end


def digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


FACTOR = "array<struct<s: long, n: long, id: long, k: int, t: long, digest: long>>"
PARSED = f"_id long, _k int, n_words long, n_removed long, kept_sha256 string, kept_text string, factors {FACTOR}"


def _parse(window: int, texts: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("k", pa.int32()), ("t", pa.int64()), ("digest", pa.int64())]))
        for batch in batches:
            data, offs = utf8(batch.column(2))
            raw = data.tobytes()
            lists = batch.column(3)
            size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            lo = np.append(0, np.cumsum(size))
            s, n, rid, rk, t = (lists.flatten().field(x).to_numpy(zero_copy_only=False) for x in range(5))
            words, gone, sha, kept_text, found = [], [], [], [], []
            for i in range(batch.num_rows):
                own = raw[offs[i] : offs[i + 1]].split()
                own_factors = []
                if size[i]:
                    part = slice(lo[i], lo[i + 1])
                    keys = np.rec.fromarrays([rid[part], rk[part]])
                    refs, ref = np.unique(keys, return_inverse=True)
                    a, b, ref, shift = chains(s[part], n[part], ref, t[part])
                    o = np.argsort(a, kind="stable")
                    for c, at, m in factors(a[o].tolist(), b[o].tolist(), window):
                        r = refs[ref[o[c]]]
                        own_factors.append({"s": at, "n": m, "id": int(r[0]), "k": int(r[1]), "t": int(at + shift[o[c]]), "digest": digest(own[at : at + m])})
                    at, to = covered(len(own), np.array([x["s"] for x in own_factors]), np.array([x["n"] - window + 1 for x in own_factors]), window)
                    keep, pos = [], 0
                    for x, y in zip(at.tolist(), to.tolist(), strict=True):
                        keep += own[pos:x]
                        pos = y
                    keep += own[pos:]
                else:
                    keep = own
                kept = b" ".join(keep)
                words.append(len(own))
                gone.append(len(own) - len(keep))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept if texts else None)
                found.append(own_factors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(found, kind)], names=["_id", "_k", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"])

    return f


# -- words, not names ---------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words of wanted places (`at`: list of (t, n)) of each text."""
    for batch in batches:
        data, offs = utf8(batch.column(2))
        raw = data.tobytes()
        ids, ks, t, n, out = [], [], [], [], []
        for i, at in enumerate(batch.column(3).to_pylist()):
            own = raw[offs[i] : offs[i + 1]].split()
            for x in at:
                ids.append(batch.column(0)[i])
                ks.append(batch.column(1)[i])
                t.append(x["t"])
                n.append(x["n"])
                out.append(digest(own[x["t"] : x["t"] + x["n"]]))
        yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in ids], pa.int64()), pa.array([x.as_py() for x in ks], pa.int32()), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.int64())], names=["id", "k", "t", "n", "digest"])


def unlike(docs: DataFrame, parsed: DataFrame) -> int:
    """Matches whose words differ from those at their reference place."""
    used = cut(parsed.select(F.explode("factors").alias("x")).select("x.id", "x.k", "x.t", "x.n", "x.digest").distinct())
    wanted = used.select("id", "k", "t", "n").distinct().groupBy(F.col("id").alias("_id"), F.col("k").alias("_k")).agg(F.collect_list(F.struct("t", "n")).alias("at"))
    there = docs.join(wanted, ["_id", "_k"]).select("_id", "_k", "text", "at").mapInArrow(lean(_digests), "id long, k int, t long, n long, digest long")
    n = used.join(there, ["id", "k", "t", "n", "digest"], "left_anti").count()
    discard(used)
    release(docs.sparkSession)
    return n


def parsed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """The parse of whole documents (`doc_id`, `text`), a row each: PARSED.

    `factors`: words [s, s + n) are words [t, t + n) of the earlier document, or earlier place, (id, k)."""
    own = keyed(docs, "doc_id", "text")
    for salt in range(TRIES):
        found = lookups(own, Shape(window, anchor, STEP, True, salt))
        out = cut(own.join(found, ["_id", "_k"], "left").select("_id", "_k", "text", "at").mapInArrow(lean(_parse(window, texts)), PARSED))
        release(docs.sparkSession)
        discard(found)
        if not unlike(own, out):
            return out
        discard(out)
    raise RuntimeError(f"names collided under {TRIES} salts")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256, kept_text`: the text without the
    words under a duplicate span, kept words joined by one space (null unless `texts`).

    Null, empty and blank texts have no words. Very long texts are read in segments, none is cut.
    Ties and repeated rows: rows of one id are documents of their own, ordered by text; the
    later of two equal ones is a copy. An empty table gives no rows; other columns are
    ignored, whatever they are called."""
    return parsed(docs, window, anchor, texts).select(doc_id(), "n_words", "n_removed", "kept_sha256", "kept_text")


#: The same by comparing every window of 20 words with all others.
SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
 dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM dup), words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`remove_repeats` over all of `documents`; odd input as there."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept_text")
