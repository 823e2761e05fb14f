"""Document fingerprints by one-permutation MinHash.

The hashes of a text's shingles are dealt to bins once by their leading bits and
each bin keeps the least. Empty bins borrow from full ones by optimal
densification: bin i asks the bins h(i, 1), h(i, 2), ... until one is full. Of
every bin only the low `BITS` bits are kept and packed; likeness takes out the
share of bins that agree by chance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunks, doc_id, keyed, mix, utf8, word_bounds, word_hashes

SHINGLE, BINS, BITS = 5, 512, 4
_TRIES = 4096


class MinHash:
    """shingle: words; bins: a power of two; bits: kept of each bin, 4 or 8."""

    def __init__(self, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or bits not in (4, 8):
            raise ValueError("bins is a power of two, bits 4 or 8")
        self.shingle, self.bins, self.bits = shingle, bins, bits
        self.shift = U64(64 - bins.bit_length() + 1)
        self.asks: list[np.ndarray] = []
        self.salt = np.arange(bins, dtype=U64) * U64(0x9E3779B97F4A7C15)

    def _asked(self, k: int) -> np.ndarray:
        """The bins that bins 0, 1, ... ask at attempt k."""
        while len(self.asks) <= k:
            n = np.full(1, len(self.asks) + 1, U64) * U64(0x9E3779B97F4A7C15)
            self.asks.append((mix(np.arange(self.bins, dtype=U64) * U64(0xC2B2AE3D27D4EB4F) + n) % U64(self.bins)).astype(np.int64))
        return self.asks[k]

    def _dense(self, value: np.ndarray, full: np.ndarray) -> np.ndarray:
        empty = np.flatnonzero(~full)
        for k in range(_TRIES):
            if not len(empty):
                return value
            ask = self._asked(k)[empty]
            hit = full[ask]
            value[empty[hit]] = value[ask[hit]]
            empty = empty[~hit]
        donors = np.flatnonzero(full)
        value[empty] = value[donors[empty % len(donors)]]
        return value

    def pack(self, hashes: np.ndarray) -> bytes:
        """The fingerprint of a set of shingle hashes; without any it is empty."""
        if not len(hashes):
            return b""
        h = np.sort(hashes)
        at = (h >> self.shift).astype(np.int64)
        head = np.ones(len(h), bool)
        head[1:] = at[1:] != at[:-1]
        value = np.zeros(self.bins, U64)
        full = np.zeros(self.bins, bool)
        value[at[head]] = h[head]
        full[at[head]] = True
        # bits of (shingle, bin): of few shingles, two that agree by chance do so in some bins only
        low = (mix(self._dense(value, full) + self.salt) & U64((1 << self.bits) - 1)).astype(np.uint8)
        return (low[::2] << 4 | low[1::2]).tobytes() if self.bits == 4 else low.tobytes()

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Fingerprints of UTF-8 texts. Texts shorter than a shingle are one shingle."""
        out: list[bytes] = []
        offs = np.append(0, np.cumsum([len(t) for t in texts]))
        for i, j in chunks(offs):
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            starts, ends, first = word_bounds(data, offs[i : j + 1] - offs[i])
            words = word_hashes(data, starts, ends)
            n = self.shingle
            roll = np.zeros(max(0, len(words) - n + 1), U64)
            for k in range(n):
                roll = roll * U64(0x9FB21C651E98DF25) + words[k : k + len(roll)]
            roll = mix(roll)
            for r in range(j - i):
                a, b = int(first[r]), int(first[r + 1])
                if b - a >= n:
                    out.append(self.pack(roll[a : b - n + 1]))
                else:
                    short = np.zeros(1, U64)
                    for w in words[a:b]:
                        short = short * U64(0x9FB21C651E98DF25) + w
                    out.append(self.pack(mix(short + U64(b - a)) if b > a else short[:0]))
        return out

    def likeness(self, x: bytes, y: bytes) -> float:
        """The estimated share of common shingles, 0 to 1, without bins that agree by chance."""
        if not x or not y:
            return float(x == y)
        d = np.bitwise_xor(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
        same = int(np.count_nonzero(d == 0)) if self.bits == 8 else int(np.count_nonzero(d & 15 == 0) + np.count_nonzero(d >> 4 == 0))
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, (same / self.bins - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """`doc_id, fingerprint` (hex) of every whole text of `docs` (`doc_id`, `text`).

    Null texts are empty, whose fingerprint is the empty string; very long texts are read whole; equal texts
    have equal fingerprints; repeated rows and null ids give a row each; other columns are ignored; an empty table gives no rows."""
    hasher = MinHash(shingle, bins, bits)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            raw = data.tobytes()
            found = hasher.of([raw[offs[i] : offs[i + 1]] for i in range(b.num_rows)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.hex() for x in found])], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(f, "doc_id long, fingerprint string")


# -- each document against its edited text and the next document -------------------------------


SLICE_BYTES = 32 << 20
"""Text of a slice, about: a slice is a task."""
SLICES = 20_000
"""Slices at most, as their bounds are found in one aggregate; beyond 640 GB of text slices grow, and a task's sort spills."""


def _slices(rows: DataFrame) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Bounds of slices of ascending ids, each of about SLICE_BYTES of text, and each non-empty slice's
    (number, greatest _id, greatest _k): a few numbers a slice reach the driver."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wanted = min(SLICES, max(1, -(-size // SLICE_BYTES)))
    rows = rows.select("_id", "_k")
    marks = [i / wanted for i in range(1, wanted)]
    found = (rows.agg(F.percentile_approx("_id", marks, 20 * wanted).alias("q")).first()["q"] or []) if marks else []
    bounds = sorted(set(found))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ids, "right").astype(np.int64)), b.column(0), b.column(1)], names=["slice", "_id", "_k"])

    tops = rows.mapInArrow(f, "slice long, _id long, _k int").groupBy("slice").agg(F.max(F.struct("_id", "_k")).alias("m")).select("slice", "m.*").collect()
    return bounds, sorted((r["slice"], r["_id"], r["_k"]) for r in tops)


def with_next(docs: DataFrame, hasher: MinHash) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next` of `docs` (`doc_id`, `text`), next in descending order of ids (rows
    that repeat an id: of their texts), after the last the first.

    Ids are dealt to slices by bounds found beforehand; each slice also gets the
    greatest row of the slice below, so a text is shuffled once, and is read in
    order from a sorted slice with one row held back.

    Null texts are empty, and so are fingerprints of texts without words; very long texts are read whole. A single row is
    its own next. Ties and repeated rows: equal ids follow in descending order of their texts; a null id
    is the smallest. Other columns are ignored, whatever they are called; an empty table gives no rows."""
    rows = keyed(docs, "doc_id", "text")
    bounds, tops = _slices(rows)
    numbers = [t[0] for t in tops]
    # the top row of a slice goes to the slice above too; the top of all to the lowest
    above = {(i, k): numbers[(j + 1) % len(numbers)] for j, (_, i, k) in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slice", "guest", "_id", "_k", "text"]
        for b in batches:
            ids, ks = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, ids, "right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(ids), bool)), b.column(0), b.column(1), b.column(2)], names=names)
            extra = [i for i, x in enumerate(zip(ids.tolist(), ks.tolist(), strict=True)) if x in above]
            if extra:
                sub = b.take(pa.array(extra))
                to = [above[int(ids[i]), int(ks[i])] for i in extra]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([True] * len(to)), sub.column(0), sub.column(1), sub.column(2)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, bool, int, str, bytes] | None = None
        for b in batches:
            text = b.column(4).to_pylist()
            where, guest, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo in range(0, len(text), 256):
                own = [t or "" for t in text[lo : lo + 256]]
                prints = hasher.of([t.encode() for t in own])
                out: list[tuple] = []
                edits: list[bytes] = []
                for i, (t, p) in enumerate(zip(own, prints, strict=True)):
                    row = (where[lo + i], guest[lo + i], ids[lo + i], t, p)
                    if held and held[0] == row[0] and not held[1]:
                        half = len(held[3]) // 2
                        edits.append((held[3][: len(held[3]) - half] + t[:half]).encode())
                        out.append((held[2], len(held[3]), held[4], p))
                    held = row
                found = hasher.of(edits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in out], pa.int64()),
                        pa.array([r[1] for r in out], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                        pa.array([r[2].hex() for r in out], pa.string()),
                        pa.array([e.hex() for e in found], pa.string()),
                        pa.array([hasher.likeness(r[2], e) for r, e in zip(out, found, strict=True)], pa.float64()),
                        pa.array([hasher.likeness(r[2], r[3]) for r in out], pa.float64()),
                    ],
                    names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    dealt = rows.mapInArrow(deal, "slice long, guest boolean, _id long, _k int, text string")
    order = [F.col("slice"), F.col("guest"), F.col("_id").desc(), F.col("_k").desc()]
    kept = dealt.repartitionById(len(bounds) + 1, F.col("slice").cast("int")).sortWithinPartitions(*order)
    out = kept.mapInArrow(compare, "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(doc_id(), *[c for c in out.columns if c != "_id"])


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`with_next` over all of `documents`; odd input as there."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), MinHash())


