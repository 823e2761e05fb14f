"""Quality scores: random Fourier features of document statistics, ridge regression
from partition-summed normal equations, isotonic calibration.

The statistics are of a whole text alone: lengths, repetition of words and
lines, character classes, compressibility. Standardised, they are mapped to
cos(w x + b), which approximates a Gaussian kernel; every partition adds up its
Z'Z and Z'y, and one small system is solved on the driver."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean_batches, release
from .labelled import fold, isotonic, labelled, sample

FOLDS, HELD = 5, 0
FEATURES, WIDTH, RIDGE = 192, 4.0, 1.0
THRESHOLD = 0.3

_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~/"]] = True
_PUNCT = np.zeros(128, bool)
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; an empty one has finite values too."""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return [0.0] * 20
    count = Counter(words)
    top = count.most_common(1)[0][1]
    size = np.fromiter(map(len, words), np.int64, m)
    lines = text.split("\n")
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    hist = np.bincount(b, minlength=256).astype(np.float64)
    ascii_hist = hist[:128]
    p = hist[hist > 0] / len(b)
    letters = ascii_hist[65:91].sum() + ascii_hist[97:123].sum() + 1
    adjacent = sum(map(str.__eq__, words[1:], words))
    packed = sum(len(zlib.compress(raw[i : i + 65536], 1)) for i in range(0, len(raw), 65536))
    return [
        np.log1p(m),
        np.log1p(n / m),
        float(np.log1p(size.std())),
        len(count) / m,
        len(count) / np.sqrt(m),
        top / m,
        adjacent / m,
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)),
        ascii_hist[_SYMBOL].sum() / n,
        ascii_hist[_PUNCT].sum() / n,
        ascii_hist[33] / n * 10,
        ascii_hist[124] / n * 10,
        ascii_hist[48:58].sum() / n,
        ascii_hist[65:91].sum() / letters,
        hist[128:].sum() / len(b),
        float(-(p * np.log2(p)).sum()),
        packed / len(b),
        float((size == 1).mean()),
        float((size > 14).mean()),
    ]


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    w: np.ndarray
    b: np.ndarray
    coef: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lift(x, self.mean, self.std, self.w, self.b) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def lift(x: np.ndarray, mean: np.ndarray, std: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / std, -6, 6)
    return np.hstack([np.sqrt(2 / len(b)) * np.cos(z @ w + b), np.ones((len(x), 1))])


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        x = [statistics(s or "") for s in t.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([t.column(0), pa.array(x, pa.list_(pa.float64())), t.column(2)], names=["doc_id", "x", "y"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = FOLDS, held: int = HELD, features: int = FEATURES, seed: int = 7) -> Model:
    """Fitted on a bounded sample of labelled rows outside the held-out fold (see
    labelled.py). Three quarters of it give the normal equations, the rest the calibration.

    Null and empty texts have the statistics of the empty text; very long texts are read whole. Null
    labels and labels of a null id are left out; of several labels of a document the greatest holds; rows of `docs` that
    repeat an id are read once each. Without any labelled row (an empty table too) every score is one half. Other columns are ignored."""
    lean_batches(docs.sparkSession)
    rows = cut(labelled(docs, sample(labels, label, mod, held)).select("doc_id", "text", "y").mapInArrow(_stats_rows, "doc_id long, x array<double>, y int"))
    part = rows.withColumn("cal", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0)
    size = len(statistics(""))
    moments = part.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, std = np.zeros(size), np.ones(size)
    for r in moments:
        mean[r["i"]], std[r["i"]] = r["m"], max(r["s"], 1e-6)
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((size, features)) / WIDTH, rng.uniform(0, 2 * np.pi, features)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for t in batches:
            x = np.array(t.column(0).to_pylist(), np.float64).reshape(-1, size)
            z = lift(x, mean, std, w, b)
            zy = np.hstack([z, t.column(1).to_numpy().astype(np.float64)[:, None]])
            total = z.T @ zy if total is None else total + z.T @ zy
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    got = part.filter("not cal").select("x", "y").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    d = features + 1
    coef = np.zeros(d)
    if got.num_rows:
        flat = np.zeros(d * (d + 1))
        flat[got.column("i").to_numpy()] = got.column("v").to_numpy()
        m = flat.reshape(d, d + 1)
        coef = np.linalg.solve(m[:, :d] + RIDGE * np.eye(d), m[:, d])
    model = Model(mean, std, w, b, coef, (np.array([0.0]), np.array([0.5])))
    cal = part.filter("cal").select("x", "y").toArrow()
    if cal.num_rows:
        model.knots = isotonic(model.raw(np.array(cal.column("x").to_pylist(), np.float64)), cal.column("y").to_numpy().astype(np.float64))
    release(docs.sparkSession)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score` of every whole text of `docs`. Null texts count as empty; very long ones are read whole; ties get
    equal scores; repeated rows and null ids give a row each; other columns are ignored; an empty table gives no rows."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            text = t.column(1).to_pylist()
            for lo in range(0, len(text), 512):
                x = np.array([statistics(s or "") for s in text[lo : lo + 512]], np.float64)
                yield pa.RecordBatch.from_arrays([t.column(0).slice(lo, 512), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(f, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of `documents`, learnt from `labels`; odd input as in `fit` and `scored`. A null id is in the
    held-out fold, as the checksum of no text is 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (fold(FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
