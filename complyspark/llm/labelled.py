"""Bounded, repeatable samples of labelled documents, and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
"""Labelled rows that a classifier is fitted on, at most: those with the least hash of their id."""


def fold(mod: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


def sample(labels: DataFrame, label: str, mod: int, held: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """`doc_id, y` of at most `rows` labelled documents outside the held-out fold; a
    bounded table, so it may be broadcast. Null labels and ids are left out,
    of several labels of one document the greatest holds."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(fold(mod) != held)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return own.orderBy(F.xxhash64("doc_id", F.lit(mod)), "doc_id").limit(rows)


def labelled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """`doc_id, text, y` of the chosen documents; the side that is broadcast has SAMPLE_ROWS rows at most."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing fit with least squares (pool adjacent violators)."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    means: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        means.append([v, 1.0, s, s])
        while len(means) > 1 and (means[-2][0] >= means[-1][0] or means[-2][3] == means[-1][2]):
            b = means.pop()
            a = means[-1]
            n = a[1] + b[1]
            means[-1] = [(a[0] * a[1] + b[0] * b[1]) / n, n, a[2], b[3]]
    xs = np.array([x for m in means for x in (m[2], m[3])])
    # a pool's share is drawn a little towards one half, by one document of each kind
    ps = np.array([(m[0] * m[1] + 0.5) / (m[1] + 1) for m in means for _ in range(2)])
    keep = np.append(True, np.diff(xs) > 0)
    return xs[keep], np.maximum.accumulate(ps[keep])
