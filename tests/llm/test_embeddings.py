"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from complyspark.llm import embeddings


def brute(rows, cosine):
    n = len(rows)
    link = np.zeros((n, n), bool)
    ok = [v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = link[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine
    comp = np.arange(n)
    for _ in range(n):
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    ids = [r[0] for r in rows]
    return sorted((ids[i], int(link[i].sum()), min(ids[k] for k in range(n) if comp[k] == comp[i])) for i in range(n))


@pytest.mark.parametrize("probes", [512, 3])
def test_links(spark, monkeypatch, probes):
    """With few probes allowed nearly all vectors take the exact way of blocks."""
    monkeypatch.setattr(embeddings.Codes.probes, "__defaults__", (probes,))
    monkeypatch.setattr(embeddings, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 24))
    rows, k = [], 0
    for b in base:
        for _ in range(5):
            v = b + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.19, 0.25])
            rows.append((k, [float(np.float32(x)) for x in v], int(k % 7 == 0)))
            k += 1
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, rows[0][1], None), (504, rows[1][1], 0), (505, [1.0, 2.0], 0), (506, [1.0] + [None] * 23, 0), (507, [2 * x for x in rows[1][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS links")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == brute(rows, 0.98)
    assert sum(r[1] for r in got) > 50


@pytest.mark.parametrize("lengths", [64, 1])
def test_lengths_labels_and_ids(spark, monkeypatch, lengths):
    """Vectors of any length link with their like, with or without a rotation of their own; labels may be texts, ids repeat or be null."""
    monkeypatch.setattr(embeddings, "LENGTHS", lengths)
    rows = [(i, [1.0, 0.1 * (i % 3), 0.5], "x") for i in range(9)] + [(20, [1.0, 2.0], "x"), (21, [2.0, 4.0], "x"), (22, [1.0, 2.0], "y"), (23, [1.0], "x"), (24, [3.0], "x"), (24, [1.0, 2.0], "x"), (None, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()), key=str)
    low = -(2**63)
    want = [tuple(None if k != 1 and x == low else x for k, x in enumerate(r)) for r in brute([(low if i is None else i, v, lab) for i, v, lab in rows], 0.98)]
    assert got == sorted(want, key=str)
    assert (20, 3, None) in got and (23, 1, 23) in got


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    one = embeddings.near_duplicates(spark.createDataFrame([(None, None, None)], "vec_id long, embedding array<float>, label int")).first()
    assert one.n_links == 0
