"""Fingerprints, substring and byte dedup, SimHash, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from complyspark.llm import common, fingerprints, simhash, substring_dedup, suffix_dedup, windows


def order(rows):
    """Rows in the operators' order: id (null first), then text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_words_removed(messy, messy_docs):
    seen, want = set(), []
    for i, t in order(messy):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = " ".join(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r)[:4] for r in substring_dedup.remove_repeats(messy_docs).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 400


def test_factors_are_true_and_greedy(messy, messy_docs):
    """Each factor equals an earlier place, word by word, and none could have gone on along its reference."""
    text = {}
    for i, t in order(messy):
        text[i, sum(1 for a, _ in text if a == i)] = (t or "").split()
    rows = substring_dedup.parsed(messy_docs).collect()
    n = 0
    for r in rows:
        own = text[None if r._id == common.NULL_ID else r._id, r._k]
        end = 0
        for x in r.factors:
            there = text[None if x.id == common.NULL_ID else x.id, x.k]
            assert x.n >= 20 and own[x.s : x.s + x.n] == there[x.t : x.t + x.n] and (x.id, x.k, x.t) < (r._id, r._k, x.s)
            if x.s >= end:  # a factor, not a match across the end of the one before
                end = x.s + x.n
                n += 1
    assert n >= 5
    assert substring_dedup.unlike(common.keyed(messy_docs, "doc_id", "text"), substring_dedup.parsed(messy_docs)) == 0
    false = substring_dedup.parsed(messy_docs).selectExpr("_id", "_k", "transform(factors, x -> struct(x.s, x.n, x.id, x.k, x.t, x.digest + 1 AS digest)) AS factors")
    assert substring_dedup.unlike(common.keyed(messy_docs, "doc_id", "text"), false) > 0


def test_greedy_parse_covers_every_match():
    rng = np.random.default_rng(8)
    for _ in range(300):
        m = int(rng.integers(0, 9))
        a = np.sort(rng.integers(0, 60, m))
        b = a + rng.integers(1, 25, m)
        windows_of = {w for x, y in zip(a, b, strict=True) for w in range(x, y)}
        got = substring_dedup.factors(a.tolist(), b.tolist(), 5)
        assert {w for _, s, n in got for w in range(s, s + n - 4)} == windows_of
        assert all(a[c] <= s and s + n - 4 <= b[c] for c, s, n in got)
        if got:  # the first factor is the longest of the matches there
            assert got[0][2] - 4 == max(b[a <= got[0][1]]) - got[0][1]


def test_chains_join_lookups_along_one_reference():
    s, n, ref, t = (np.array(x) for x in ([0, 3, 5, 5, 9], [3, 2, 4, 1, 1], [0, 0, 0, 1, 0], [10, 13, 15, 2, 30]))
    assert sorted(zip(*(x.tolist() for x in substring_dedup.chains(s, n, ref, t)), strict=True)) == [(0, 9, 0, 10), (5, 6, 1, -3), (9, 10, 0, 21)]


def test_doubling_against_sorted_prefixes(spark):
    """Rounds of sorted pairs keep the positions whose prefix occurs again, and no others."""
    shape = windows.Shape(200, 64, 16, False)
    assert suffix_dedup.offsets(shape) == [64, 48]
    rng = np.random.default_rng(9)
    rows = []
    for run in range(60):
        sym = rng.integers(0, 2, 14)
        rows += [(7, run, -b, int(sym[b]), int(sym[b + 4])) for b in range(10)]
    want = Counter()
    at = {(r[1], r[2]): r for r in rows}
    full = {(run, b): (b, at[run, b][3:], at[run, b - 3][3:]) for run, b in at if (run, b - 3) in at}
    want.update(full.values())
    grid = spark.createDataFrame(rows, "name long, ctx long, b int, r1 long, r2 long")
    got = suffix_dedup.doubled(grid, shape).collect()
    assert {(r.ctx, r.b) for r in got} == {k for k, v in full.items() if want[v] > 1}
    rank = {}
    for r in got:
        assert rank.setdefault(r["rank"], full[r.ctx, r.b]) == full[r.ctx, r.b]
    assert len(rank) == len(set(rank.values()))


def test_bytes_removed(messy, messy_docs):
    n = 200
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t in order(messy)]
    for _, b in texts:
        count.update(hash(b[s : s + n]) for s in range(len(b) - n + 1))
    want = []
    for i, b in texts:
        gone, end = bytearray(len(b)), 0
        for s in range(len(b) - n + 1):
            if count[hash(b[s : s + n])] > 1:
                a = max(s, end)
                gone[a : s + n] = b"\1" * (s + n - a)
                end = s + n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeated_bytes(messy_docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in got) > 5000


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(5)
    for words in (True, False):
        shape = windows.Shape(20, 5, 4, words)
        sym = common.mix(rng.integers(0, 3, 5000).astype(np.uint64) + np.uint64(1))
        first = np.array([0, 10, 700, 701, 5000])
        row, _, _, s1, n, a = windows.runs(sym, first, shape)
        spots = sorted((r, s) for r, b, m in zip(row, s1, n, strict=True) for s in range(b, b + m))
        assert spots == [(r, s) for r in range(4) for s in range(first[r + 1] - first[r] - 19)]
        assert (a <= 15).all() and (a - n + 1 >= 0).all()


def test_windows_over_segments(monkeypatch, messy):
    """Runs and hashes of windows don't depend on the length of a segment."""
    text = " ".join(messy[12][1].split()[:300])
    shape = windows.Shape(20, 5, 4, True)
    sym, first = shape.symbols(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    s = np.arange(281)
    whole = windows.range_hash(sym, s, s + 20, windows.SEGMENT)
    assert (whole == windows.range_hash(sym, s, s + 20, 64)).all()
    monkeypatch.setattr(windows, "SEGMENT", 64)
    _, _, _, s1, n, _ = windows.runs(sym, first, shape)
    assert sorted(x for b, m in zip(s1, n, strict=True) for x in range(b, b + m)) == s.tolist()


def test_empty_tables(spark, make_docs):
    none = make_docs([(1, "x")]).filter("doc_id < 0")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert simhash.groups(none).count() == 0
    assert fingerprints.with_next(none, fingerprints.MinHash()).count() == 0


def test_simhash(messy, messy_docs):
    def mark(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[a : a + 3]).encode(), 42) for a in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.groups(messy_docs).collect()
    assert sorted((r._id, r.fp & (2**64 - 1)) for r in got) == sorted((common.NULL_ID if i is None else i, mark(t)) for i, t in messy)


def test_simhash_components(messy, messy_docs, make_docs):
    """The whole query against all pairs, null ids and texts included."""
    near = [(100 + k, " ".join(["alpha beta gamma delta epsilon zeta eta theta"] * 30 + [f"tail{k}"])) for k in range(12)]
    rows = [*messy, *near, (None, None), (None, near[0][1])]
    docs = make_docs(rows)
    got = simhash.digest(docs).collect()
    marks = {(r.doc_id, r.fingerprint) for r in got}
    codes = sorted({int(f, 16) for _, f in marks})
    comp = {c: c for c in codes}
    for _ in codes:
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for i, f in marks:
        c = comp[int(f, 16)]
        least[c] = min(least.get(c, 2**63), common.NULL_ID if i is None else i)
    want = sorted(str((r.doc_id, r.fingerprint, None if least[comp[int(r.fingerprint, 16)]] == common.NULL_ID else least[comp[int(r.fingerprint, 16)]])) for r in got)
    assert sorted(str(tuple(r)) for r in got) == want and len(got) == len(rows)
    assert any(r.component_id is None for r in got) and len({r.component_id for r in got}) > 3


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    every = set(base)
    for b in base:
        for _ in range(12):
            x = b & (2**64 - 1)
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            every.add(signed(x))
    every = sorted(every)
    u = np.array(every, np.int64).view(np.uint64)
    want = {frozenset((every[i], every[j])) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3) if i < j}
    found = simhash.links(spark.createDataFrame([(x,) for x in every], "fp long")).collect()
    assert len(found) == len(want) and {frozenset(r) for r in found} == want


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (700, 2))] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5001 + i) for i in range(400)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    got = {r.node: r.component for r in common.components(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_one_of_each(messy_docs, messy):
    out = simhash.one_of_each(messy_docs)
    assert out.columns == messy_docs.columns
    ids = sorted(r.doc_id for r in out.filter("doc_id is not null").select("doc_id").collect())
    assert 6 in ids and 7 not in ids and 8 not in ids
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 not in ids


@pytest.mark.parametrize("size", [1 << 25, 3000])
def test_fingerprints(monkeypatch, messy, messy_docs, size):
    monkeypatch.setattr(fingerprints, "SLICE_BYTES", size)
    hasher = fingerprints.MinHash()
    rows = order(messy)[::-1]
    want = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e, b = hasher.of([t.encode(), edited.encode(), nxt.encode()])
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), e.hex(), hasher.likeness(a, e), hasher.likeness(a, b)))
    got = [tuple(r) for r in fingerprints.with_next(messy_docs, hasher).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(messy_docs).collect()}
    assert {(i, f) for i, _, _, f, *_ in want} == plain


def test_likeness_estimates_jaccard():
    hasher = fingerprints.MinHash()
    rng = np.random.default_rng(6)
    err = []
    for n, share in ((6, 0.5), (40, 0.8), (500, 0.5), (3000, 0.2), (3000, 0.9)):
        for _ in range(10):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            b[int(n * share) :] = rng.integers(0, 2**63, n - int(n * share)).astype(np.uint64)
            true = len(set(a) & set(b)) / len(set(a) | set(b))
            err.append(hasher.likeness(hasher.pack(a), hasher.pack(b)) - true)
    assert np.abs(err).max() < 0.12 and abs(np.mean(err)) < 0.02
    assert hasher.likeness(b"", b"") == 1 and hasher.likeness(b"", hasher.pack(a)) == 0
