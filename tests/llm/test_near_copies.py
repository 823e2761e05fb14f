"""Near copies of the pipeline's stage against all pairs."""

import re

import numpy as np
import pyarrow as pa
from conftest import words

import corpus_pipeline
from complyspark.llm import common, near_copies


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """The least id of every document's group."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = [common.NULL_ID if i is None else i for i, _ in rows]
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {(i, least[find(k)]) for k, i in enumerate(ids)}


def corpus():
    rng = np.random.default_rng(9)
    texts = []
    line = words(77, 30)
    for b in range(40):
        base = words(100 + b, int(rng.integers(6, 300)), 3000) + (line if b % 2 else [])
        texts.append(base)
        for _ in range(7):
            copy = list(texts[-1] if b % 3 == 0 else base)
            for at in rng.integers(0, len(copy), max(1, int(len(copy) * rng.uniform(0, 0.035)))):
                copy[at] = f"new{rng.integers(10**9)}"
            texts.append(copy[: int(len(copy) * rng.uniform(0.85, 1))] if b % 4 == 1 else copy)
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[i])) for i in order] + [(900, None), (901, " "), (902, "One  TWO"), (903, "one two"), (904, "one two three")]


def test_groups_against_all_pairs(make_docs):
    rows = corpus()
    sets = [shingles(t) for _, t in rows if t and t.strip()]
    likeness = [len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k]]
    assert sum(0.8 <= x < 0.95 for x in likeness) > 100 and sum(0.6 < x < 0.8 for x in likeness) > 50
    got = near_copies.groups(make_docs(rows)).collect()
    least = {}
    for r in got:
        least[r.comp] = min(r._id, least.get(r.comp, r._id))
    assert {(r._id, least[r.comp]) for r in got} == brute(rows)


def test_pairs_that_the_pivot_does_not_tie(make_docs, monkeypatch):
    """One shingle that comes first in the order of all sets: most are unlike its pivot, some like each other."""
    shared = next(near_copies.shingle_sets(pa.array(["rare five words in all"])))
    monkeypatch.setattr(near_copies, "frequent", lambda docs: (shared, np.array([-1], np.int32)))
    rows = []
    for g in range(12):
        base = words(300 + g, 24)
        for k in range(3):
            rows.append((10 * g + k, " ".join(["rare", "five", "words", "in", "all", *base[: 24 - k]])))
    got = near_copies.groups(make_docs(rows)).collect()
    assert len({r.comp for r in got}) == 12
    assert {(r._id, r._id // 10 * 10) for r in got} == brute(rows)


def test_messy_rows(make_docs, messy):
    docs = make_docs(messy)
    out = near_copies.one_of_each(docs)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert {1, 4, 6, None} <= ids and not ids & {2, 3, 5, 7, 8}
    assert near_copies.groups(docs.filter("doc_id < 0")).count() == 0


def test_the_stage_takes_five_words_and_four_fifths(spark, make_docs):
    base = words(8, 200)
    near = list(base)
    for at in (20, 90, 160):
        near[at] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(words(9, 200)))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.9
    assert {r.doc_id for r in corpus_pipeline.simhash_stage(spark, make_docs(rows), "").collect()} == {1, 3}


def test_sketches_rule_out_no_near_pair():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 600):
        for share in (0.75, 0.8, 0.85, 0.95):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.append(a[: int(len(a) * share)], rng.integers(0, 2**63, max(0, n - int(n * share))).astype(np.uint64)))
            p, q = (near_copies.unpacked(pa.scalar(near_copies.packed(x), pa.binary())) for x in (a, b))
            assert len(p) == len(a) and (p == np.sort(a >> np.uint64(24))).all()
            both = len(np.intersect1d(p, q))
            counts = [np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256)[None] for x in (p, q)]
            if 5 * both >= 4 * (len(p) + len(q) - both):
                assert near_copies.may_be_near(*counts).all()
    far = [np.bincount((rng.integers(0, 2**63, 600) & 255), minlength=256)[None] for _ in range(2)]
    assert not near_copies.may_be_near(*far).any()


def prints_of(spark, sets):
    rows = [(k, len(c), near_copies.simhash(c)) for k, c in enumerate(sets)]
    return common.cut(spark.createDataFrame(rows, "sid long, n int, fp binary"))


def test_simhash_tables_tie_what_is_near(spark):
    """The tables alone, without the exact search behind them: at least 0.9 of the near pairs meet in groups, and a fingerprint's bits are majorities."""
    texts = sorted({t for _, t in corpus() if t and len(t.split()) > 9})
    sets = list(near_copies.shingle_sets(pa.array(texts)))
    one = sets[0]
    bits = np.array([[(int(common.mix(np.array([c ^ s]))[0]) >> k) & 1 for s in near_copies.SALTS for k in range(64)] for c in one])
    assert np.unpackbits(np.frombuffer(near_copies.simhash(one), np.uint8), bitorder="little").tolist() == (2 * bits.sum(0) > len(one)).astype(int).tolist()
    assert len({tuple(x) for x in np.sort(near_copies.TABLES, 1).tolist()}) == len(near_copies.TABLES)
    pairs = near_copies.alike(prints_of(spark, sets)).collect()
    exact = [shingles(t) for t in texts]
    near = lambda a, b: 5 * len(exact[a] & exact[b]) >= 4 * len(exact[a] | exact[b])
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for p in pairs:
        assert p.d <= near_copies.DISTANCE
        if near(p.src, p.dst):
            group[max(find(p.src), find(p.dst))] = min(find(p.src), find(p.dst))
    want = [(a, b) for b in range(len(texts)) for a in range(b) if near(a, b)]
    assert len(want) > 200 and sum(find(a) == find(b) for a, b in want) >= 0.9 * len(want)


def test_a_large_group_is_not_compared_by_all_pairs(make_docs, monkeypatch):
    """Copies of one text that are near to it more than to each other: pairs that remain grow with the group, not with its square."""
    rng = np.random.default_rng(4)
    base = words(12, 150)
    rows = [(0, " ".join(base))]
    for k in range(1, 401):
        copy = list(base)
        for at in rng.choice(140, 2 + k % 2, replace=False):
            copy[at + 5] = f"new{k}x{at}"
        rows.append((k, " ".join(copy)))
    seen = []
    real = near_copies._possible
    monkeypatch.setattr(near_copies, "_possible", lambda pairs, sets: (seen.append(pairs.count()), real(pairs, sets))[1])
    got = near_copies.groups(make_docs(rows)).collect()
    least = {}
    for r in got:
        least[r.comp] = min(r._id, least.get(r.comp, r._id))
    assert {(r._id, least[r.comp]) for r in got} == brute(rows)
    assert sum(seen) <= 10 * len(rows), seen


def test_comparing_moves_the_sets_of_pairs_alone(spark, make_docs, monkeypatch):
    """Sets lie in buckets: a round of comparisons moves its pairs and one set of each, never the table of all sets; tables go at the end."""
    monkeypatch.setattr(near_copies, "PARTS", 2)
    moved, real = [], near_copies._in_rounds

    def spied(spark, met):
        moved.extend(met(k)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for k in range(2))
        return real(spark, met)

    monkeypatch.setattr(near_copies, "_in_rounds", spied)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus()[::3]
        got = near_copies.groups(make_docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    least = {}
    for r in got:
        least[r.comp] = min(r._id, least.get(r.comp, r._id))
    assert {(r._id, least[r.comp]) for r in got} == brute(rows)
    assert len(moved) == 8 and max(moved) == 2, moved
    assert not [t for t in spark.catalog.listTables("default") if t.name.startswith("cut_")]


def test_small_tables_take_few_rounds(spark, make_docs, monkeypatch):
    """The driver keeps the plans of all queries: a small table has one round of each kind and a bounded number of queries, and all
    rounds give the same groups."""
    rows, tables, real = corpus()[::3], [], near_copies.cut_parts

    def spied(session, parts, *by):
        tables.append(0)

        def counted():
            for part in parts:
                tables[-1] += 1
                yield part

        return real(session, counted(), *by)

    monkeypatch.setattr(near_copies, "cut_parts", spied)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().last().executionId()
    few = {(r._id, r.comp) for r in near_copies.groups(make_docs(rows)).collect()}
    assert tables == [1] * 7 and store.executionsList().last().executionId() - before < 80
    tables.clear()
    monkeypatch.setattr(near_copies, "FULL", 1)
    assert {(r._id, r.comp) for r in near_copies.groups(make_docs(rows)).collect()} == few
    assert sorted(tables) == [near_copies.PARTS] * 6 + [near_copies.READS]


def test_rounds_follow_the_size():
    assert [near_copies.rounds(near_copies.PARTS, n) for n in (0, 1, near_copies.FULL // 4, near_copies.FULL // 4 + 1, near_copies.FULL, 99 * near_copies.FULL)] == [1, 1, 1, 2, 4, 4]
