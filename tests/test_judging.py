"""Passages for many dossiers, validity by spans of days, the judging flow and the vector index, against plain Python."""

import datetime as dt
import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plans import plan

from complyspark.operators import judging, vector_index
from complyspark.operators import retrieval as R
from complyspark.plans import flow
from complyspark.plans import retrieval as Q
from complyspark.sources import models


def guaranteed(hits, g, cap):
    """The rule as it reads: the first g of each field, then others by distance up to the cap; ranks of kept texts go on."""
    key = lambda h: h["text"].strip() or str(h["chunk_id"])
    chosen = {}

    def add(h):
        c = chosen.setdefault(key(h), {"distance": h["distance"], "ranks": {}})
        c["distance"] = min(c["distance"], h["distance"])
        c["ranks"][h["field_key"]] = min(h["i"], c["ranks"].get(h["field_key"], 99))

    hits = sorted(hits, key=lambda h: (h["field_ord"], h["i"]))
    for h in hits:
        if h["i"] < g:
            add(h)
    must = set(chosen)
    room = max(cap, len(chosen))
    for h in sorted((h for h in hits if h["i"] >= g), key=lambda h: h["distance"]):
        if len(chosen) < room or key(h) in chosen:
            add(h)
    return {k: (round(c["distance"], 9), k in must, dict(sorted(c["ranks"].items()))) for k, c in chosen.items()}


HITS = "doc_id long, field_ord int, field_key string, i int, chunk_id long, text string, distance double"


def some_hits(dossiers, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dossiers):
        for f in range(int(rng.integers(1, 6))):
            near = sorted(rng.integers(0, 10_000, int(rng.integers(0, 6))).tolist())
            for i, x in enumerate(near):
                c = int(rng.integers(0, 30))
                rows.append((d, f, f"f{f}", i, c, " " if c == 7 else f"t{c % 9}", x + d / 1e5 + f / 1e4))
    return rows


def test_guaranteed_for_a_thousand_dossiers(spark):
    rows = some_hits(1000)
    h = spark.createDataFrame(rows, HITS)
    names = [x.split()[0] for x in HITS.split(", ")]
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(dict(zip(names, r, strict=True)))
    for g, cap in ((2, 3), (1, 20), (0, 4)):
        chosen = R.guaranteed(h, g, cap, "doc_id")
        got = defaultdict(dict)
        for r in chosen.collect():
            ranks = {}
            for f in r.found:
                ranks[f.field_key] = min(f.i, ranks.get(f.field_key, 99))
            got[r.doc_id][r.key] = (round(r.distance, 9), r.must, dict(sorted(ranks.items())))
        assert got == {d: guaranteed(x, g, cap) for d, x in own.items()}
    one = {(r.key, r.must) for r in R.guaranteed(h.filter("doc_id = 3"), 2, 3).collect()}
    assert one == {(r.key, r.must) for r in R.guaranteed(h, 2, 3, "doc_id").filter("doc_id = 3").collect()}


def test_guaranteed_plans_without_an_action(spark):
    h = spark.createDataFrame(some_hits(3), HITS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    R.guaranteed(h, 2, 3, "doc_id")
    assert tracker.getJobIdsForGroup("plan-only") == []
    assert "WindowGroupLimit" in plan(R.guaranteed(h, 2, 3, "doc_id"))


# -- validity ------------------------------------------------------------------------------------

DAY0 = dt.date(2000, 1, 1)


def test_spans_make_up_the_interval(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(200):
        a, n = int(rng.integers(0, 3_000_000)), int(rng.integers(0, 5000)) if k % 3 else int(rng.integers(0, 500_000))
        rows.append((k, dt.date.fromordinal(1 + a), dt.date.fromordinal(min(1 + a + n, dt.date.max.toordinal()))))
    rows.append((200, dt.date(1, 1, 1), dt.date.max))
    df = spark.createDataFrame(rows, "k int, a date, b date")
    got = defaultdict(list)
    for r in df.select("k", F.explode(R.spans_of(F.col("a"), F.col("b"))).alias("s")).select("k", "s.*").collect():
        got[r.k].append((r.span << r.level, (r.span + 1) << r.level))
    for k, a, b in rows:
        parts = sorted(got[k])
        assert parts[0][0] == a.toordinal() - 1 and parts[-1][1] == b.toordinal()
        assert all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * R.LEVELS
    assert spark.createDataFrame([(dt.date(2000, 1, 2), dt.date(2000, 1, 1))], "a date, b date").select(F.size(R.spans_of(F.col("a"), F.col("b")))).first()[0] == 0


def test_valid_top_k(spark):
    rng = np.random.default_rng(2)
    passages = [(f"s{k % 2}", f"f{k % 3}", f"c{k}", float(rng.integers(0, 60)), DAY0 + dt.timedelta(int(rng.integers(0, 900))), None if k % 4 == 0 else DAY0 + dt.timedelta(int(rng.integers(0, 1500)))) for k in range(300)]
    days = [(s, DAY0 + dt.timedelta(int(d))) for s in ("s0", "s1") for d in rng.integers(-50, 2000, 120)] + [("s0", None), ("s1", dt.date(1, 1, 1)), ("s0", dt.date.max), ("gone", DAY0)]
    got = R.valid_top_k(spark.createDataFrame(days, "scope string, day date"), spark.createDataFrame(passages, "scope string, field_key string, chunk_id string, distance double, effective_from date, effective_to date"), 3, ("scope",), ("field_key",))
    want = []
    for s, day in set(days):
        own = [p for p in passages if p[0] == s]
        valid = [p for p in own if day is None or (p[4] <= day and (p[5] is None or p[5] >= day))]
        for f in ("f0", "f1", "f2"):
            best = sorted((p[3], p[2]) for p in (valid or own) if p[1] == f)[:3]
            want += [(s, f, str(day), c, d, n + 1, bool(valid)) for n, (d, c) in enumerate(best)]
    assert sorted((r.scope, r.field_key, str(r.day), r.chunk_id, r.distance, r["rank"], r.in_force) for r in got.collect()) == sorted(want)


def test_what_meets_does_not_grow_with_days(spark):
    """Rows that enter the choice of the nearest follow passages and days, not their product."""
    passages = spark.range(400).select(F.col("id").cast("string").alias("chunk_id"), (F.col("id") % 97).cast("double").alias("distance"), F.date_add(F.lit(DAY0), (F.col("id") % 300).cast("int")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))

    def rows(n):
        df = R.valid_top_k(spark.range(n).select(F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("day")), passages, 2)
        df.collect()
        q, most = df._jdf.queryExecution().executedPlan(), []

        def walk(p):
            name = p.nodeName()
            if name.startswith("AdaptiveSparkPlan"):
                return walk(p.executedPlan())
            if "Join" in name and p.metrics().contains("numOutputRows"):
                most.append(p.metrics().apply("numOutputRows").value())
            if name.endswith("QueryStage"):
                return walk(p.plan())
            c = p.children()
            for i in range(c.size()):
                walk(c.apply(i))

        walk(q)
        return max(most)

    few, many = rows(100), rows(1000)
    assert many <= 14 * few and many < 1000 * 400 / 8


# -- the flow ---------------------------------------------------------------------------------------


def plain_flow(fields, docs, chunks, check):
    """(checks, reports) of dossiers from their fields, one dossier after the other."""
    emb, rules, model = check.embedder(), check.rules, check.model()
    scoped = [c for c in chunks if c["jurisdiction"] == rules.jurisdiction and c["doc_type"] in rules.doc_types and c["reg_set"] in rules.sets]
    vec = emb.embed([c["text"] for c in scoped])
    distance = {}
    for f in check.fields:
        q = emb.embed([f"{check.kind} {f.label}"])[0]
        distance[f.key] = [round(float(((q - v) ** 2).sum()), 6) for v in vec]
    order = {k: n for n, k in enumerate(sorted(f.key for f in check.fields if any(x["field_key"] == f.key and x["check_type"] == "regulated" and (x["value"] or "").strip() for x in fields)))}
    by = defaultdict(dict)
    for x in fields:
        by[x["doc_id"]][x["field_key"]] = x
    checks, reports = {}, {}
    for doc, own in by.items():
        has = {k: bool((x["value"] or "").strip()) for k, x in own.items()}
        day = docs[doc]
        valid = [n for n, c in enumerate(scoped) if day is None or (c["effective_from"] <= day and (c["effective_to"] is None or c["effective_to"] >= day))] or range(len(scoped))
        asked = [k for k, x in own.items() if x["check_type"] == "regulated" and has[k]]
        hits = []
        for k in asked:
            for i, n in enumerate(sorted(valid, key=lambda n: (distance[k][n], scoped[n]["chunk_id"]))[: rules.per_field]):
                hits.append({"field_ord": order[k], "field_key": k, "i": i, "chunk_id": scoped[n]["chunk_id"], "text": scoped[n]["text"], "distance": distance[k][n]})
        sent = guaranteed(hits, rules.guarantee, rules.cap)
        judged = {c["field_key"]: c["verdict"] for c in json.loads(model.chat(json.dumps({"fields": sorted(asked)})))["checks"]} if asked else {}
        out = {}
        for k, x in own.items():
            if x["check_type"] == "declaration":
                out[k] = "DECLARATION"
            elif has[k] and x["check_type"] == "positive_integer":
                out[k] = "PASS" if int(x["value"]) > 0 else "FAIL"
            elif has[k]:
                cited = sum(k in c[2] for c in sent.values())
                v = judged.get(k, "NEEDS_SUPPLEMENT")
                out[k] = "NEEDS_SUPPLEMENT" if not cited else v
            if not has[k] and x["required"] and k not in out:
                out[k] = "NEEDS_SUPPLEMENT"
        if not has[check.date_field]:
            out[check.date_field] = "NEEDS_SUPPLEMENT"
        for g in rules.groups:
            if not any(has.get(k, False) for k in g):
                out[f"one_of_{g[0]}"] = "NEEDS_SUPPLEMENT"
        checks[doc] = out
        worst = set(out.values())
        reports[doc] = ("FAIL" if "FAIL" in worst else "NEEDS_SUPPLEMENT" if "NEEDS_SUPPLEMENT" in worst or not asked else "PASS", None if asked else "NO_REGULATED_FIELDS", sum(v == "FAIL" for v in out.values()), len(out))
    return checks, reports


def test_flow_against_plain_python(spark, sf_dir):
    docs, chunks = flow._forms(spark, sf_dir)
    odd = spark.createDataFrame([(-1, ""), (-2, "1. Ngày ký: 01/01/1900\n2. Tien luong: 5 USD/tháng"), (-3, "- Số lượng: 0 người"), (-4, "- Số lượng: 3 người\nĐịa điểm làm việc: Kho A")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    checks, report = flow.check_dossiers(docs, chunks, flow.CHECK)
    fields = [r.asDict() for r in report.fields.collect()]
    days = {r.doc_id: r.day for r in flow.signing_days(report.fields, flow.CHECK).collect()}
    want_checks, want_reports = plain_flow(fields, days, [r.asDict() for r in chunks.collect()], flow.CHECK)
    got = defaultdict(dict)
    for r in checks.collect():
        assert r.field_key not in got[r.doc_id]
        got[r.doc_id][r.field_key] = r.verdict
    assert dict(got) == want_checks
    assert {r.doc_id: (r.overall_verdict, r.flag, r.violations, r.checks) for r in report.collect()} == want_reports
    assert {"PASS", "FAIL", "NEEDS_SUPPLEMENT"} >= {w[0] for w in want_reports.values()} and len({w[0] for w in want_reports.values()}) > 1


def test_flow_meets_on_keys(spark, sf_dir):
    docs, chunks = flow._forms(spark, sf_dir)
    _, report = flow.check_dossiers(docs, chunks, flow.CHECK)
    text = plan(report)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_one_request_a_case(spark):
    """Dossiers with equal asked fields and days are one request; each has its own checks and passages."""
    day = dt.date(2024, 5, 1)
    rows = [(i, k, "x", "regulated", True, True) for i in range(40) for k in ("a", "b")[: 1 + i % 2]]
    fields = spark.createDataFrame(rows, "doc_id long, field_key string, value string, check_type string, required boolean, selected boolean")
    days = spark.createDataFrame([(i, None if i % 4 == 0 else day) for i in range(40)], "doc_id long, day date")
    near = spark.createDataFrame([(k, "c1", "t", 0.1, day, None) for k in "ab"], "field_key string, chunk_id string, text_key string, distance double, effective_from date, effective_to date")
    asked = []

    def ask(requests):
        asked.extend(r.doc_id for r in requests.collect())
        return models.judge(requests, models.EchoModel)

    passages = spark.createDataFrame([("c1", "text")], "chunk_id string, text string")
    checks, report, sent = judging.judge(fields, days, near, passages, judging.Rules(), ask, fields.limit(0))
    assert sorted(asked) == [0, 1, 2]  # a, no day; a and b; a
    verdicts = {(r.doc_id, r.field_key): (r.verdict, r.citations) for r in checks.collect()}
    assert set(verdicts) == {(i, k) for i, k, *_ in rows} and {v[1] for v in verdicts.values()} == {1}
    assert all(verdicts[i, k] == verdicts[1, k] for i, k in verdicts)
    assert sent.groupBy("doc_id").count().filter("count = 1").count() == 40 == report.count()


def test_no_passage_in_scope(spark):
    fields = spark.createDataFrame([(1, "a", "x", "regulated", True, True)], "doc_id long, field_key string, value string, check_type string, required boolean, selected boolean")
    days = spark.createDataFrame([(1, None)], "doc_id long, day date")
    near = spark.createDataFrame([], "field_key string, chunk_id string, text_key string, distance double, effective_from date, effective_to date")
    ask = lambda r: spark.createDataFrame([(1, 0, "a", "PASS")], "doc_id long, ord int, field_key string, model_verdict string")
    checks, report, sent = judging.judge(fields, days, near, spark.createDataFrame([], "chunk_id string, text string"), judging.Rules(), ask, fields.limit(0))
    assert [r.verdict for r in checks.collect()] == ["NEEDS_SUPPLEMENT"]  # a pass without a citation
    assert report.first().overall_verdict == "NEEDS_SUPPLEMENT" and sent.count() == 0


# -- vector index --------------------------------------------------------------------------------------


def test_vector_index(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    q = e.filter("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vec"), "label")
    vector_index.build(e, str(tmp_path / "index"), lists=16)
    index = vector_index.Index(spark, str(tmp_path / "index"))
    key = lambda df: {(r.query_id, r.chunk_id, r.distance, r["rank"]) for r in df.collect()}
    want = key(R.top_k(q, e, "label", 5))
    assert key(index.exact(q, 5, 2, ("label",))) == want
    probes = index.probes_for(q, 5, 0.95, ("label",))
    recall = lambda p: len({x[:2] for x in key(index.search(q, 5, p, ("label",)))} & {x[:2] for x in want}) / len(want)
    assert probes < 16 and recall(probes) >= 0.95 > recall(probes - 1)
    assert index.lists.count() == e.filter(vector_index.usable(F.col("embedding"))).count()


def test_vector_index_of_odd_vectors(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    vector_index.build(v, str(tmp_path / "a"), lists=8)
    q = spark.createDataFrame([(0, [0.1, 0.0])], "query_id long, vec array<double>")
    index = vector_index.Index(spark, str(tmp_path / "a"))
    assert [r.chunk_id for r in index.exact(q, 3, 1).orderBy("rank").collect()] == [1, 2, 6]
    vector_index.build(v.limit(0), str(tmp_path / "b"), lists=8)
    assert vector_index.Index(spark, str(tmp_path / "b")).exact(q, 3, 1).count() == 0
    with pytest.raises(ValueError):
        vector_index.centres_of(v, 0)


def test_parts_follow_the_largest_scope(spark):
    v = spark.range(1000).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("double")).alias("embedding"), F.when(F.col("id") < 900, "a").otherwise("b").alias("label"))
    assert R.parts_for(v, "label", 100) == 9 and R.parts_for(v.limit(0), "label") == 1
    q = spark.createDataFrame([(1, [0.2], "a"), (2, [950.0], "b")], "query_id long, vec array<double>, label string")
    best = lambda n: sorted((r.query_id, r.chunk_id, r["rank"]) for r in R.top_k(q, v, "label", 2, n).collect())
    assert best(9) == best(1) == [(1, 0, 1), (1, 1, 2), (2, 949, 2), (2, 950, 1)]


def test_hash_embedder_is_used_alike():
    assert np.allclose(models.HashEmbedder().embed(["a b"]), models.HashEmbedder().embed(["b a"]))
    assert Q.QUERIES["valid_topk_by_day"] is not None


# -- lines of evidence -----------------------------------------------------------------------------------


def test_best_own_line(spark):
    """As the join of lines and quotes, for repeated and null ids too, without a shuffle of lines."""
    from complyspark.operators import grounding, pages

    rows = [(1, "alpha beta gamma\nbeta gamma\nAlpha béta gamma delta"), (2, "one two\nthree four"), (2, "three four five\none two six\nthree four five"), (None, "x yy zz\nyy zz"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    l = F.split("text", "\n")
    quote = F.get(l, F.floor(F.size(l) / 2).cast("int"))
    want = grounding.best_line(pages.lines(docs), docs.select("doc_id", quote.alias("quote")))
    got = grounding.best_own_line(docs, quote)
    key = lambda df: sorted((r.doc_id, r.quote, r.line_no, r.score) for r in df.collect() if r.doc_id is not None)
    assert key(got) == key(want) and len(key(want)) == 3
    text = plan(grounding.best_own_line(docs.filter("doc_id < 2"), quote))
    assert not [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "line_no" in x and "words" in x]
