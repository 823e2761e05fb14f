"""Keyed store, memo, run log, page source, rounds of reading, model calls, golden cases, counters, watches."""

import json
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from complyspark.operators import counters, frontier
from complyspark.operators.memo import Memo
from complyspark.sources import calls, golden, models, pages, runlog
from complyspark.sources.store import Conflict, KeyedStore

# -- keyed store ----------------------------------------------------------------------------------

ROWS = "id long, part string, value string"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), ROWS, ("id", "part"), buckets=8)


def content(df):
    return sorted((str(r.id), str(r.part), r.value) for r in df.collect())


def test_store_upserts_like_a_dictionary(spark, store):
    import random

    rnd, want = random.Random(1), {}
    assert store.read().count() == 0
    for step in range(6):
        rows = [(rnd.choice([None, *range(40)]), rnd.choice(["a", None]), f"{step}-{k}") for k in range(15)]
        last = {}
        for r in rows:
            last[r[:2]] = max(last.get(r[:2], ""), r[2])
        store.upsert(spark.createDataFrame(rows, ROWS), order="value")
        want |= last
        assert content(store.read()) == sorted((str(k[0]), str(k[1]), v) for k, v in want.items())
    gone = [k for n, k in enumerate(want) if n % 3 == 0]
    store.delete(spark.createDataFrame(gone, "id long, part string"))
    want = {k: v for k, v in want.items() if k not in gone}
    assert content(store.read()) == sorted((str(k[0]), str(k[1]), v) for k, v in want.items())
    assert store.upsert(spark.createDataFrame([], ROWS)) == store.versions()[-1]


def test_readers_keep_their_version(spark, store):
    store.upsert(spark.createDataFrame([(1, "a", "old")], ROWS))
    reader = store.read()
    store.upsert(spark.createDataFrame([(1, "a", "new"), (2, "a", "x")], ROWS))
    assert content(reader) == [("1", "a", "old")] and content(store.read(0)) == [("1", "a", "old")]
    assert content(store.read()) == [("1", "a", "new"), ("2", "a", "x")]
    assert store.vacuum() and content(store.read()) == [("1", "a", "new"), ("2", "a", "x")]
    with pytest.raises(ValueError):
        store.read(0)
    store.reset()
    assert store.read().count() == 0


def test_a_crash_before_the_switch_leaves_the_old_version(spark, store, monkeypatch):
    store.upsert(spark.createDataFrame([(k, "a", "old") for k in range(20)], ROWS))
    before = content(store.read())

    def crash(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_switch", crash)
        with pytest.raises(OSError, match="gone"):
            store.upsert(spark.createDataFrame([(k, "a", "new") for k in range(20)], ROWS))
    assert content(store.read()) == before
    assert len(store.vacuum()) == 1  # what the crash left
    assert content(store.read()) == before


def test_the_later_of_two_writers_starts_anew(spark, store):
    store.upsert(spark.createDataFrame([(1, "a", "x")], ROWS))
    other = KeyedStore(spark, store.where, ROWS, ("id", "part"), buckets=8)
    switch, raced = store._switch, []

    def late(version, held):
        if not raced:
            raced.append(other.upsert(spark.createDataFrame([(1, "a", "theirs"), (2, "a", "theirs")], ROWS)))
        switch(version, held)

    store._switch = late
    store.upsert(spark.createDataFrame([(1, "a", "mine")], ROWS))
    assert content(store.read()) == [("1", "a", "mine"), ("2", "a", "theirs")]
    raced.clear()
    with pytest.raises(Conflict):
        store.upsert(spark.createDataFrame([(1, "a", "again")], ROWS), tries=1)


def test_only_touched_buckets_are_rewritten(spark, store):
    store.upsert(spark.createDataFrame([(k, "a", "x" * 100) for k in range(400)], ROWS))
    first = store._manifest(None)["held"]
    store.upsert(spark.createDataFrame([(1, "a", "y")], ROWS))
    second = store._manifest(None)["held"]
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    size = lambda folder: sum(p.stat().st_size for p in Path(store.where, "data", folder).rglob("*.parquet"))
    new = (set(second.values()) - set(first.values())).pop()
    assert size(new) < size(next(iter(first.values()))) / 4
    with pytest.raises(ValueError):
        KeyedStore(spark, store.where, ROWS, ("id", "part"), buckets=4).read()


# -- memo --------------------------------------------------------------------------------------------


def test_memo(spark, tmp_path):
    asked = []

    def answer(queries):
        rows = queries.collect()
        asked.append(sorted(r.query for r in rows))
        hits = [(r["query"], r["filter"], r["k"], n + 1, f"{r['query']}{n}", n / 2) for r in rows if r["query"] != "none" for n in range(r["k"])]
        return spark.createDataFrame(hits, "query string, filter string, k int, rank int, chunk_id string, distance double")

    memo = Memo(spark, str(tmp_path / "memo"), answer, most=3)
    q = lambda *names: spark.createDataFrame([(n, n, "VN", 2) for n in names], "field string, query string, filter string, k int")
    first = memo.ask(q("a", "b", "a", "none"), "fp1", 1)
    assert Counter(r.field for r in first.collect()) == {"a": 4, "b": 2}
    again = memo.ask(q("b", "none"), "fp1", 2)
    assert sorted((r.field, r["rank"], r.chunk_id) for r in again.collect()) == [("b", 1, "b0"), ("b", 2, "b1")]
    assert asked == [["a", "b", "none"]]  # nothing is asked twice, not even what has no hit
    assert memo.prefetch(q("c"), "fp1", 3) == 1 and memo.store.read().count() == 3
    assert "a" not in {r.query for r in memo.store.read().collect()}  # used longest ago
    memo.ask(q("b"), "fp2", 4)
    assert asked[-1] == ["b"] and {r.fingerprint for r in memo.store.read().collect()} == {"fp2"}
    memo.clear()
    assert memo.prefetch(q("b"), "fp2", 5) == 1


# -- run log ----------------------------------------------------------------------------------------


def runs(spark, ids):
    doc = "struct<doc_id:string,source_file:string,overall_verdict:string,checks:array<struct<verdict:string>>>"
    return spark.createDataFrame([(i, f"s{i}", 1.26, [("doc1", None, None, [("FAIL",), ("PASS",), ("FAIL",)]), ("doc2", "f.pdf", "PASS", None)]) for i in ids], f"run_id string, session_id string, ocr_seconds double, documents array<{doc}>")


def test_run_log(spark, tmp_path):
    path, now = str(tmp_path / "log"), F.lit("2024-05-06 07:08:09").cast("timestamp")
    assert runlog.read(spark, path).count() == 0
    lines = runlog.run_lines(runs(spark, ["r1", "r2"]).repartition(3), now)
    runlog.append(lines, path, "b1")
    runlog.append(lines, path, "b1")  # the batch runs again
    runlog.append(runlog.run_lines(runs(spark, ["r2", "r3"]), now), path, "b2")
    got = runlog.read(spark, path).orderBy("run_id").collect()
    assert [(r.run_id, r.batch, r.session_id, r.num_documents, r.ocr_seconds) for r in got] == [("r1", "b1", "sr1", 2, 1.3), ("r2", "b1", "sr2", 2, 1.3), ("r3", "b2", "sr3", 2, 1.3)]
    assert [(d.overall_verdict, d.num_fail) for d in got[0].documents] == [("NEEDS_SUPPLEMENT", 2), ("PASS", 0)]
    assert got[0].ts.startswith("2024-05-06T07:08:09")
    assert len(list(Path(path, "staged").iterdir())) == 2  # nothing is left of the repeated batch


def test_a_failed_task_leaves_no_line(spark, tmp_path):
    path = str(tmp_path / "log")
    broken = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("run_id"), F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise("{}").alias("line"))
    with pytest.raises(Exception, match="broken"):
        runlog.append(broken, path, "b1")
    assert runlog.read(spark, path).count() == 0
    assert not Path(path, "staged").exists() or not list(Path(path, "staged").iterdir())
    runlog.append(broken.filter("run_id <> '17'"), path, "b1")
    assert runlog.read(spark, path).count() == 39


# -- pages ------------------------------------------------------------------------------------------------

WORDS = "Điều khoản hợp đồng lao động về tiền lương và thời giờ làm việc của người lao động theo quy định của pháp luật hiện hành. " * 4


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "files"
    where.mkdir()
    (where / "big.txt").write_text("\f".join(f"page {n}\n{WORDS}" for n in range(500)))
    (where / "huge.txt").write_text("\f".join("x" for _ in range(501)))
    (where / "locked.txt").write_bytes(b"%LOCKED")
    (where / "mixed.txt").write_text("\f".join([f"one\n{WORDS}", "", f"three\n{WORDS}", "short"]))
    (where / "scan.txt").write_text("\f\f")
    return where


def test_pages_of_one_file_are_many_tasks(spark, folder):
    df = pages.read_pages(spark, str(folder / "big.txt"))
    assert df.rdd.getNumPartitions() == 25
    got = df.collect()
    assert sorted(r.page_index for r in got) == list(range(500)) and all(r.lines[0].text == f"page {r.page_index}" for r in got)


def test_filters_on_the_page_prune_ranges(spark, folder):
    some = pages.read_pages(spark, str(folder / "big.txt")).filter("page_index between 30 and 45")
    assert some.rdd.getNumPartitions() == 2 and sorted(r.page_index for r in some.collect()) == list(range(30, 46))
    few = pages.read_pages(spark, str(folder / "big.txt")).filter("page_index in (3, 499)")
    assert few.rdd.getNumPartitions() == 2 and sorted(r.page_index for r in few.collect()) == [3, 499]


def test_documents_and_their_statistics(spark, folder):
    every = pages.read_pages(spark, str(folder))
    name = lambda p: p.rsplit("/", 1)[-1]
    images = spark.createDataFrame([(str(folder / "mixed.txt"), 1, [("read from the image", 0.7)]), (str(folder / "scan.txt"), 0, [("  ", 0.2)])], "path string, page_index int, lines array<struct<text:string,conf:double>>")
    lines, stats = pages.read_documents(every, images)
    got = {name(r.path): (r.pages, r.from_text, r.ocred, r.skipped, r.error) for r in stats.collect()}
    assert got == {
        "big.txt": (500, 500, 0, [], None), "huge.txt": (0, 0, 0, [], "501 pages, 500 at most"), "locked.txt": (0, 0, 0, [], "the file is locked"),
        "mixed.txt": (4, 2, 1, [4], None), "scan.txt": (3, 0, 1, [2, 3], "no readable text"),
    }
    mixed = [(r.page_index, r.source, r.text[:5]) for r in lines.filter(F.col("path").endswith("mixed.txt")).orderBy("page_index", "line_no").collect()]
    assert [m for m in mixed if m[1] == "image"] == [(1, "image", "read ")] and {m[0] for m in mixed} == {0, 1, 2}
    assert not lines.filter(F.col("path").endswith("scan.txt")).count()
    without = {name(r.path): (r.ocred, r.skipped) for r in pages.read_documents(every)[1].collect()}
    assert without["mixed.txt"] == (0, [2, 4]) and without["scan.txt"] == (0, [1, 2, 3])


# -- rounds of reading ------------------------------------------------------------------------------------


def book(n):
    """Documents as pages of lines; ends, needed fields and starts differ."""
    docs = {}
    for d in range(n):
        text = [[f"doc {d} page {p}", f"line {p}"] for p in range(3 + d % 9)]
        if d % 4:
            text[d % 3].append("HỢP ĐỒNG LAO ĐỘNG")
        if d % 5 == 1:
            text[-2].append("PHỤ LỤC HỢP ĐỒNG")
        if d % 5 == 2:
            text[min(3, len(text) - 1)].append("Lương: 100")
        if d % 7 == 3:
            text[1] = []
        docs[d] = text
    return docs


@pytest.mark.parametrize("step", [1, 3])
def test_rounds_of_reading(spark, tmp_path, step):
    docs, start, end = book(60), ["hopdonglaodong"], ["phuluc"]
    rows = [(d, p, n, t, 0.9) for d, ps in docs.items() for p, ls in enumerate(ps) for n, t in enumerate(ls)]
    source = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string, conf double")
    asked = []

    def read(want):
        got = want.collect()
        asked.extend((r.doc_id, r.page_index) for r in got)
        return source.join(want, ["doc_id", "page_index"], "left_semi")

    complete = lambda lines: lines.filter(F.col("text").startswith("Lương:")).select("doc_id")
    table = spark.createDataFrame([(d, len(p)) for d, p in docs.items()], "doc_id long, n_pages int")
    lines, state = frontier.read_until(table, read, str(tmp_path / "r"), start, end, complete, step)
    want_pages, want_lines = {}, set()
    for d, ps in docs.items():
        seen, began, stop = 0, None, None
        while seen < len(ps) and stop is None:
            for p in range(seen, min(seen + step, len(ps))):
                for n, t in enumerate(ps[p]):
                    if began is None and "HỢP ĐỒNG LAO ĐỘNG" in t:
                        began = (p, n)
                    elif stop is None and began is not None and t.startswith("PHỤ LỤC") and (p, n) > began:
                        stop = p
            seen = min(seen + step, len(ps))
            if stop is None and began is not None and any(t.startswith("Lương:") for p in ps[:seen] for t in p):
                break
        want_pages[d] = seen
        want_lines |= {(d, p, n) for p in range(seen if stop is None else stop + 1) for n in range(len(ps[p]))}
    got = {r.doc_id: r.pages_read for r in state.collect()}
    assert got == want_pages
    assert {(r.doc_id, r.page_index, r.line_no) for r in lines.collect()} == want_lines
    assert len(asked) == len(set(asked)) == sum(want_pages.values()) < sum(map(len, docs.values()))
    before = len(asked)
    again, _ = frontier.read_until(table, read, str(tmp_path / "r"), start, end, complete, step)
    assert again.count() == len(want_lines) and len(asked) == before  # a restart reads no page again


def test_a_round_looks_at_its_own_lines(spark, tmp_path, monkeypatch):
    """Anchors are looked for in a round's lines, not in those of the rounds before; the end reads all of them."""
    n = 12
    table = spark.createDataFrame([(0, n)], "doc_id long, n_pages int")
    seen = []
    monkeypatch.setattr(frontier, "_ended", lambda lines, *a, f=frontier._ended: (seen.append(len(lines.inputFiles())), f(lines, *a))[1])
    read = lambda want: want.withColumn("line_no", F.lit(0)).withColumn("text", F.concat(F.lit("page "), "page_index")).withColumn("conf", F.lit(1.0))
    lines, state = frontier.read_until(table, read, str(tmp_path / "r"), ["page3"], ["page9"])
    assert len(seen) == 1 and state.first().pages_read == lines.count() == 10
    lines, state = frontier.read_until(table, read, str(tmp_path / "q"), ["page3"], ["page"], None, 2)
    assert (state.first().pages_read, state.first().stopped_early, lines.count()) == (6, True, 5)


# -- calls --------------------------------------------------------------------------------------------------


def test_no_dossier_is_lost(spark):
    class Flaky:
        """Fails by what a request says, and remembers how often it was asked."""

        name = "flaky"

        def __init__(self):
            self.seen = Counter()

        def chat(self, request, context):
            self.seen[request] += 1
            if request.startswith("passing") and self.seen[request] == 1:
                raise calls.Passing("503")
            if request.startswith("down"):
                raise calls.Passing("connection refused")
            if request.startswith("slow"):
                time.sleep(3)
            if request.startswith("long") and context < 20_000:
                raise calls.ContextTooSmall(21_000)
            if request.startswith("never"):
                raise calls.ContextTooSmall(10**9)
            if request.startswith("odd"):
                raise KeyError("odd")
            return json.dumps({"checks": [{"field_key": request, "verdict": "PASS"}]})

    class Steady:
        name = "steady"

        def chat(self, request, context):
            if request.endswith("!"):
                raise calls.Unusable("no such model")
            return '{"checks": [{"field_key": "' + request + '", "verdict": "FAIL"}, {"field_key": "cut'

    kinds = ["plain", "passing", "down", "down!", "slow", "long", "never", "odd", "", None]
    rows = [(k, None if x is None else f"{x[:-1]}{k}!" if x.endswith("!") else f"{x}{k}" if x else "") for k, x in enumerate(kinds * 4)]
    policy = calls.Policy(deadline=1.0, at_once=8)
    answered = calls.replies(spark.createDataFrame(rows, "doc_id long, request string").repartition(2), lambda: [Flaky(), Steady()], policy)
    got = {r.doc_id: r for r in answered.collect()}
    assert len(got) == len(rows)
    for k, kind in enumerate(kinds * 4):
        r = got[k]
        want = {"plain": ("ok", "flaky", 1), "passing": ("ok", "flaky", 2), "down": ("ok", "steady", 3), "down!": ("failed", None, 3), "slow": ("timeout", "flaky", 1), "long": ("ok", "flaky", 2), "never": ("ok", "steady", 3), "odd": ("ok", "steady", 2), "": ("failed", None, 0), None: ("failed", None, 0)}[kind]
        assert (r.status, r.model, r.attempts) == want, kind
        assert (r.error is None) == (r.status == "ok")
    judged = calls.judgements(spark.createDataFrame([(r.doc_id, r.status, r.reply) for r in got.values()], "doc_id long, status string, reply string"))
    assert {r.doc_id for r in judged.collect()} == {k for k, r in got.items() if r.status == "ok"}
    assert {r.model_verdict for r in judged.collect()} == {"PASS", "FAIL"}
    plain = calls.replies(spark.createDataFrame([(1, '{"fields": ["a"]}')], "doc_id long, request string"), lambda: [calls.Sized("echo", models.EchoModel())])
    assert plain.first().status == "ok"


# -- golden cases ----------------------------------------------------------------------------------------------


def test_golden_cases(spark, tmp_path):
    g, t = tmp_path / "golden", tmp_path / "temp"
    g.mkdir()
    cases, bad = golden.load_cases(spark, str(g))
    assert cases.count() == 0 and bad.count() == 0
    (g / "one.json").write_text(json.dumps({"session_id": "s1", "verified": True, "expected_fields": {"wage": "5000", "day": "2024-01-01", "place": None}}))
    (g / "two.json").write_text(json.dumps({"case_id": "named", "session_id": "gone", "expected_fields": {"wage": "1"}}))
    (g / "three.json").write_text(json.dumps({"expected_fields": {}}))
    (g / "broken.json").write_text('{"session_id": "s1", ')
    (g / "s9").mkdir()
    (g / "s9" / "documents.json").write_text("{}")
    for s, docs in (("s1", [{"doc_id": "doc1", "extracted_fields": {"wage": {"value": " "}, "day": {"value": "2024-02-02", "machine_value": "2024-01-01"}}}, {"doc_id": "doc2", "extracted_fields": {"wage": {"value": "5000"}}}]), ("s2", [])):
        (t / s).mkdir(parents=True)
        (t / s / "documents.json").write_text(json.dumps({"documents": docs}))
    (t / "s1" / "final_report.json").write_text(json.dumps({"checks": [{"check_id": "wage", "citations": [{"chunk_id": "c1", "source_doc": "Law"}]}]}))
    (t / "s3").mkdir()
    (t / "s3" / "documents.json").write_text("{broken")
    cases, bad = golden.load_cases(spark, str(g))
    assert {(r.file, r.reason) for r in bad.collect()} == {("broken.json", "broken"), ("s9", "artefacts")}
    fields, cited = golden.artefacts(spark, str(t))
    assert [tuple(r) for r in cited.collect()] == [("s1", "wage", "c1", "Law")]
    status, pairs = golden.joined(cases, fields)
    assert {r.case_id: (r.ok, r.verified, r.error) for r in status.collect()} == {"one": (True, True, None), "named": (False, False, "no artefacts of session gone"), "three": (False, False, "no artefacts of session (none named)")}
    assert {(r.case_id, r.field_key): (r.expected, r.actual) for r in pairs.collect()} == {("one", "wage"): ("5000", "5000"), ("one", "day"): ("2024-01-01", "2024-01-01"), ("one", "place"): (None, None)}


# -- counters -----------------------------------------------------------------------------------------------------


def test_counters_equal_a_recount(spark, tmp_path):
    run = counters.Run()
    with run.stage("llm"):
        out = run.written(spark.range(1000).repartition(7).withColumn("bad", F.col("id") % 3 == 0), str(tmp_path / "a"), **{"llm.failed": F.col("bad"), "tokens": F.col("id"), "never": F.col("id") < 0})
    with run.stage("llm"), pytest.raises(ZeroDivisionError):
        raise ZeroDivisionError
    run.bump("llm.skipped", 2)
    run.written(out.filter("bad"), str(tmp_path / "b"))
    got = run.done()
    assert got["counters"] == {"llm.failed": out.filter("bad").count(), "tokens": 499500, "llm.skipped": 2, "rows": 334}
    assert set(got["stages"]) == {"llm"} and 0 < got["stages"]["llm"] <= got["seconds"]
    rows = {(r.kind, r.name): r.value for r in run.rows(spark, "r1").collect()}
    assert rows["counter", "tokens"] == 499500.0 and ("seconds", "total") in rows


# -- watches --------------------------------------------------------------------------------------------------------


def test_watches_end_by_done_idle_and_unknown(spark, tmp_path):
    from complyspark.streaming import watch

    schema = "pid string, kind string, stage string, info string, ts timestamp"
    source = tmp_path / "in"
    source.mkdir()
    at = lambda s: f"2024-01-01 {s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"
    batches = [
        [("done", "watch", None, None, 0), ("idle", "watch", None, None, 0), ("unknown", "watch", None, None, 0), ("done", "state", "ocr", "1", 10), ("done", "state", "ocr", "1", 11), ("done", "state", "ocr", "2", 12), ("idle", "state", "ocr", "1", 20), ("early", "state", "ocr", "7", 5)],
        [("clock", "state", "ocr", "x", 200), ("early", "watch", None, None, 201)],
        [("done", "state", "done", None, 210), ("done", "state", "ocr", "late", 211), ("clock", "state", "ocr", "y", 300)],
        [("clock", "state", "ocr", "z", 1830)],
        [("clock", "state", "ocr", "w", 4000)],
        [("early", "watch", None, None, 4001), ("clock", "state", "ocr", "v", 4300)],
        [("clock", "state", "ocr", "u", 4400)],
    ]
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, watch.ROCKSDB)
    try:
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        for n, b in enumerate(batches):
            (source / f"{n}.json").write_text("\n".join(json.dumps({"pid": p, "kind": k, "stage": s, "info": i, "ts": at(t)}) for p, k, s, i, t in b))
            query = watch.watch(events, late="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(key, old)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at", "what").collect()
    seen = lambda pid: [(r.what, r.stage, r.info) for r in got if r.pid == pid]
    assert seen("done") == [("change", "ocr", "1"), ("change", "ocr", "2"), ("change", "done", None), ("ended", "done", None)]
    assert seen("idle") == [("change", "ocr", "1"), ("idle", "ocr", "1")]
    assert seen("unknown") == [("unknown", None, None)]
    # a watch that comes later sees the state at once; when that is forgotten it knows nothing
    assert seen("early") == [("change", "ocr", "7"), ("idle", "ocr", "7"), ("unknown", None, None)]
    ends = {(r.pid, r.what): r["at"] for r in got}
    assert str(ends["unknown", "unknown"]) == "2024-01-01 00:02:00" and str(ends["idle", "idle"]) == "2024-01-01 00:30:20"
