"""Operators that hold state or parse: lexicon, extraction, sources, models, streams."""

import io
import json
import zipfile
from datetime import date

from pyspark.sql import functions as F

from complyspark.operators import corpus, extract, lexicon, pages, retrieval
from complyspark.sources import files, models
from complyspark.streaming import progress


def restored(spark, lex, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_row", F.lit("x"))
    out = lexicon.restore(df, lex)
    assert out.columns == df.columns
    return [r.text for r in out.orderBy("doc_id").collect()]


def test_restore(spark):
    text = "sử dụng lao động sử dụng lao động kỹ năng người lao động người kỹ năng sử dụng hợp đồng hợp đồng"
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    lex = lexicon.build(docs)
    got = restored(spark, lex, "HOP dong", "S dng; ngui", "Hà Nội 2024, hợp đồng.", "hop", None, "")
    assert got == ["HỢP đồng", "Sử dụng; người", "Hà Nội 2024, hợp đồng.", "hop", None, ""]
    assert restored(spark, lexicon.build(docs.limit(0)), "hop dong") == ["hop dong"]


def test_restore_against_whole_tables(spark):
    """What texts ask for is all that a lexicon of the whole corpus would have given them."""
    import random

    rnd = random.Random(5)
    syllables = ["thuế", "thuê", "đất", "nhà", "lương", "phụ", "cấp", "trợ", "điều", "khoản", "hợp", "đồng", "người", "động", "quyền", "nghĩa", "tuyển", "dụng", "chuyển", "nhượng"]
    corpus_texts = [" ".join(rnd.choice(syllables[:10] if k % 2 else syllables) for _ in range(60)) for k in range(40)]
    lex = lexicon.build(spark.createDataFrame(list(enumerate(corpus_texts)), "doc_id long, text string"))
    whole = lexicon.Lexicon({r.fold: r.word for r in lex.folds.collect()}, {r.skel: r.word for r in lex.skeletons.collect()}, {r.skel2: r.pair for r in lex.word_pairs.collect()}, {}, {r.word for r in lex.known.collect()}, {r.folds for r in lex.seen.collect()})
    keys = list(whole.by_fold)

    class Alike(dict):
        def get(self, f, default=None):
            near = [k for k in keys if k[0] == f[0] and 1 <= len(k) - len(f) <= 2 and lexicon._within(f, k)] if len(f) >= 4 and f not in whole.by_fold else []
            best = lexicon.likeliest(f, near)
            return whole.by_fold[best] if best else default

    whole.alike = Alike()
    damaged = []
    for t in corpus_texts[:25]:
        own = [lexicon._plain(w) if rnd.random() < 0.6 else w for w in t.split()[:25]]
        own = [w[:k] + w[k + 1 :] if len(w) > 3 and rnd.random() < 0.3 and (k := rnd.randrange(1, len(w))) else w for w in own]
        damaged.append(" ".join(own))
    want = [whole.restore(t) for t in damaged]
    assert want != damaged
    assert restored(spark, lex, *damaged) == want


def test_extract(spark):
    cat = [extract.Field("d", "Ngày ký", "date"), extract.Field("m", "Tiền lương", "money"), extract.Field("n", "Số lượng", "number"), extract.Field("t", "Địa điểm làm việc", "text"), extract.Field("x", "Thời hạn", "text", shape=r"\d+ năm")]
    text = "1. Ngày ký: 31/02/2024, sửa 01/03/2024\n2. Tien lvong: 50\nUSD/tháng\n- Số lượng: 106.757.000 VND, 12 người\n- Đa đim làm vic: Kho số 5\nHà Nội.\nkhác\n- Thời hạn: trong 5 năm kể từ ngày ký"
    rows = extract.extract_fields(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), cat).collect()
    got = {(r.doc_id, r.field_key): r.value for r in rows}
    assert got[1, "d"] == "2024-03-01"
    assert got[1, "m"] == "50 USD tháng"
    assert got[1, "n"] == "12"
    assert got[1, "t"] == "Kho số 5 Hà Nội"
    assert got[1, "x"] == "5 năm"
    assert got[2, "d"] is None


def extracted(spark, fields, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.field_key): r for r in extract.extract_fields(df, fields).collect()}


def test_extract_places(spark):
    """Numbers read the first place of their label only, dates and money all of them."""
    f = extract.Field
    fields = [f("d", "Ngày ký", "date"), f("m", "Phí dịch vụ", "money"), f("n", "Số lượng", "number")]
    got = extracted(
        spark, fields,
        "Ngày ký: chưa rõ\nNgày ký: 05/06/2023\nPhí dịch vụ: thoả thuận\n- Phí dịch vụ: 1.500.000 VND/năm (trả sau)\nSố lượng: không rõ, sẽ được hai bên thoả thuận lại sau khi ký kết hợp đồng\nSố lượng: 7",
        "Ngày ký:\n- 01/02/2022\nSố lượng: 1234567 hoặc 0012 cái",
        "Phí dịch vụ: 999\nPhí dịch vụ: 0",
    )
    assert got[0, "d"].value == "2023-06-05" and got[0, "d"].confidence == 0.6
    assert got[0, "m"].value == "1500000 VND năm"
    assert got[0, "n"].value is None and got[0, "n"].confidence == 0
    assert got[1, "d"].value is None and got[1, "n"].value == "12"
    assert got[2, "m"].value == "0"


def test_extract_text(spark):
    f = extract.Field
    fields = [f("t", "Bảo hiểm", shape=""), f("o", "Người đại diện", alternatives=("Đại diện",)), f("x", "Điện thoại", pattern="["), f("y", "Mã số", "number", pattern=r"MS-(\d+)"), f("same1", "Ghi chú"), f("same2", "Ghi chú")]
    got = extracted(
        spark, fields,
        "1. Bảo hiểm: theo quy định của pháp luật\n2. Bảo hiểm: mức 8% lương tháng; Người đại diện: Trần B\nkế toán trưởng\n\nGhi chú: a",
        "Bảo hiểm: tổng cộng 5 khoản\nNguoi dai dien: 5.000 VND\n\nMã MS-0042",
        "Bảo hiểm: theo quy định của pháp luật",
        "Bảo hiểm: không\nCăn cứ biên bản họp\nNgười đại diện pháp lý bên mua: Lê C.",
    )
    assert got[0, "t"].value == "mức 8% lương tháng" and got[0, "o"].value == "Trần B kế toán trưởng"
    assert got[0, "same1"].value is None and got[0, "same2"].value is None
    assert got[1, "t"].value is None and got[1, "o"].value is None
    assert got[1, "y"].value == "0042" and got[1, "y"].confidence == 0.7 and got[1, "y"].quote == "MS-0042"
    assert got[2, "t"].value == "theo quy định của pháp luật"
    assert got[3, "t"].value == "không"
    assert got[3, "o"].value in ("Lê C", "pháp lý bên mua: Lê C")


def test_extract_plan_is_native(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = extract.extract_fields(df, [extract.Field("a", "Ngày", "date")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert extract.extract_fields(df, []).count() == 0


def test_labels_as_patterns():
    import re

    rx = re.compile(extract.tolerant_label("Địa điểm làm việc (nếu có)"))
    for ok in ("dia diem lam viec", "d1a diem lam vlec", "dia diem lam", "da dim lm vec", "dia, diem - lam"):
        assert rx.match(ok), ok
    for bad in ("dia lam viec", "mia diem lam"):
        assert not rx.match(bad), bad
    assert extract.own_labels([extract.Field("a", "X y"), extract.Field("b", "x Y", alternatives=("Z",))]) == {"a": [], "b": ["Z"]}
    assert extract.tolerant_label("???") == ""


def test_archives_and_markdown(spark):
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Chương I</w:t></w:r></w:p><w:p><w:r><w:t>Điều 1. Phạm vi</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>mục</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", word)
    pack = io.BytesIO()
    with zipfile.ZipFile(pack, "w") as z:
        z.writestr("dir/law.docx", docx.getvalue())
        z.writestr("note.txt", "xin chào")
        z.writestr("pic.png", b"1")
    raw = spark.createDataFrame([("/up/a.zip", pack.getvalue()), ("/up/bad.zip", b"no"), ("/up/b.md", b"# b")], "path string, content binary")
    opened = files.expand_archives(raw)
    assert {(r.name, r.error) for r in opened.collect()} == {("law.docx", None), ("note.txt", None), ("pic.png", "unsupported"), ("bad.zip", "broken archive"), ("b.md", None)}
    md = {r.name: r.markdown for r in files.to_markdown(opened).collect()}
    assert md["note.txt"] == "# note\n\nxin chào"
    assert md["law.docx"].split("\n\n") == ["# law", "## Chương I", "#### Điều 1. Phạm vi", "- mục", "| a | b |", "|---|---|", "| c |  |"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, numbering: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if numbering:
            z.writestr("word/numbering.xml", f"<w:numbering {W}>{numbering}</w:numbering>")
    return out.getvalue()


def item(text: str, num: str, level: int = 0) -> str:
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_list_numbers():
    def lvl(i, kind, text, start=1):
        return f'<w:lvl w:ilvl="{i}"><w:start w:val="{start}"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text}"/></w:lvl>'

    numbering = f'<w:abstractNum w:abstractNumId="7">{lvl(0, "upperRoman", "%1.")}{lvl(1, "lowerLetter", "%2)", 3)}{lvl(2, "decimal", "%1.%2.%3")}</w:abstractNum><w:abstractNum w:abstractNumId="8">{lvl(0, "bullet", "·")}</w:abstractNum>'
    numbering += '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num><w:num w:numId="3"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="4"/></w:lvlOverride></w:num>'
    body = item("a", "1") + item("b", "1", 1) + item("c", "1", 1) + item("d", "1", 2) + item("e", "1") + item("f", "1", 1) + item("g", "2") + item("h", "3") + item("i", "99") + item("j", "1", 2)
    assert files.docx_to_markdown(docx(body, numbering)).split("\n\n") == ["I. a", "c) b", "d) c", "I.d.1 d", "II. e", "c) f", "- g", "IV. h", "- i", "II.c.1 j"]
    assert [files.roman(n) for n in (1, 4, 9, 40, 99, 1994, 3999)] == ["I", "IV", "IX", "XL", "XCIX", "MCMXCIV", "MMMCMXCIX"]


def test_cells_and_runs():
    run = lambda t, b="": f"<w:r><w:rPr>{b}</w:rPr><w:t>{t}</w:t></w:r>"
    cell = lambda *ps: "<w:tc>" + "".join(f"<w:p>{p}</w:p>" for p in ps) + "</w:tc>"
    body = f'<w:tbl><w:tr>{cell(run("a|b"))}{cell(run("x"), run("y"))}</w:tr><w:tr>{cell("<w:r><w:t>1</w:t><w:br/><w:t>2</w:t></w:r>")}</w:tr></w:tbl><w:p>{run("plain ")}{run("bold", "<w:b/>")}{run(" on", "<w:b/>")}{run(" not", chr(60) + "w:b w:val=" + chr(34) + "0" + chr(34) + "/>")}</w:p>'
    assert files.docx_to_markdown(docx(body)).split("\n\n") == ["| a\\|b | x y |", "|---|---|", "| 1 2 |  |", "plain **bold on** not"]


def test_registry_and_checkpoint(spark, tmp_path):
    where = str(tmp_path / "reg")
    assert files.load_registry(spark, where).count() == 0
    rows = [(1, "b.md", "B", "2", "law", "2001-01-01", None, "who", "s"), (0, "a.md", None, None, None, None, "ff", None, None)]
    names = "ord int, file string, title string, doc_no string, doc_type string, effective_from string, sha256 string, approved_by string, reg_set string"
    files.save_registry(spark.createDataFrame(rows, names), where)
    assert [(r.ord, r.file, r.sha256) for r in files.load_registry(spark, where).orderBy("ord").collect()] == [(0, "a.md", "ff"), (1, "b.md", None)]
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    assert files.load_registry(spark, str(bad)).count() == 0
    lines = spark.createDataFrame([("d", 0, "x"), ("e", 0, "y")], "doc_id string, page_index int, text string")
    files.page_checkpoint(lines.limit(1), str(tmp_path / "pages"))
    assert files.page_checkpoint(lines.filter("doc_id = 'e'"), str(tmp_path / "pages")).count() == 2


def test_store_reset(spark, tmp_path):
    store = str(tmp_path / "store")
    a = spark.createDataFrame([("c1", "x"), ("c2", "y")], "chunk_id string, text string")
    corpus.reset(a, store)
    seen = spark.read.parquet(store)
    assert seen.count() == 2
    corpus.reset(a.limit(1), store)
    assert spark.read.parquet(store).count() == 1


def test_read_pages(spark):
    class Reader:
        def read(self, content):
            if content == b"broken":
                raise ValueError
            return [[("a", 1.0), ("b", 0.5)], [("c", 0.9)]]

    got = models.read_pages(spark.createDataFrame([("p", b"ok"), ("q", b"broken")], "path string, content binary"), Reader).collect()
    assert [(r.path, r.page_index, r.line_no, r.text) for r in got] == [("p", 0, 0, "a"), ("p", 0, 1, "b"), ("p", 1, 0, "c")]


def test_csv(spark, tmp_path):
    files.write_csv(spark.createDataFrame([(1, 'a "b", c')], "n int, t string"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()["t"] == 'a "b", c'


def test_check_sets(spark, tmp_path):
    for d, name in (("default", "One"), ("user", "Other")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "one.json").write_text(json.dumps({"id": "one", "display_name": name, "fields_catalog": {"a": {"label": "A", "value_type": "text"}}, "field_check_mode": {"always_check": ["b"]}}))
    (tmp_path / "user" / "broken.json").write_text("{")
    sets = files.check_sets(spark, str(tmp_path / "default"), str(tmp_path / "user"))
    assert {(r.id, r.display_name, r.error) for r in sets.collect()} == {("one", "One", False), ("broken", None, True)}
    assert [r.problem for r in files.check_set_problems(sets.filter("id = 'one'")).collect()] == ["required field is not in the catalog"]
    log = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([(1, "x")], "a int, b string"), log)
    (tmp_path / "log" / "extra.json").write_text('\n{"a": 2, "b": "y"}\n{broken\n')
    assert sorted(r.a for r in files.read_log(spark, log, "a int, b string").collect()) == [1, 2]


def test_models(spark):
    assert models.salvage('{"checks": [{"a": 1}, {"a": 2}, {"a": ') == [{"a": 1}, {"a": 2}]
    req = spark.createDataFrame([(1, json.dumps({"fields": ["a", "b"]}))], "doc_id long, request string")
    assert models.judge(req, models.EchoModel).count() == 2
    v = models.embed(spark.createDataFrame([("c", "hello world")], "chunk_id string, text string"), models.HashEmbedder).first()
    assert abs(sum(x * x for x in v.embedding) - 1) < 1e-9


def test_progress_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(1, "read", 1), (1, "read", 2), (1, "judge", 3), (1, "done", 4), (2, "read", 1)]
    (src / "a.json").write_text("\n".join(json.dumps({"pid": p, "stage": s, "ts": f"2024-01-01T00:00:0{t}"}) for p, s, t in rows))
    stream = progress.follow_log(spark, str(src), "pid long, stage string, ts timestamp")
    q = progress.progress_changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.pid, r.stage) for r in spark.table("changes").orderBy("pid", "ts").collect()]
    assert got == [(1, "read"), (1, "judge"), (1, "done"), (2, "read")]


def test_latest_states_of_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def put(name, rows):
        (src / name).write_text("\n".join(json.dumps({"pid": p, "stage": s, "ts": f"2024-01-01T00:{m:02d}:00"}) for p, s, m in rows))

    def run(checkpoint):
        stream = progress.follow_log(spark, str(src), "pid long, stage string, ts timestamp")
        progress.upsert_latest(stream, out, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)
        return {r.pid: r.stage for r in progress.latest_table(spark, out).collect()}

    put("a.json", [(1, "read", 1), (1, "judge", 3), (2, "read", 2), (3, "done", 9)])
    assert run("ck") == {1: "judge", 2: "read", 3: "done"}
    put("b.json", [(1, "read", 2), (2, "judge", 10)])
    assert run("ck") == {1: "judge", 2: "judge", 3: "done"}
    assert run("other") == {1: "judge", 2: "judge", 3: "done"}  # a new checkpoint reads all again and changes nothing
    assert {r.pid for r in progress.latest_table(spark, out, ttl_s=300).collect()} == {2}


def test_pages(spark):
    t = spark.createDataFrame([(1, 0, "", True), (1, 1, "HOP DONG", True), (1, 2, "x", False), (1, 3, "Chữ ký", True), (1, 4, "after", True)], "doc_id long, page_index int, text string, trusted boolean")
    assert [r.page_index for r in pages.page_window(t, ["hopdong"], ["chuky"]).orderBy("page_index").collect()] == [0, 1, 2, 3]
    assert pages.restrict(t, t.select("doc_id", "page_index")).count() == 5
    p = pages.read_plan(t).first()
    assert (p.text_pages, p.image_pages) == ([0, 1, 3, 4], [2])
    h = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"])], "top array<string>, bottom array<string>")
    assert pages.join_halves(h).first()["lines"] == ["a", "b", "c", "d"]
    r = spark.createDataFrame([('{"1": [0.9, 0.1, 0.2, 1.5], "2": [0.1, 0.1, 0.1, 0.9]}',)], "j string").select(pages.regions(F.col("j")).alias("r")).first()["r"]
    assert r == {"1": [0.2, 0.1, 0.9, 1.0]}


def test_chunks_keep_long_paragraphs(spark):
    d = spark.createDataFrame([(1, "a" * 30 + "\n\n" + "b" * 5 + "\n\n" + "c" * 4 + "\n\n"), (2, "")], "doc_id long, text string")
    got = [(r.chunk_index, r.text) for r in corpus.chunk_paragraphs(d, "\n\n", 12).orderBy("chunk_index").collect()]
    assert got == [(0, "a" * 30), (1, "bbbbb\n\ncccc")]


def test_relaxed_keeps_scope(spark):
    q = spark.createDataFrame([(1, "s", date(2020, 1, 1)), (2, "s", date(1990, 1, 1)), (3, "s", None), (4, "t", date(2020, 1, 1))], "query_id int, scope string, day date")
    c = spark.createDataFrame([("a", "s", date(2019, 1, 1), None), ("b", "s", date(2021, 1, 1), None), ("c", "u", date(2019, 1, 1), None)], "chunk_id string, scope string, effective_from date, effective_to date")
    got = {(r.query_id, r.chunk_id, r.in_force) for r in retrieval.relaxed_on(q, c, "scope").collect()}
    assert got == {(1, "a", True), (2, "a", False), (2, "b", False), (3, "a", True), (3, "b", True)}


def test_valid_on(spark):
    import datetime as dt

    d = lambda s: dt.date.fromisoformat(s) if s else None
    days = spark.createDataFrame([(d("2020-06-01"),), (d("1999-01-01"),), (None,)], "day date")
    chunks = spark.createDataFrame([("a", d("2019-01-01"), d("2020-05-31")), ("b", d("2018-01-01"), None), ("c", d("2020-06-01"), d("2020-06-01")), ("d", d("2021-01-01"), None)], "chunk_id string, effective_from date, effective_to date")
    got = {(str(r.day), r.chunk_id) for r in retrieval.valid_on(days, chunks).collect()}
    assert got == {("2020-06-01", "b"), ("2020-06-01", "c"), ("None", "a"), ("None", "b"), ("None", "c"), ("None", "d")}


def test_images(spark):
    import numpy as np

    from complyspark.sources import images

    page = np.full((100, 80, 3), 255, np.uint8)
    assert images.is_blank(page)
    page[20:22, 5:75] = 0
    page[60:62, 5:75] = 0
    page[80:90, 40:60] = (200, 20, 30)
    assert not images.is_blank(page) and images.axis_ratio(page) > 1
    assert (images.without_red(page)[80:90, 40:60] == 255).all()
    assert images.crop(page, (0.5, 0.0, 1.0, 0.5)).shape == (50, 40, 3) and images.crop(page, (0, 0, 0.01, 1)).shape == page.shape
    assert images.rotation(page, {180: 0.9, 0: 0.2}) == 180
    df = spark.createDataFrame([(1, 100, 80, bytearray(page.tobytes()))], "page_id long, height int, width int, pixels binary")
    assert images.page_facts(df).first().blank is False


def test_flow(spark):
    import datetime as dt

    from complyspark.plans import flow

    docs = spark.createDataFrame([(1, "Ngày ký: 01/02/2024\n2. Tiền lương: 5000 USD\n- Số lượng: 3 người\n- Địa điểm làm việc: Kho 1"), (2, None)], "doc_id long, text string")
    chunks = spark.createDataFrame([("c1", "tiền lương", dt.date(2020, 1, 1), None, "VN", "law", "0")], "chunk_id string, text string, effective_from date, effective_to date, jurisdiction string, doc_type string, reg_set string")
    checks, report = flow.check_dossiers(docs, chunks, flow.CHECK)
    got = {(r.doc_id, r.field_key): (r.verdict, r.mandatory) for r in checks.collect()}
    assert got[1, "people"] == ("PASS", False) and got[1, "place"] == ("DECLARATION", False)
    assert {k for k in got if k[0] == 2 and got[k] == ("NEEDS_SUPPLEMENT", True)} == {(2, "day"), (2, "wage"), (2, "people"), (2, "one_of_wage"), (2, "one_of_people")}
    assert {r.doc_id: r.overall_verdict for r in report.collect()}[2] == "NEEDS_SUPPLEMENT"


def test_free_names_against_plain_python(spark):
    """Names of linked stems, gaps between taken numbers, and a set that holds very many names of one beginning."""
    import random

    rnd = random.Random(3)
    taken = {"a", "a_3", "a_2_2", "b_2", "c", "c_2_2_3", "d_02", "e_1", "_2"} | {f"doc_{i}" for i in range(60_000)}
    stems = ["a", "a_2", "a_2_2", "a_2_2_2", "b", "b_2", "b_3", "c_2_2", "c", "d_0", "d", "e", "doc", "doc_7", "doc_9_2", "", "_2", "f_1", "f"]
    asked = [(k, stem, f"h{k}") for k, stem in enumerate(rnd.choice(stems) for _ in range(300))]
    used, want = set(taken), {}
    for k, stem, _ in asked:
        name, n = stem, 2
        while name in used:
            name, n = f"{stem}_{n}", n + 1
        used.add(name)
        want[k] = name
    registry = spark.createDataFrame([("r", f"x{i}", f) for i, f in enumerate(sorted(taken))], "reg_set string, sha256 string, file string")
    new = spark.createDataFrame([("s", h, stem, k) for k, stem, h in asked], "reg_set string, sha256 string, stem string, ord long")
    out = corpus.add_to_set(registry, new)
    assert out.columns == ["reg_set", "sha256", "stem", "ord", "file"]
    assert {r.ord: r.file for r in out.collect()} == want
