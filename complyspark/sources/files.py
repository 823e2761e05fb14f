"""Sources and sinks: JSON documents and logs, check sets, archives, office files, Markdown, CSV."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import HEADINGS

CHECK_SET = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("document_kind", T.StringType()),
        T.StructField("jurisdiction", T.StringType()),
        T.StructField("doc_types", T.ArrayType(T.StringType())),
        T.StructField("regulation_sets", T.ArrayType(T.StringType())),
        T.StructField("signed_date_field", T.StringType()),
        T.StructField(
            "fields_catalog",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField(n, T.StringType()) for n in ("label", "value_type", "check_type", "check_aspect", "value_regex", "section")] + [T.StructField("label_alts", T.ArrayType(T.StringType()))]),
            ),
        ),
        T.StructField("field_check_mode", T.StructType([T.StructField("always_check", T.ArrayType(T.StringType())), T.StructField("missing_is_fail", T.BooleanType()), T.StructField("required_one_of", T.ArrayType(T.ArrayType(T.StringType())))])),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents, one a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends with the file committer: a reader sees whole tasks' files or none."""
    rows.write.mode("append").json(path)


def check_sets(spark: SparkSession, default_path: str, user_path: str) -> DataFrame:
    """Check sets of both places; of equal ids the default one holds; broken files have `error`."""
    read = lambda p, n: read_json(spark, p, CHECK_SET).withColumn("priority", F.lit(n)).withColumn("file", F.input_file_name())
    both = read(default_path, 0).unionByName(read(user_path, 1))
    both = both.withColumn("id", F.coalesce("id", F.regexp_extract("file", r"([^/]+)\.json$", 1)))
    w = Window.partitionBy("id").orderBy("priority", "file")
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").withColumn("error", F.col("_corrupt_record").isNotNull())


def catalog(sets: DataFrame) -> DataFrame:
    """The fields of check sets, one a row."""
    return sets.select(F.col("id").alias("set_id"), F.explode("fields_catalog").alias("field_key", "f")).select("set_id", "field_key", "f.*")


def check_set_problems(sets: DataFrame) -> DataFrame:
    """`id, problem`: what is wrong with a check set."""
    types = F.transform(F.map_values("fields_catalog"), lambda f: f["value_type"])
    problems = F.filter(
        F.array(
            F.when(F.coalesce(F.btrim("display_name"), F.lit("")) == "", "no name"),
            F.when(~F.coalesce(F.rlike("id", F.lit(r"^[a-z0-9_-]{1,64}$")), F.lit(False)), "bad id"),
            F.when(F.coalesce(F.size("fields_catalog"), F.lit(0)) < 1, "no fields"),
            F.when(F.exists(types, lambda t: ~t.isin("text", "date", "number", "money")), "unknown value type"),
            F.when(F.size(F.array_except("field_check_mode.always_check", F.map_keys("fields_catalog"))) > 0, "required field is not in the catalog"),
        ),
        lambda x: x.isNotNull(),
    )
    return sets.select("id", F.explode(problems).alias("problem"))


def expand_archives(files: DataFrame, most_files: int = 50, most_bytes: int = 200 << 20) -> DataFrame:
    """`path, name, content, error` of uploaded files (`path`, `content`); archives are opened one
    level deep, base names only, within the given number and size."""

    def rows(path: str, content: bytes) -> Iterator[tuple[str, str, bytes | None, str | None]]:
        name = path.rsplit("/", 1)[-1]
        if not name.lower().endswith(".zip"):
            yield path, name, content, None
            return
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if len(infos) > most_files or sum(i.file_size for i in infos) > most_bytes:
                    yield path, name, None, "archive too large"
                    return
                for i in infos:
                    own = i.filename.rsplit("/", 1)[-1]
                    ok = own.lower().endswith((".pdf", ".docx", ".md", ".txt"))
                    yield path, own, z.read(i) if ok else None, None if ok else "unsupported"
        except zipfile.BadZipFile:
            yield path, name, None, "broken archive"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for r in rows(p, c):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]]), pa.array([r[2]], pa.binary()), pa.array([r[3]], pa.string())], names=["path", "name", "content", "error"])

    return files.select("path", "content").mapInArrow(f, "path string, name string, content binary, error string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def roman(n: int) -> str:
    out = ""
    for ten, (one, five, more) in zip((1000, 100, 10, 1), ("M  ", "CDM", "XLC", "IVX"), strict=True):
        d, n = divmod(n, ten) if ten == 1000 else (n // ten % 10, n)
        out += one * d if ten == 1000 or d < 4 else one + five if d == 4 else five + one * (d - 5) if d < 9 else one + more
    return out


COUNTED = {
    "decimal": str,
    "decimalZero": lambda n: f"{n:02d}",
    "lowerLetter": lambda n: chr(97 + (n - 1) % 26),
    "upperLetter": lambda n: chr(65 + (n - 1) % 26),
    "lowerRoman": lambda n: roman(n).lower(),
    "upperRoman": roman,
}


@dataclass(frozen=True)
class ListLevel:
    """How a level of a list counts: numbering format, text with %1 to %9 for the levels' numbers, first number."""

    kind: str = "decimal"
    text: str = ""
    start: int = 1


def _val(node: ElementTree.Element | None, name: str = "val") -> str:
    return node.get(f"{_W}{name}", "") if node is not None else ""


def list_levels(xml: bytes | None) -> dict[str, dict[int, ListLevel]]:
    """Levels of each list (`numId`) of a document's numbering.xml; overridden starts count."""
    if not xml:
        return {}
    root = ElementTree.fromstring(xml)

    def levels(of: ElementTree.Element) -> dict[int, ListLevel]:
        return {int(_val(x, "ilvl") or 0): ListLevel(_val(x.find(f"{_W}numFmt")) or "decimal", _val(x.find(f"{_W}lvlText")), int(_val(x.find(f"{_W}start")) or 1)) for x in of.iter(f"{_W}lvl")}

    patterns = {_val(x, "abstractNumId"): levels(x) for x in root.iter(f"{_W}abstractNum")}
    out = {}
    for num in root.iter(f"{_W}num"):
        own = dict(patterns.get(_val(num.find(f"{_W}abstractNumId")), {}))
        for o in num.iter(f"{_W}lvlOverride"):
            at, start = int(_val(o, "ilvl") or 0), _val(o.find(f"{_W}startOverride"))
            if start and at in own:
                own[at] = replace(own[at], start=int(start))
        out[_val(num, "numId")] = own
    return out


@dataclass
class ListNumbers:
    """Labels of a document's lists, item by item; an item ends the counts of deeper levels.
    Lists that numbering.xml doesn't have, bullets and unnumbered levels are dashes."""

    lists: dict[str, dict[int, ListLevel]] = field(default_factory=dict)
    seen: dict[str, dict[int, int]] = field(default_factory=dict)

    def label(self, list_id: str, level: int) -> str:
        levels = self.lists.get(list_id)
        if not levels or list_id == "0" or level not in levels or levels[level].kind in ("bullet", "none"):
            return "-"
        start = lambda k: levels[k].start if k in levels else 1
        upper = {k: n for k, n in self.seen.get(list_id, {}).items() if k < level}
        here = self.seen.get(list_id, {}).get(level)
        counts = self.seen[list_id] = {**{k: start(k) for k in range(level)}, **upper, level: start(level) if here is None else here + 1}

        def number(m: re.Match[str]) -> str:
            k = int(m[1]) - 1
            return COUNTED.get(levels[k].kind if k in levels else "decimal", str)(counts.get(k, 1))

        return re.sub(r"%([1-9])", number, levels[level].text or f"%{level + 1}.").strip() or "-"


def docx_to_markdown(content: bytes, title: str = "") -> str:
    """Paragraphs, headings, numbered lists and tables of an office document. A bar within a cell is escaped, its lines are joined."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        numbering = z.read("word/numbering.xml") if "word/numbering.xml" in z.namelist() else None
    numbers, out = ListNumbers(list_levels(numbering)), [f"# {title}"] if title else []

    def said(run: ElementTree.Element) -> str:
        marks = {f"{_W}br": "\n", f"{_W}tab": " "}
        return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in run)

    def text_of(p: ElementTree.Element) -> str:
        parts = []
        for r in p.iter(f"{_W}r"):
            bold = r.find(f"{_W}rPr/{_W}b")
            t = said(r)
            parts.append(f"**{t}**" if t.strip() and bold is not None and _val(bold).lower() not in ("0", "false", "off") else t)
        return "".join(parts).replace("****", "").strip()

    def cell(c: ElementTree.Element) -> str:
        return " ".join(t for t in map(text_of, c.iter(f"{_W}p")) if t).replace("|", "\\|").replace("\n", " ")

    def table(node: ElementTree.Element) -> list[str]:
        rows = [r for r in ([cell(c) for c in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")) if r]
        width = max(map(len, rows), default=0)
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return [*lines[:1], *(["|" + "---|" * width] if lines else []), *lines[1:]]

    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            out += table(node)
        elif node.tag == f"{_W}p" and (t := text_of(node)):
            plain = t.replace("**", "")
            level = next((n for n, rx in HEADINGS if re.match(rx, plain.lower())), 0)
            if not level and (g := re.search(r"(?i)heading\s*(\d)", _val(node.find(f"{_W}pPr/{_W}pStyle")))):
                level = min(6, int(g[1]))
            num = node.find(f"{_W}pPr/{_W}numPr")
            if num is not None and not level:
                t = numbers.label(_val(num.find(f"{_W}numId")), min(8, int(_val(num.find(f"{_W}ilvl")) or 0))) + " " + t
            out.append("#" * level + " " + plain if level else t)
    return "\n\n".join(out)


def to_markdown(files: DataFrame) -> DataFrame:
    """`name, markdown, error` of `name`, `content` by suffix; PDF needs a parser (see models)."""

    def one(name: str, content: bytes) -> tuple[str | None, str | None]:
        low, stem = name.lower(), name.rsplit(".", 1)[0]
        try:
            if low.endswith(".docx"):
                return docx_to_markdown(content, stem), None
            if low.endswith((".md", ".txt")):
                text = content.decode("utf-8-sig")
                return (f"# {stem}\n\n{text}" if low.endswith(".txt") else text), None
            return None, "unsupported"
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError) as e:
            return None, type(e).__name__

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(n, c) for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["name", "markdown", "error"])

    return files.filter(F.col("content").isNotNull()).select("name", "content").mapInArrow(f, "name string, markdown string, error string")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, blocks become lines."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|h[1-6]|li|tr|article|section|title)>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for code, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(code), F.lit(ch))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def valid_session(session_id: Column) -> Column:
    """Whether an id may be part of a path."""
    return F.rlike(session_id, F.lit(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))


def json_strings(rows: DataFrame) -> DataFrame:
    """Strings in any depth of JSON texts (`id`, `json`) that carry diacritics."""
    from ..operators.lexicon import has_diacritics

    # keys are matched too, with their colon, so that every quote is read in its place
    every = F.regexp_extract_all("json", F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), 0)
    values = F.transform(F.filter(every, lambda x: ~F.endswith(x, F.lit(":"))), lambda x: F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0])
    return rows.select("id", F.explode(values).alias("value")).filter(has_diacritics(F.col("value")))


def in_upload_order(files: DataFrame) -> DataFrame:
    """Files of a dossier (`dossier, ord, name, content`) as documents doc1, doc2, ... with their size in bytes."""
    n = F.row_number().over(Window.partitionBy("dossier").orderBy("ord", "name"))
    return files.withColumn("doc_id", F.concat(F.lit("doc"), n)).withColumn("size_bytes", F.length("content"))


def check_set_json(rows: DataFrame) -> DataFrame:
    """`set_id, json`: the rows of a form (`set_id, field_key, label, alts, value_type, check_type, required`) as a check
    set. Rows without a label go; alternatives are split at commas, semicolons and lines; required keys are always checked."""
    alts = F.filter(F.transform(F.split("alts", "[;,\n]"), lambda x: F.btrim(x)), lambda x: x != "")
    own = rows.filter(F.btrim("label") != "").select("set_id", "field_key", "required", F.struct(F.btrim("label").alias("label"), F.when(F.size(alts) > 0, alts).alias("label_alts"), "value_type", "check_type").alias("f"))
    entries = F.array_sort(F.collect_list(F.struct("field_key", "f")))
    always = F.array_sort(F.collect_list(F.when(F.col("required"), F.col("field_key"))))
    body = F.struct(F.map_from_entries(entries).alias("fields_catalog"), F.struct(always.alias("always_check")).alias("field_check_mode"))
    return own.groupBy("set_id").agg(F.to_json(body).alias("json"))


REGISTRY = "version int, entries array<struct<file: string, title: string, doc_no: string, doc_type: string, effective_from: string, sha256: string, approved_by: string, reg_set: string>>"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a registry file, with their place; a missing or broken one has none."""
    try:
        raw = spark.read.schema(REGISTRY).json(path, multiLine=True)
    except AnalysisException:
        raw = spark.createDataFrame([], REGISTRY)
    return raw.select(F.posexplode("entries").alias("ord", "e")).select("ord", "e.*")


def save_registry(entries: DataFrame, path: str) -> None:
    """A registry (a bounded list of documents) as one JSON file under `path`, replaced as a whole."""
    fields = [c for c in entries.columns if c != "ord"]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("e")))), lambda x: x["e"])
    entries.agg(F.lit(1).alias("version"), rows.alias("entries")).coalesce(1).write.mode("overwrite").json(path)


PLACE = ("doc_id", "page_index", "line_no")


def page_checkpoint(lines: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Lines of read pages (`doc_id`, `page_index`, `line_no` where a page has several, and what else) with those of the store at `path`: pages
    that it holds stay as they are, the others are added, in buckets of documents. Only the buckets of new pages are
    rewritten, and a writer that breaks off leaves the store as it was."""
    store = _pages_at(lines.sparkSession, path, buckets, ", ".join(f"`{n}` {t}" for n, t in lines.dtypes), tuple(c for c in PLACE if c in lines.columns))
    store.upsert(lines.join(store.read().select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti").select(lines.columns))
    return store.read()


def unread(pages: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """The pages (`doc_id, page_index`, and what else) that the store at `path` has no line of: what a restart has to read."""
    kinds = dict(pages.dtypes)
    held = _pages_at(pages.sparkSession, path, buckets, f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}", PLACE[:2]).read().distinct()
    return pages.join(held, ["doc_id", "page_index"], "left_anti")


def _pages_at(spark: SparkSession, path: str, buckets: int, schema: str, key: tuple[str, ...]):
    from .store import KeyedStore

    return KeyedStore(spark, path, schema, key, buckets, PLACE[:1])
