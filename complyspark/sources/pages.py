"""Pages of large documents as a data source: a partition is a range of pages of one file, not a file.

What can open a document is behind a protocol (count its pages, read some of them), named by the option `reader`; each task
opens the file and reads its own range. Filters on `page_index` prune ranges before any task starts; files over the
cap of pages, or that can't be opened, give one row with `error` and no page."""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from typing import Any, Protocol

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.text import junk_ratio
from ..operators.pages import trusted

SCHEMA = "path string, page_index int, lines array<struct<text: string, conf: double>>, error string"


class RangeReader(Protocol):
    def count(self, content: bytes) -> int: ...

    def read(self, content: bytes, first: int, last: int) -> list[list[tuple[str, float]]]: ...


class FormFeedReader:
    """Stand-in: a UTF-8 text whose pages end at form feeds, a line of it with confidence 1."""

    def _pages(self, content: bytes) -> list[str]:
        if content.startswith(b"%LOCKED"):
            raise ValueError("the file is locked")
        return content.decode().split("\f")

    def count(self, content: bytes) -> int:
        return len(self._pages(content))

    def read(self, content: bytes, first: int, last: int) -> list[list[tuple[str, float]]]:
        return [[(" ".join(t.split()), 1.0) for t in p.split("\n") if t.strip()] for p in self._pages(content)[first : last + 1]]


class Pages(InputPartition):
    def __init__(self, file: str, first: int, last: int, error: str | None = None):
        super().__init__((file, first, last))
        self.file, self.first, self.last, self.error = file, first, last, error


def _loaded(name: str) -> RangeReader:
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)()


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.reader = options.get("reader", "complyspark.sources.pages:FormFeedReader")
        self.most = int(options.get("maxpages", "500"))
        self.step = int(options.get("pagespertask", "20"))
        self.low, self.high, self.only = 0, 2**31 - 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("page_index",):
                if isinstance(f, EqualTo):
                    self._among({f.value})
                elif isinstance(f, In):
                    self._among(set(f.value))
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, f.value - 1)
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, f.value)
            yield f  # Spark holds the rows against them too: rows of errors have no page

    def _among(self, pages: set[Any]) -> None:
        self.only = pages if self.only is None else self.only & pages

    def _wanted(self, first: int, last: int) -> bool:
        return first <= self.high and last >= self.low and (self.only is None or any(p is not None and first <= p <= last for p in self.only))

    def partitions(self) -> list[Pages]:
        fs, root = _opened(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file]
        reader, out = _loaded(self.reader), []
        for f in sorted(files, key=lambda i: i.path):
            try:
                with fs.open_input_file(f.path) as h:
                    n = reader.count(h.read())
            except ValueError as e:
                out.append(Pages(f.path, 0, -1, str(e)))
                continue
            if n > self.most:
                out.append(Pages(f.path, 0, -1, f"{n} pages, {self.most} at most"))
                continue
            out += [Pages(f.path, i, min(i + self.step, n) - 1) for i in range(0, n, self.step) if self._wanted(i, min(i + self.step, n) - 1)]
        return out or [Pages("", 0, -1)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        if partition.error is not None:
            yield partition.file, None, None, partition.error
            return
        if not partition.file:
            return
        fs, _ = _opened(self.path)
        with fs.open_input_file(partition.file) as h:
            content = h.read()
        reader = _loaded(self.reader)
        first, last = max(partition.first, self.low), min(partition.last, self.high)
        for k, lines in enumerate(reader.read(content, first, last)):
            if self.only is None or first + k in self.only:
                yield partition.file, first + k, [(t, float(c)) for t, c in lines], None


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, path: str, reader: str = "complyspark.sources.pages:FormFeedReader", most: int = 500, per_task: int = 20) -> DataFrame:
    """`path, page_index, lines, error` of all files under `path`. Sets spark.sql.python.filterPushdown.enabled in the session, so that filters on
    the page prune ranges."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").option("path", path).option("reader", reader).option("maxPages", most).option("pagesPerTask", per_task).load()


def with_quality(pages: DataFrame) -> DataFrame:
    """Pages with `text`, `chars` (without white space) and `usable`: enough text, little junk."""
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    rows = pages.filter("page_index is not null").withColumn("text", text)
    chars = F.length(F.regexp_replace("text", r"\s+", ""))
    return rows.withColumn("chars", chars).withColumn("usable", trusted(F.col("chars"), junk_ratio(F.col("text"))))


def read_documents(pages: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, statistics) of documents: `path, page_index, source, line_no, text`, and a row a file with `pages, from_text, ocred, skipped, error`.

    A page without usable text is read from its image where `images` (`path`, `page_index`, `lines`) has it, else skipped: `skipped` lists
    such pages from 1. A file without any line of text has an error and no lines, as one that can't be opened."""
    own = with_quality(pages).select("path", "page_index", "lines", "usable")
    if images is None:
        read = own.withColumn("image", F.lit(None).cast("array<struct<text:string,conf:double>>"))
    else:
        read = own.join(images.select("path", "page_index", F.col("lines").alias("image")), ["path", "page_index"], "left")
    source = F.when(F.col("usable"), "text").when(F.col("image").isNotNull(), "image")
    read = read.withColumn("source", source).withColumn("lines", F.when(F.col("source") == "text", F.col("lines")).otherwise(F.col("image")))
    written = F.exists("lines", lambda x: F.btrim(x["text"]) != "")
    stats = read.groupBy("path").agg(
        F.count("*").alias("pages"),
        F.count_if("usable").alias("from_text"),
        F.count_if(F.col("source") == "image").alias("ocred"),
        F.array_sort(F.collect_list(F.when(F.col("source").isNull(), F.col("page_index") + 1))).alias("skipped"),
        F.when(~F.coalesce(F.bool_or(F.col("source").isNotNull() & written), F.lit(False)), "no readable text").alias("error"),
    )
    bad = pages.filter("error is not null").select("path", F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("from_text"), F.lit(0).cast("long").alias("ocred"), F.array().cast("array<int>").alias("skipped"), "error")
    stats = stats.unionByName(bad)
    lines = read.filter("source is not null").select("path", "page_index", "source", F.posexplode("lines").alias("line_no", "l")).select("path", "page_index", "source", "line_no", F.col("l.text").alias("text"))
    return lines.join(stats.filter("error is not null").select("path"), "path", "left_anti"), stats
