"""The log of check runs as a data source: whole batches appear at once, a batch that runs again appears once.

    <path>/staged/<writer>/<task>.jsonl    lines of a task, before and after the commit
    <path>/batches/<batch>.json            the files of a batch: its name is taken just once

A task writes its lines to a file of its own and reports it; the driver's commit names the reported files in one
small file, made by a rename. So a failed task, or an attempt that lost, leaves nothing that a reader sees, and a batch whose
name is there already leaves the log as it is. Readers take the files of all batches, one task each, and
of runs with one id the first by batch.

Paths are whatever pyarrow.fs understands (a plain path, file://, hdfs://, s3://, ...)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "run_id string, batch string, line string"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, root.rstrip("/")


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class File(InputPartition):
    def __init__(self, file: str, batch: str):
        super().__init__(file)
        self.file, self.batch = file, batch


class _Writer(DataSourceWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch, self.writer = path, batch, uuid.uuid4().hex

    def write(self, iterator: Iterator[Any]) -> Staged:
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/staged/{self.writer}")
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{root}/staged/{self.writer}/{name}") as out:
            for row in iterator:
                out.write(json.dumps({"run_id": row["run_id"], "line": row["line"]}, ensure_ascii=False).encode() + b"\n")
                n += 1
        return Staged(name, n)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = _at(self.path)
        target = f"{root}/batches/{self.batch}.json"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            self.abort(messages)  # this batch is in the log already
            return
        fs.create_dir(f"{root}/batches")
        files = [m.file for m in messages if m is not None and m.rows]
        draft = f"{root}/batches/_{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"writer": self.writer, "files": files}).encode())
        fs.move(draft, target)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = _at(self.path)
        if fs.get_file_info(f"{root}/staged/{self.writer}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/staged/{self.writer}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        fs, root = _at(self.path)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/batches", allow_not_found=True))
        out = []
        for info in sorted(found, key=lambda i: i.base_name):
            if info.base_name.endswith(".json"):
                with fs.open_input_stream(info.path) as f:
                    batch = json.loads(f.read())
                out += [File(f"{batch['writer']}/{name}", info.base_name[:-5]) for name in batch["files"]]
        return out or [File("", "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.file:
            return
        fs, root = _at(self.path)
        with fs.open_input_stream(f"{root}/staged/{partition.file}") as f:
            for raw in f.read().splitlines():
                try:
                    row = json.loads(raw)
                except ValueError:
                    continue
                yield row.get("run_id"), partition.batch, row.get("line")


class RunLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is appended to")
        return _Writer(self.options["path"], self.options.get("batch") or uuid.uuid4().hex)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunLog)


RUN = (
    "session_id string, field_set_id string, field_set_name string, signed_date string, source_files array<string>, total_bytes long, total_pages long, ocr_seconds double, corpus_fingerprint string, "
    "documents array<struct<doc_id: string, source_file: string, overall_verdict: string, num_fail: int>>"
)


def run_lines(runs: DataFrame, now: Column) -> DataFrame:
    """`run_id, line` for the log: a JSON line a run. `runs`: run_id, session_id, what is known of the run (columns of RUN), and `documents` with
    their `checks` (an array of structs with `verdict`); the failed ones are counted, the checks don't go into the log."""
    have = set(runs.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)

    def slim(d: Column) -> Column:
        fails = F.size(F.filter(F.coalesce(d["checks"], F.array()), lambda c: c["verdict"] == "FAIL"))
        return F.struct(d["doc_id"].alias("doc_id"), F.coalesce(d["source_file"], F.lit("")).alias("source_file"), F.coalesce(d["overall_verdict"], F.lit("NEEDS_SUPPLEMENT")).alias("overall_verdict"), fails.alias("num_fail"))

    documents = F.transform(F.coalesce("documents", F.expr("array()")), slim)
    files = F.coalesce("source_files", F.array().cast("array<string>")) if "source_files" in have else F.array().cast("array<string>")
    line = F.struct(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"), *[text(c).alias(c) for c in ("session_id", "field_set_id", "field_set_name", "signed_date")], files.alias("source_files"), F.size(documents).alias("num_documents"),
        number("total_bytes").cast("long").alias("total_bytes"), number("total_pages").cast("long").alias("total_pages"), F.round(number("ocr_seconds").cast("double"), 1).alias("ocr_seconds"), text("corpus_fingerprint").alias("corpus_fingerprint"), documents.alias("documents"),
    )
    return runs.select("run_id", F.to_json(line).alias("line"))


def append(lines: DataFrame, path: str, batch: str) -> None:
    """Adds `run_id, line` to the log at `path` as the batch of that name; nothing if it is there."""
    register(lines.sparkSession)
    lines.select("run_id", F.lit(None).cast("string").alias("batch"), "line").write.format("runlog").mode("append").option("path", path).option("batch", batch).save()


def read(spark: SparkSession, path: str, schema: str = f"ts string, num_documents int, {RUN}") -> DataFrame:
    """Runs of the log, each run id once (of the first batch that has it; runs without an id all)."""
    register(spark)
    rows = spark.read.format("runlog").option("path", path).load()
    w = Window.partitionBy("run_id").orderBy("batch", "line")
    known = rows.filter("run_id is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    every = known.unionByName(rows.filter("run_id is null"))
    return every.select("run_id", "batch", F.from_json("line", schema).alias("r")).select("run_id", "batch", "r.*")
