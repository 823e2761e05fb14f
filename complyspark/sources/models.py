"""Interfaces of stages that need a model or a parser, with deterministic stand-ins.

Pictures, PDF text layers, embeddings, reranking and judging are done by whatever
implements these protocols; one instance serves a worker for all of its batches."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Model(Protocol):
    def chat(self, request: str) -> str: ...


class PageReader(Protocol):
    def read(self, content: bytes) -> list[list[tuple[str, float]]]: ...


class HashEmbedder:
    """Signed feature hashing of words, unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.size] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class EchoModel:
    """Answers every asked field with a verdict that depends on its request alone."""

    def chat(self, request: str) -> str:
        keys = json.loads(request).get("fields", [])
        pick = lambda k: ("PASS", "FAIL", "NEEDS_SUPPLEMENT")[hashlib.sha256(k.encode()).digest()[0] % 3]
        return json.dumps({"checks": [{"field_key": k, "verdict": pick(k)} for k in keys]})


def embed(rows: DataFrame, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """`chunk_id, embedding` of `chunk_id`, `text`."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                x = model.embed([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["chunk_id", "embedding"])

    return rows.select("chunk_id", "text").mapInArrow(f, "chunk_id string, embedding array<double>")


def salvage(reply: str) -> list[dict]:
    """The whole objects of the list in a reply that may be cut off."""
    try:
        got = json.loads(reply)
        return got.get("checks", []) if isinstance(got, dict) else []
    except json.JSONDecodeError:
        pass
    out, decoder, at = [], json.JSONDecoder(), reply.find("[")
    while (at := reply.find("{", at + 1)) > 0:
        try:
            item, end = decoder.raw_decode(reply, at)
        except json.JSONDecodeError:
            break
        out.append(item)
        at = end - 1
    return out


def judge(requests: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """`doc_id, ord, field_key, model_verdict` of `doc_id`, `request` (JSON)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            rows = [(i, n, str(c.get("field_key")), c.get("verdict")) for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, c in enumerate(salvage(model.chat(r)))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["doc_id", "ord", "field_key", "model_verdict"])

    return requests.select("doc_id", "request").mapInArrow(f, "doc_id long, ord int, field_key string, model_verdict string")


def read_pages(files: DataFrame, make: Callable[[], PageReader]) -> DataFrame:
    """`path, page_index, line_no, text, conf` of `path`, `content`; files that fail give no line."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(p, i, n, t, s) for i, page in enumerate(reader.read(c)) for n, (t, s) in enumerate(page)]
                except ValueError:
                    continue
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], names=["path", "page_index", "line_no", "text", "conf"])

    return files.select("path", "content").mapInArrow(f, "path string, page_index int, line_no int, text string, conf double")
