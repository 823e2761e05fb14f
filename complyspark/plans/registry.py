"""Registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, corpus, dossiers, flow, more, records, retrieval, stores, text

_MODULES = (audit, text, corpus, retrieval, dossiers, flow, more, records, stores)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = audit.verdict_stats
