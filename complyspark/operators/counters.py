"""Counters and stage times of a run, taken while its tables are written.

A counter is an aggregate of the rows that a write sees, observed in the same pass: no second job, no recount. Each write commits
a task's output once and reports the metrics of the attempt that it committed, so retried tasks don't count twice;
that holds for what is observed in the last stage of the write, which is where `counted` puts it."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Run:
    """Counters, seconds of each stage and of the whole, of one run."""

    def __init__(self) -> None:
        self.counters: Counter[str] = Counter()
        self.stages: dict[str, float] = {}
        self.began = time.perf_counter()
        self.seconds: float | None = None

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Adds a block's time to a stage, also where it fails. Plans are lazy: put the write that runs them inside."""
        t = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = round(self.stages.get(name, 0.0) + time.perf_counter() - t, 3)

    def bump(self, name: str, n: int = 1) -> None:
        self.counters[name] += n

    def written(self, df: DataFrame, path: str, **counters: Column) -> DataFrame:
        """Writes `df` as Parquet, adds up `counters` (conditions or numbers a row) on the way, and reads it back."""
        seen = Observation()
        sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counters.items()] or [F.count(F.lit(1)).alias("rows")]
        df.observe(seen, *sums).write.mode("overwrite").parquet(path)
        for name, n in seen.get.items():
            self.counters[name] += int(n or 0)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def done(self) -> dict:
        """What is known now: stages, counters that aren't zero, seconds."""
        self.seconds = round(time.perf_counter() - self.began, 3)
        return {"stages": dict(self.stages), "counters": {k: v for k, v in self.counters.items() if v}, "seconds": self.seconds}

    def rows(self, spark: SparkSession, run_id: str) -> DataFrame:
        """`run_id, kind, name, value`: the run as rows for the log's statistics."""
        got = self.done()
        rows = [(run_id, "stage", k, float(v)) for k, v in got["stages"].items()] + [(run_id, "counter", k, float(v)) for k, v in got["counters"].items()] + [(run_id, "seconds", "total", float(got["seconds"]))]
        return spark.createDataFrame(rows, "run_id string, kind string, name string, value double")
