"""Progress watched with timers: a row when a job's state changes, and an end when it is done, idle or unknown.

Keyed state with several timers a key (`transformWithState`): a watcher of a key gets every change; its watch ends
with the job (done, error), after `idle` without a change, or after `unknown` if the key never had a state.
A state itself is forgotten `ttl` after its last update, watched or not. Timers are never taken back: one
that fires looks whether its deadline still stands, so a late one does no harm."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import TERMINAL

OUT = "pid string, what string, stage string, info string, at timestamp"
STATE = "stage string, info string, updated long, watching boolean, since long, changed long"


@dataclass(frozen=True)
class Limits:
    """Seconds: a watch without a change, a watch of an unknown key, a state without an update."""

    idle: int = 1800
    unknown: int = 120
    ttl: int = 3600


@dataclass
class _Job:
    """What is known of a key; times in milliseconds. `updated` is -1 where no state ever came."""

    stage: str | None = None
    info: str | None = None
    updated: int = -1
    watching: bool = False
    since: int = 0
    changed: int = 0

    def row(self) -> tuple:
        return (self.stage, self.info, self.updated, self.watching, self.since, self.changed)


class Watch(StatefulProcessor):
    """`kind` of an input row is `watch` (someone looks at the key) or `state` (stage and info of the job)."""

    def __init__(self, limits: Limits, event_time: bool):
        self.limits, self.event_time = limits, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def close(self) -> None:
        pass

    def _load(self) -> _Job:
        return _Job(*self.state.get()) if self.state.exists() else _Job()

    def _emit(self, key: str, what: str, job: _Job, at: int) -> dict[str, Any]:
        return {"pid": key, "what": what, "stage": job.stage, "info": job.info, "at": pd.Timestamp(at, unit="ms")}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        job, out, pid = self._load(), [], key[0]
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        every = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for kind, stage, info, ts in every[["kind", "stage", "info", "ts"]].itertuples(index=False):
            at = int(ts.timestamp() * 1000) if now is None else now
            if kind == "watch":
                if not job.watching:
                    job.watching, job.since, job.changed = True, at, at
                    self.handle.registerTimer(at + self.limits.unknown * 1000)
                    self.handle.registerTimer(at + self.limits.idle * 1000)
                    if job.updated >= 0:
                        out += self._changed(pid, job, at)
                continue
            same = (job.stage, job.info) == (stage, info) and job.updated >= 0
            job.stage, job.info, job.updated = stage, info, at
            self.handle.registerTimer(at + self.limits.ttl * 1000)
            if job.watching and not same:
                out += self._changed(pid, job, at)
                if job.watching:
                    self.handle.registerTimer(at + self.limits.idle * 1000)
        self.state.update(job.row())
        if out:
            yield pd.DataFrame(out)

    def _changed(self, pid: str, job: _Job, at: int) -> list[dict[str, Any]]:
        job.changed = at
        out = [self._emit(pid, "change", job, at)]
        if job.stage in TERMINAL:
            job.watching = False
            out.append(self._emit(pid, "ended", job, at))
        return out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        job, at, out = self._load(), expiredTimerInfo.getExpiryTimeInMs(), []
        if job.watching and job.updated < 0 and at >= job.since + self.limits.unknown * 1000:
            job.watching = False
            out.append(self._emit(key[0], "unknown", job, at))
        elif job.watching and at >= job.changed + self.limits.idle * 1000:
            job.watching = False
            out.append(self._emit(key[0], "idle", job, at))
        if job.updated >= 0 and at >= job.updated + self.limits.ttl * 1000:
            job = _Job(watching=job.watching, since=job.since, changed=job.changed)
        if job == _Job(since=job.since, changed=job.changed):
            self.state.clear()
        else:
            self.state.update(job.row())
        if out:
            yield pd.DataFrame(out)


def watch(events: DataFrame, limits: Limits | None = None, late: str | None = None) -> DataFrame:
    """Stream: `pid, what, stage, info, at` for `events` (`pid` string, `kind`, `stage`, `info`, `ts`); what is change, ended, idle
    or unknown. With `late`, the log's own times run the clock (a watermark that far behind them), so any key's rows move
    it; without, the time of the batch does. The session's state store provider must be RocksDB's."""
    e = events.select(F.col("pid").cast("string").alias("pid"), "kind", "stage", "info", "ts").filter("pid is not null")
    if late is not None:
        e = e.withWatermark("ts", late)
    return e.groupBy("pid").transformWithStateInPandas(
        statefulProcessor=Watch(limits or Limits(), late is not None), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if late is None else "EventTime"
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
"""For spark.sql.streaming.stateStore.providerClass."""
