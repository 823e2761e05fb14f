"""Streams: progress of jobs, windows over the run log, assembly of model replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import KeyedStore

TERMINAL = ("done", "error")
TTL_MS = 3_600_000


def latest_state(events: DataFrame) -> DataFrame:
    """Batch: the last stage of each key, by time, then by arrival."""
    o = F.struct("ts", "event_id")
    return events.groupBy("pid").agg(F.max_by("stage", o).alias("stage"), F.max("ts").alias("ts"), F.count("*").alias("updates"))


def active_jobs(state: DataFrame, now: F.Column, max_age_s: int) -> DataFrame:
    """How many keys are neither ended nor stale."""
    fresh = F.unix_timestamp(now) - F.unix_timestamp("ts") <= max_age_s
    return state.agg(F.count_if(~F.col("stage").isin(*TERMINAL) & fresh).alias("active"), F.count("*").alias("known"))


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    rows = []
    for pdf in batches:
        for stage, ts in pdf.sort_values("ts")[["stage", "ts"]].itertuples(index=False):
            if stage != last:
                rows.append((key[0], stage, ts))
                last = stage
    if last in TERMINAL:
        if state.exists:
            state.remove()
    else:
        state.update((last,))
        state.setTimeoutDuration(TTL_MS)
    if rows:
        yield pd.DataFrame(rows, columns=["pid", "stage", "ts"])


def progress_changes(events: DataFrame) -> DataFrame:
    """Stream: a row only when a key's stage changes; a key's state ends with its job or after an idle hour."""
    return events.select("pid", "stage", "ts").groupBy("pid").applyInPandasWithState(_changes, "pid long, stage string, ts timestamp", "stage string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and kind; with `late`, a watermark for streams."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", length).alias("w"), "stage").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "stage", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of events of a key without a gap."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("pid", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("pid", F.col("w.start").alias("start"), "n")


def follow_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream: new lines of a JSON-lines folder."""
    return spark.readStream.schema(schema).json(path)


LATEST = "pid long, ts timestamp, stage string"
LATEST_BUCKETS = 16


def _latest(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, LATEST, ("pid",), LATEST_BUCKETS)


def upsert_latest(events: DataFrame, path: str, checkpoint: str, keep: int = 3):
    """Stream sink: the last state of each key in a keyed store. A batch rewrites the buckets of its own keys; one that runs again, or that comes with
    older states, changes nothing. The newest `keep` versions stay, so readers of the last ones aren't disturbed. One sink a store may run."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store = _latest(batch.sparkSession, path)
        store.upsert(batch.select("pid", "ts", "stage"), order="ts", newest=True)
        if batch_id % 20 == 19:
            store.vacuum(keep)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def latest_table(spark: SparkSession, path: str, ttl_s: int | None = None) -> DataFrame:
    """The last state of each key of `upsert_latest`; with `ttl_s`, without ended keys and those
    that have been silent so much longer than the latest one."""
    now = _latest(spark, path).read()
    if ttl_s is None:
        return now
    last = now.agg(F.max("ts").alias("last"))
    fresh = F.unix_timestamp("last") - F.unix_timestamp("ts") <= ttl_s
    return now.crossJoin(F.broadcast(last)).filter(fresh & ~F.col("stage").isin(*TERMINAL)).drop("last")  # one row


def assemble_replies(chunks: DataFrame) -> DataFrame:
    """Ordered pieces of replies (`conv_id, turn, text`) as one text, with the last piece's size."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n")
    return chunks.groupBy("conv_id").agg(F.count("*").alias("pieces"), F.sha2(whole, 256).alias("sha256"), F.max_by(F.length("text"), "turn").alias("last_length"))


def day_cutoff(runs: DataFrame, today: F.Column, days: int) -> DataFrame:
    """Runs of the last days, by the day part of their ISO time."""
    return runs.filter(F.substring("ts", 1, 10) >= F.date_format(F.date_sub(today, days - 1), "yyyy-MM-dd"))
