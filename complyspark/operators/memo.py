"""Answers kept from run to run: equal queries under an equal filter and an unchanged corpus are answered once.

A table keyed by the query, its filter and k, under the corpus fingerprint that it was answered with. What is
missing is found by an anti-join, answered and added; what was asked for is marked as used; only the newest
`most` keys stay. Another fingerprint makes all answers stale: they are dropped before anything is looked up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import KeyedStore

ANSWER = "array<struct<rank:int,chunk_id:string,distance:double>>"
SCHEMA = f"query string, filter string, k int, fingerprint string, used long, answer {ANSWER}"
KEY = ("query", "filter", "k")


class Memo:
    """`answer` gets distinct queries (`query`, `filter`, `k`) and gives their hits (these, `rank`, `chunk_id`, `distance`)."""

    def __init__(self, spark: SparkSession, path: str, answer: Callable[[DataFrame], DataFrame], most: int = 100_000, buckets: int = 32):
        self.spark, self.answer, self.most = spark, answer, most
        self.store = KeyedStore(spark, path, SCHEMA, KEY, buckets)

    def _fresh(self, fingerprint: str) -> DataFrame:
        return self.store.read().filter(F.col("fingerprint") == fingerprint)

    def prefetch(self, queries: DataFrame, fingerprint: str, now: int) -> int:
        """Makes sure that all `queries` have an answer; how many were missing. Nothing is asked where none is."""
        stale = self.store.read().filter(F.col("fingerprint") != fingerprint)
        if not stale.isEmpty():
            self.store.reset()
        asked = queries.select(*KEY).distinct()
        kept = self._fresh(fingerprint)
        missing = asked.join(kept.select(*KEY), list(KEY), "left_anti")
        hits = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("distance").cast("double").alias("distance"))))
        n = missing.count()
        used = kept.join(asked, list(KEY), "left_semi").withColumn("used", F.lit(now).cast("long"))
        if n:
            found = self.answer(missing).groupBy(*KEY).agg(hits.alias("answer"))
            # a query without a hit is answered too: with none
            new = missing.join(found, list(KEY), "left").select(*KEY, F.lit(fingerprint).alias("fingerprint"), F.lit(now).cast("long").alias("used"), F.coalesce("answer", F.expr(f"cast(array() as {ANSWER})")).alias("answer"))
            self.store.upsert(used.unionByName(new))
        elif not used.isEmpty():
            self.store.upsert(used)
        self._bound()
        return n

    def _bound(self) -> None:
        """Only the `most` keys used last stay: those beyond the used time of the last one kept go, ties by key."""
        rows = self.store.read()
        over = rows.count() - self.most
        if over <= 0:
            return
        oldest = rows.orderBy("used", *KEY).limit(over).select(*KEY)
        self.store.delete(oldest)

    def ask(self, queries: DataFrame, fingerprint: str, now: int) -> DataFrame:
        """`queries` with the hits of each: `rank`, `chunk_id`, `distance`; queries without one give no row."""
        self.prefetch(queries, fingerprint, now)
        kept = self._fresh(fingerprint).select(*KEY, F.explode("answer").alias("a"))
        return queries.join(kept, list(KEY)).select(*queries.columns, "a.rank", "a.chunk_id", "a.distance")

    def clear(self) -> None:
        self.store.reset()


