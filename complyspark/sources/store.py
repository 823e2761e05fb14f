"""A keyed table on files: upserts rewrite only the buckets that they touch, a manifest switches in one rename.

    <path>/data/<writer>/bucket=<n>/*.parquet    rows, never changed once written
    <path>/versions/<number>.json                which folder holds each bucket

A row's bucket is a hash of its key. A writer reads the touched buckets of the newest version, writes their new
contents beside them and then gives the next version its name by a rename that fails if the name is taken: a crash before it leaves the
old version as it was, and of two writers the later one starts anew on what the earlier one left. Readers
hold the version they opened; `vacuum` removes what no kept version names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer took the version."""


class Files:
    """The few calls on folders that the store needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> None:
        """The file `name` with `text`, whole or not at all; Conflict if it is there."""
        temporary = f"versions/_{uuid.uuid4().hex}"
        self.write(temporary, text)
        target = self.path(name)
        if self.fs.exists(target) or not self.fs.rename(self.path(temporary), target):
            self.fs.delete(self.path(temporary), False)
            raise Conflict(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedStore:
    """Rows of `schema` with one row a `key`; `deal` (part of the key) decides the bucket where rows of several keys belong together."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], buckets: int = 64, deal: tuple[str, ...] | None = None):
        self.spark, self.where, self.key, self.buckets, self.deal = spark, path, key, buckets, deal or key
        self.schema = T._parse_datatype_string(schema)
        self.files = Files(spark, path)

    # -- versions -----------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        if version is None:
            version = known[-1] if known else -1
        if version == -1:
            return {"version": -1, "buckets": self.buckets, "held": {}}
        if version not in known:
            raise ValueError(f"no version {version}")
        got = json.loads(self.files.text(f"versions/{version}.json"))
        if got["buckets"] != self.buckets:
            raise ValueError(f"the store has {got['buckets']} buckets")
        return got

    def _rows(self, held: dict[str, str]) -> DataFrame:
        """Rows of the named buckets: a scan of just their folders."""
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.where}/data/{folder}/bucket={b}" for b, folder in sorted(held.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version's rows, or those of an older one; later writers don't change what is read."""
        return self._rows(self._manifest(version)["held"])

    # -- writing ------------------------------------------------------------------------

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.deal), F.lit(self.buckets)).cast("int")

    def _change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame], tries: int) -> int:
        """Gives the buckets of `touched` the rows that `make` makes of theirs; the new version's number."""
        for attempt in range(tries):
            old = self._manifest(None)
            own = sorted(r[0] for r in touched.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`
            if not own:
                return old["version"]
            mine = {str(b) for b in own}
            rows = make(self._rows({b: f for b, f in old["held"].items() if b in mine}))
            writer = uuid.uuid4().hex
            out = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn("bucket", self._bucket())
            out.repartition(len(own), "bucket").write.partitionBy("bucket").parquet(f"{self.where}/data/{writer}")
            written = {n.removeprefix("bucket=") for n in self.files.names(f"data/{writer}") if n.startswith("bucket=")}
            held = {b: f for b, f in old["held"].items() if b not in mine} | dict.fromkeys(written, writer)
            try:
                self._switch(old["version"] + 1, held)
                return old["version"] + 1
            except Conflict:
                self.files.delete(f"data/{writer}")
                if attempt + 1 == tries:
                    raise
        raise Conflict(self.where)

    def _switch(self, version: int, held: dict[str, str]) -> None:
        self.files.claim(f"versions/{version}.json", json.dumps({"version": version, "buckets": self.buckets, "held": held}))

    def upsert(self, new: DataFrame, order: str | None = None, newest: bool = False, tries: int = 5) -> int:
        """Replaces rows of equal key and adds the others; of several new rows of one key the one with the greatest `order` (without:
        any one). With `newest` a stored row of greater `order` stays, so batches may come late or again. Null keys are keys like any other."""
        rank = F.struct(*([order] if order else []), *[c for c in new.columns if c != order])
        one = new.groupBy(*self.key).agg(F.max(rank).alias("r")).select("r.*").select(*self.schema.names) if self._comparable(new) else new.dropDuplicates(list(self.key))

        def make(old: DataFrame) -> DataFrame:
            if newest:
                return old.unionByName(one.select(old.columns)).groupBy(*self.key).agg(F.max(rank).alias("r")).select("r.*").select(*self.schema.names)
            n, o = one.alias("n"), old.alias("o")
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.key]
            cond = same[0]
            for s in same[1:]:
                cond = cond & s
            return o.join(n, cond, "left_anti").select("o.*").unionByName(one)

        return self._change(one, make, tries)

    def delete(self, keys: DataFrame, tries: int = 5) -> int:
        """Removes the rows of `keys` (the key's columns)."""

        def make(old: DataFrame) -> DataFrame:
            n, o = keys.select(*self.key).distinct().alias("n"), old.alias("o")
            cond = F.lit(True)
            for k in self.key:
                cond = cond & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
            return o.join(n, cond, "left_anti").select("o.*")

        return self._change(keys, make, tries)

    def reset(self, tries: int = 5) -> int:
        """An empty version; older ones stay until `vacuum`."""
        for attempt in range(tries):
            version = self._manifest(None)["version"] + 1
            try:
                self._switch(version, {})
                return version
            except Conflict:
                if attempt + 1 == tries:
                    raise
        raise Conflict(self.where)

    @staticmethod
    def _comparable(df: DataFrame) -> bool:
        return not any("map<" in t for _, t in df.dtypes)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all versions but the newest `keep`, and the folders that none of these names: also those
        of writers that never came to their rename, so no writer may be at work."""
        known = self.versions()
        for v in known[:-keep]:
            self.files.delete(f"versions/{v}.json")
        named = {f for v in known[-keep:] for f in self._manifest(v)["held"].values()}
        gone = [n for n in self.files.names("data") if n not in named]
        for n in gone:
            self.files.delete(f"data/{n}")
        for n in self.files.names("versions"):
            if n.startswith("_"):
                self.files.delete(f"versions/{n}")
        return gone
