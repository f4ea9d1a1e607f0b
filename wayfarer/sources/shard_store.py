"""Flat export rows kept by shard, so that a window that moves reads new days only.

A store is one parquet folder with a partition a shard.  A shard's rows are written by
overwriting its own partition; then a marker beside the table records the state of the
shard's files (their number, bytes and latest change).  A request reads from the export
only the shards in its window that have no marker, whose files have changed, or that
are intraday shards, which still grow.  A job that dies before the marker leaves the
shard to be read again.  Rows are one per (user, event name, timestamp) within a shard;
a request removes the copies among its shards, and keeps the same rows as a load of
all of them, since the smallest content hash wins either way.

An empty shard has a marker and no partition; a shard that is gone from the export is
not served.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.sources import ga_export as GX

SHARD = "shard"


class ShardStore:
    """The flat rows of one export (and one choice of event names) under ``root``."""

    def __init__(self, spark: SparkSession, root: str, base: str, event_names: list[str] | None = None):
        self.spark, self.base, self.event_names = spark, base, sorted(set(event_names or []))
        path = f"{root.rstrip('/')}/{re.sub(r'[^A-Za-z0-9_]', '_', base)}__shards"
        if self.event_names:
            path += f"__{hashlib.sha256(chr(31).join(self.event_names).encode()).hexdigest()[:16]}"
        self.path, self.markers = path, f"{path}/_markers"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.schema = GX.flatten_events(spark.createDataFrame([], GX.RAW_SCHEMA)).schema

    def _file_system(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def state(self, shard_path: str) -> str:
        """Number, bytes and latest change of a shard's files (a metadata listing)."""
        where, fs = self._file_system(shard_path)
        files, size, latest = 0, 0, 0
        found = fs.listFiles(where, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                files, size = files + 1, size + f.getLen()
                latest = max(latest, f.getModificationTime())
        return f"{files}-{size}-{latest}"

    def kept(self) -> dict[str, str]:
        """State at writing of every shard that is in the store."""
        where, fs = self._file_system(self.markers)
        if not fs.exists(where):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return dict(n.split("=", 1) for n in names if "=" in n)

    def _mark(self, shard: str, state: str | None) -> None:
        where, fs = self._file_system(self.markers)
        fs.mkdirs(where)
        for s in fs.listStatus(where):
            if s.getPath().getName().startswith(f"{shard}="):
                fs.delete(s.getPath(), False)
        if state is not None:
            fs.create(self._jvm.org.apache.hadoop.fs.Path(f"{self.markers}/{shard}={state}"), True).close()

    def refresh(self, shards: dict[str, str]) -> list[str]:
        """Read the given shards {name: path} anew where needed; returns the names read."""
        kept = self.kept()
        states = {name: self.state(path) for name, path in shards.items()}
        wanted = [n for n in shards if n.startswith("intraday_") or kept.get(n) != states[n]]
        if not wanted:
            return []
        for name in wanted:  # unmarked before its rows go: one that has none now has no partition either
            self._mark(name, None)
            where, fs = self._file_system(f"{self.path}/{SHARD}={name}")
            fs.delete(where, True)
        raw = self.spark.read.schema(GX.RAW_SCHEMA).parquet(*[shards[n] for n in wanted])
        raw = raw.withColumn(SHARD, GX.shard_suffix(F.col("_metadata.file_path")))
        if self.event_names:
            raw = raw.filter(F.col("event_name").isin(self.event_names))
        flat = GX.flatten_events(raw, SHARD)
        rows = GX.dedup_flat(flat, [*GX.FLAT_KEY, SHARD])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(self.path)
        for name in wanted:
            self._mark(name, states[name])
        return wanted

    def _partitions(self) -> set[str]:
        where, fs = self._file_system(self.path)
        if not fs.exists(where):
            return set()
        names = (s.getPath().getName() for s in fs.listStatus(where))
        return {n.split("=", 1)[1] for n in names if n.startswith(f"{SHARD}=")}

    def rows(self, shards: list[str]) -> DataFrame:
        """Flat rows of the shards, one per (user, event name, timestamp)."""
        if not self._partitions() & set(shards):
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField(SHARD, T.StringType())])
        flat = self.spark.read.schema(stored).option("basePath", self.path).parquet(self.path)
        return GX.dedup_flat(flat.filter(F.col(SHARD).isin(shards)).drop(SHARD))


def load_window(spark: SparkSession, base: str, root: str, as_of_date: dt.date, historical_days: int,
                include_intraday: bool = False, event_names: list[str] | None = None) -> DataFrame:
    """The rows of ``ga_export.load_export``, through the shard store under ``root``."""
    paths = GX.list_shards(spark, base, as_of_date, historical_days, include_intraday)
    shards = {p.rstrip("/").rsplit("events_", 1)[1]: p for p in paths}
    store = ShardStore(spark, root, base, event_names)
    store.refresh(shards)
    return store.rows(sorted(shards))
