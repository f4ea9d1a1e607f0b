"""Stored intermediates: parquet tables under the shared checkpoint folder.

A stored table cuts lineage, survives lost executors and is read with column
pruning.  ``Scratch`` collects the tables of one computation and drops them
together; what is still there when the driver's Python ends is removed then.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfarer.session import ensure_checkpoint_dir

_LEFT: list[str] = []


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and read it back: (frame, path for ``drop``)."""
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _LEFT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def keep_until_exit(path: str) -> None:
    """Have a folder written by other means removed with the tables that are left."""
    _LEFT.append(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables through Hadoop's file system, wherever the folder is."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _LEFT:
            _LEFT.remove(path)


def left() -> list[str]:
    """Paths of the stored tables that are still there."""
    return list(_LEFT)


class Scratch:
    """The stored tables of one computation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        got, path = store(df, name)
        self.paths.append(path)
        return got

    def close(self) -> None:
        drop(self.spark, *self.paths)
        self.paths.clear()


@atexit.register
def _drop_rest() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _LEFT:
        try:
            drop(spark, *left())
        except Exception:  # noqa: BLE001 - the JVM may already be gone at exit
            pass
