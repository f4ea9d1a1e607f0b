"""Stored intermediates and column-name helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wayfarer.storage import drop, left, store

__all__ = ["drop", "fresh", "left", "released", "store"]


def fresh(df_or_columns, *bases: str) -> list[str]:
    """Column names built from ``bases`` that clash with none of the frame's own."""
    columns = getattr(df_or_columns, "columns", df_or_columns)
    taken = {c.lower() for c in columns}
    names = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def released(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of frames that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
