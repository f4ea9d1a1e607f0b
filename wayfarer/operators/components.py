"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) joined back to the
edges, so no node's neighbours are ever gathered and a hot node's edges can be
split by the adaptive skew join.  Every round's edges are written to the shared
folder; rounds go on until the edge set stays as it is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayfarer.storage import drop, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Relinks each node's neighbours to the smallest of them and itself.

    ``edges`` holds (u, v), u > v, each pair once.  The large star moves the
    greater neighbours, the small star the smaller ones and the node itself.
    """
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.groupBy("u").agg(F.min("v").alias("m")).unionAll(
            edges.select(F.col("v").alias("u"), F.col("v").alias("m")).distinct()).groupBy("u").agg(
            F.min("m").alias("m"))
        moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The stored edges, their path, and their number and checksum, taken while they are written."""
    seen = Observation()
    watched = edges.observe(seen, F.count("*").alias("n"), F.sum(
        F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    got, path = store(watched, "edges")
    return got, path, (seen.get["n"], seen.get["sum"])


def _united(edges: DataFrame) -> tuple[DataFrame, str]:
    """(u, v): every node but the smallest of its component, and that; few edges, in one task."""
    names = edges.columns

    def run(batches):
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for x, y in zip(*(batch.column(c).to_pylist() for c in names)):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if up:
            rows = [(x, find(x)) for x in up if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i in (0, 1)], names)

    return store(edges.coalesce(1).mapInArrow(run, edges.schema), "components")


def connected_components(edges: DataFrame, in_task: int = 0) -> tuple[DataFrame, str]:
    """(node, component) of every node with an edge but the smallest of its component.

    ``edges`` has two columns of ids of any ordered type; loops, repeats and
    either order are fine.  ``component`` is the smallest id reachable.  Up to
    ``in_task`` edges (of numbers or strings) are united in one task.  Returns (table,
    path of its stored copy).
    """
    a, b = edges.columns
    spark = edges.sparkSession
    ordered = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path, mark = _marked(ordered)
    if mark[0] <= in_task:
        got, united = _united(now)
        drop(spark, path)
        return got.select(F.col("u").alias("node"), F.col("v").alias("component")), united
    before = None
    while mark[0] and mark != before:
        before = mark
        newer, newer_path, mark = _marked(_star(_star(now, True), False))
        drop(spark, path)
        now, path = newer, newer_path
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")), path
