"""Distinct points of a vector column, nested grid cells over them, and neighbours within a radius.

Cells of one level have sides half as long as those of the next: a cell is a list of
whole numbers, and its parent's are those shifted right by one bit.  Points within a
cell's side of each other lie in cells that touch, so near pairs are an equi join of
cells with the touching ones; which cells touch is found among occupied cells first,
so a point is copied only to cells that hold something.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.vectors import as_array

#: Levels of the grid: the finest cell is this many halvings of the data's extent.
HALVINGS = 20
#: The starting level holds at most this many pairs a point within its cells; a cell has
#: up to 3 ** width touching ones, so the pairs looked at are that many times more.
PAIRS = 4
#: Queries that a task starts from, about: what is looked at goes far beyond what is read.
QUERIES = 2_000
#: So many pairs are compared without looking for a better level.
FEW_PAIRS = 1_000_000


def clean_vector(vec_col: str) -> F.Column:
    """The vector as an array of doubles; null where it is null or an entry is null or not finite."""
    v = F.transform(F.when(F.col(vec_col).isNotNull(), as_array(vec_col)), lambda x: x + F.lit(0.0))  # no negative zero
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, v)


def distinct_points(vectors: DataFrame, store: Callable) -> DataFrame:
    """(id, v, weight) of the distinct vectors of column ``v``; nulls are left out.

    ids follow the vectors' order, however the rows are dealt out.
    """
    grouped = vectors.filter(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("weight"))
    return store(grouped.orderBy("v").select(F.monotonically_increasing_id().alias("id"), "v", "weight"), "points")


def distance(a: str, b: str, width: int) -> F.Column:
    """Euclidean distance of two array columns, entries summed in order."""
    total = F.lit(0.0)
    for i in range(width):
        gap = F.col(a)[i] - F.col(b)[i]
        total = total + gap * gap
    return F.sqrt(total)


def at_level(cell: str, level: int) -> F.Column:
    return F.transform(cell, lambda x: F.shiftright(x, level)) if level else F.col(cell)


def spread(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """``df`` of ``n`` rows dealt out by ``key``: few rows that meet many others are no single task's."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(most, n // QUERIES + 1), key)


def join_large(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the points: both are dealt out, none goes whole through the driver.

    Left to its estimates Spark would broadcast one: it takes a stored table for as large
    as its compressed files, and exploded rows for as few as the arrays they come from.
    """
    return left.join(right.hint("merge"), on, how)


class Grid:
    """``points`` with a column ``cell`` of the finest level; sides are ``side * 2**level``."""

    def __init__(self, points: DataFrame, store: Callable, radius: float | None = None):
        """With a ``radius`` the finest side is that; otherwise a small part of the extent."""
        self.width = points.select(F.max(F.size("v"))).head()[0] or 0
        if radius is None:
            ends = points.agg(*[f(F.col("v")[i]) for i in range(self.width) for f in (F.min, F.max)]).head()
            extent = max((ends[2 * i + 1] - ends[2 * i] for i in range(self.width)), default=0.0)
            top = max((abs(e) for e in ends), default=0.0)
            # Cell numbers stay exact in doubles even far from the origin.
            radius = max(extent * 2.0 ** -HALVINGS, top * 2.0 ** -45) or 1.0
        self.side, self.store = radius, store
        self.points = points.withColumn(
            "cell", F.transform("v", lambda x: F.floor(x / F.lit(radius)).cast("long")))

    def side_at(self, level: int) -> float:
        return self.side * 2.0 ** level

    def starting_level(self, n: int) -> int:
        """The coarsest level whose cells hold at most ``PAIRS * n`` pairs, from finest counts rolled up."""
        if n * n <= FEW_PAIRS:
            return HALVINGS
        counts = self.points.groupBy("cell").agg(F.count("*").alias("n"))
        for level in range(HALVINGS + 1):
            counts = self.store(counts, "cell-counts")
            pairs = counts.agg(F.sum(F.col("n").cast("double") * F.col("n"))).head()[0] or 0
            if pairs > max(PAIRS * n, FEW_PAIRS):
                return max(level - 1, 0)
            counts = counts.groupBy(at_level("cell", 1).alias("cell")).agg(F.sum("n").alias("n"))
        return HALVINGS

    def touching(self, cells: DataFrame, others: DataFrame) -> DataFrame:
        """(cell, other): occupied cells that touch, each itself included."""
        steps = F.array(*[F.array(*[F.lit(o).cast("long") for o in offset])
                          for offset in itertools.product((-1, 0, 1), repeat=self.width)])
        near = cells.select("cell", F.explode(F.transform(
            steps, lambda o: F.zip_with("cell", o, lambda a, b: a + b))).alias("other"))
        return join_large(near, others.select(F.col("cell").alias("other")), "other").select("cell", "other")

    def near_pairs(self, queries: DataFrame, level: int) -> DataFrame:
        """(id, v, weight, other, u, w2): each query with all points of the cells that touch its own."""
        asked = spread(queries, queries.count()).withColumn("cell", at_level("cell", level))
        there = self.points.select(F.col("id").alias("other"), F.col("v").alias("u"),
                                   F.col("weight").alias("other_weight"), at_level("cell", level).alias("in"))
        pairs = self.touching(asked.select("cell").distinct(), there.select(F.col("in").alias("cell")).distinct())
        asked = join_large(asked, pairs.withColumnRenamed("other", "in"), "cell")
        return join_large(asked, there, "in").drop("cell", "in")


def core_distances(grid: Grid, k: int, start: int) -> DataFrame:
    """(id, core): distance of each point to its ``k``-th nearest other point, infinite with fewer.

    Points that have ``k`` others within a cell's side are done; the rest goes on
    with cells of twice the side, so only lonely points meet large cells.
    """
    store = grid.store
    rest, level, done = store(grid.points.select("id", "v", "cell"), "queries"), start, None
    n = grid.points.count()
    k_or_less = min(k, n - 1)
    while True:
        side = grid.side_at(level)
        d = distance("v", "u", grid.width)
        near = grid.near_pairs(rest, level).withColumn("d", d).filter(
            (F.col("id") != F.col("other")) & (F.col("d") <= side))
        # Distances within a side only: at the start few a point, later only lonely points ask.
        found = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("near"))
        got = store(join_large(rest, found, "id", "left").withColumn("near", F.coalesce("near", F.array())), "neighbours")
        now = got.filter(F.size("near") >= k_or_less).select("id", F.when(
            F.size("near") >= k, F.col("near")[k - 1]).otherwise(float("inf")).alias("core")) if k_or_less \
            else got.select("id", F.lit(float("inf")).alias("core"))
        done = now if done is None else done.unionByName(now)
        rest = store(got.filter(F.size("near") < k_or_less).select("id", "v", "cell"), "queries")
        if not k_or_less or rest.isEmpty():
            return store(done, "core-distances")
        level += 1


def nearest(grid: Grid, queries: DataFrame, start: int) -> DataFrame:
    """(id, other): the grid's point nearest to each query (id, v); of equally near ones the smallest id.

    Queries with a point within a cell's side are done, the rest goes on with cells of
    twice the side.  The grid must hold a point.
    """
    store = grid.store
    rest = store(queries.select("id", "v", F.transform(
        "v", lambda x: F.floor(x / F.lit(grid.side)).cast("long")).alias("cell")), "queries")
    done, level = None, start
    while not rest.isEmpty():
        d = distance("v", "u", grid.width)
        near = grid.near_pairs(rest, level).withColumn("d", d).filter(F.col("d") <= grid.side_at(level))
        found = store(near.groupBy("id").agg(F.min(F.struct("d", "other")).alias("n")).select("id", "n.other"), "nearest")
        done = found if done is None else done.unionByName(found)
        rest = store(join_large(rest, found, "id", "left_anti"), "queries")
        level += 1
    return queries.select("id").limit(0).withColumn("other", F.lit(None).cast("long")) if done is None else done
