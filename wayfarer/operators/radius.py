"""Density clusters at a given radius, exact: cores by their neighbours within it.

A point (a distinct vector, weighing as many rows as it stands for) is a core if the
points within the radius, itself included, weigh at least ``min_pts``.  Cores within
the radius of each other share a cluster; any other point within the radius of a core
joins the cluster of the core with the smallest vector; the rest is noise (-1), as are
clusters that weigh less than ``min_cluster_size``.

Small cells have a diagonal of at most the radius, so the cores of one are together and
a small cell of enough weight holds cores only: no pair inside a cell is looked at, and
a cell with a third of all points costs nothing.  The other points are compared with
small cells first: one wholly within the radius counts by its weight, only those partly
within are opened.  Whether cores of two cells are near is settled by the boxes of ever
smaller cells (``reachability.shortest_between``).

Defined results: rows with a null vector, or one with null or non-finite entries, are
noise; clusters are numbered by their smallest core; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.components import connected_components
from wayfarer.operators.hierarchy import dense_numbers
from wayfarer.operators.points import Grid, at_level, clean_vector, distance, distinct_points, join_large
from wayfarer.operators.reachability import KRUSKAL, shortest_between
from wayfarer.storage import Scratch, store

#: Halvings of the radius down to the finest cells.
FINER = 12


def neighbour_rows(queries: DataFrame, points: DataFrame, grid: Grid, small: DataFrame, radius: float,
                   counted: bool) -> DataFrame:
    """Per query (id, v, cell): with ``counted`` the (id, weight) rows of what lies within the radius,
    otherwise (id, other) of every core there.

    ``small`` are small cells (home, cell, weight, low, high); ``points`` (id, v, weight, home).
    """
    width, level = grid.width, FINER
    asked = queries.withColumn("cell", at_level("cell", level))
    cells = small.withColumn("in", at_level("cell", level)).drop("cell")
    touching = grid.touching(asked.select("cell").distinct(), cells.select(F.col("in").alias("cell")).distinct())
    near = far = F.lit(0.0)
    for i in range(width):
        x, low, high = F.col("v")[i], F.col("low")[i], F.col("high")[i]
        gap, span = F.greatest(low - x, x - high, F.lit(0.0)), F.greatest(high - x, x - low)
        near, far = near + gap * gap, far + span * span
    met = join_large(join_large(asked, touching.withColumnRenamed("other", "in"), "cell"), cells, "in").withColumn(
        "near", F.sqrt(near) * (1 - 1e-12)).withColumn("far", F.sqrt(far) * (1 + 1e-12)).filter(F.col("near") <= radius)
    inside = F.lit(False) if not counted else F.col("far") <= radius
    there = points.select(F.col("id").alias("other"), F.col("v").alias("u"), F.col("weight").alias("w"), "home")
    opened = join_large(met.filter(~inside).select("id", "v", "home"), there, "home").filter(
        distance("v", "u", width) <= radius)
    if not counted:
        return opened.select("id", "other")
    return met.filter(inside).select("id", "weight").unionByName(opened.select("id", F.col("w").alias("weight")))


def radius_clusters(df: DataFrame, radius: float, vec_col: str = "pca", min_pts: int = 3,
                    min_cluster_size: int = 1, out_col: str = "cluster") -> DataFrame:
    """Add ``cluster`` (bigint, -1 = noise) and ``<cluster>_core`` (boolean) to every row of ``df``."""
    if not radius > 0:
        raise ValueError("the radius must be above 0")
    scratch, core_col = Scratch(df.sparkSession), f"{out_col}_core"
    keyed = df.withColumn("_v", clean_vector(vec_col))
    listed = distinct_points(keyed.select(F.col("_v").alias("v")), scratch)
    grid = Grid(listed, scratch, radius / 2 ** FINER)
    small_side = radius / math.sqrt(max(grid.width, 1)) * (1 - 1e-9)
    homes = F.transform("v", lambda x: F.floor(x / F.lit(small_side)).cast("long"))
    points = scratch(grid.points.withColumn("home", homes), "points")

    def boxes(of: DataFrame) -> DataFrame:
        low, high = (F.array(*[f(F.col("v")[i]) for i in range(grid.width)]) for f in (F.min, F.max))
        # A small cell may touch several cells of the radius' side: one row for each it has points in.
        return of.withColumn("wide", at_level("cell", FINER)).groupBy("home", "wide").agg(
            F.min("cell").alias("cell"), F.sum("weight").alias("weight"), low.alias("low"), high.alias("high"),
            F.min("id").alias("first"))

    weighed = points.groupBy("home").agg(F.sum("weight").alias("home_weight"))
    sized = scratch(points.join(weighed, "home"), "sized")
    sparse = sized.filter(F.col("home_weight") < min_pts)
    parted = points.withColumn("home", F.struct("home", at_level("cell", FINER).alias("wide")))
    cells = scratch(boxes(points).withColumn("home", F.struct("home", "wide")).drop("wide"), "small-cells")
    found = neighbour_rows(sparse.select("id", "v", "cell"), parted, grid, cells, radius, True)
    sure = found.groupBy("id").agg(F.sum("weight").alias("n")).filter(F.col("n") >= min_pts).select("id")
    cores = scratch(sized.filter(F.col("home_weight") >= min_pts).select("id", "v", "weight", "cell", "home").unionByName(
        sparse.join(sure, "id").select("id", "v", "weight", "cell", "home")), "cores")
    # The cores of a small cell are one node, named by its smallest.
    named = cores.groupBy("home").agg(F.min("id").alias("comp"))
    nodes = scratch(cores.join(named, "home").withColumn("core", F.lit(0.0)), "nodes")
    links = scratch(shortest_between(grid, nodes, FINER, listed.count(), 0).select("x", "y"), "links")
    member, path = connected_components(links, KRUSKAL)
    scratch.paths.append(path)
    of_core = scratch(nodes.join(member.withColumnRenamed("node", "comp"), "comp", "left").select(
        "id", F.coalesce("component", "comp").alias("first")), "core-clusters")
    rest = points.join(cores.select("id"), "id", "left_anti").select("id", "v", "cell")
    core_parts = parted.join(cores.select("id"), "id", "left_semi")
    core_cells = boxes(cores).withColumn("home", F.struct("home", "wide")).drop("wide")
    border = neighbour_rows(rest, core_parts, grid, core_cells, radius, False).groupBy("id").agg(
        F.min("other").alias("by")).join(of_core.withColumnRenamed("id", "by"), "by").select("id", "first")
    every = scratch(of_core.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False))), "all")
    heavy = every.join(listed.select("id", "weight"), "id").groupBy("first").agg(F.sum("weight").alias("n")).filter(
        F.col("n") >= min_cluster_size)
    order = scratch(heavy.orderBy("first").select("first", F.monotonically_increasing_id().alias("m")), "order")
    label, _ = store(every.join(dense_numbers(order, "m"), "first", "left").join(listed, "id").select(
        F.col("v").alias("_v"), F.col("label").alias(out_col), F.col("core").alias(core_col)), "labels")
    scratch.close()
    return keyed.join(label, "_v", "left").withColumn(out_col, F.coalesce(out_col, F.lit(-1)).cast("long")).withColumn(
        core_col, F.coalesce(core_col, F.lit(False))).drop("_v")
