"""Density clustering of low-dimensional vectors (-1 = noise).

Without a cell size: the stable parts of a variable-density hierarchy (``hierarchy``).
With one, a flat cut of a grid: points are binned into cells of side ``cell_size``
over every component.  A cell holding at least ``min_pts`` points is dense; dense
cells that touch (Chebyshev distance 1 in cell coordinates) form one cluster, found
as connected components of the dense-cell graph; a sparse cell touching dense cells
joins the one whose component has the smallest cell (border points); everything else
is noise, as are clusters lighter than ``min_cluster_size``.

All work is per cell: points are counted by a combinable ``groupBy`` (a cell
with a third of all points is one count, not a pair enumeration), the
neighbour search explodes the 3^k offsets of dense cells only.  Cells are known
by their coordinates, so labels do not depend on how the rows are dealt out.
``radius`` has the flat cut by exact distances.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import components
from wayfarer.operators.hierarchy import dense_numbers, hierarchical_clusters
from wayfarer.operators.vectors import as_array
from wayfarer.storage import Scratch, store


def _offsets(k: int) -> list[list[int]]:
    return [list(o) for o in itertools.product((-1, 0, 1), repeat=k) if any(o)]


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node; component is the smallest id reachable.

    ``nodes(id)``, ``edges(src, dst)``.
    """
    member, _ = components.connected_components(edges.select("src", "dst"))
    return nodes.select("id").join(member.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def density_cluster(df: DataFrame, vec_col: str = "pca", cell_size: float | None = None,
                    min_pts: int = 3, min_cluster_size: int = 3,
                    out_col: str = "cluster", *, size_in_rows: bool = False) -> DataFrame:
    """Add ``cluster`` (bigint, -1 = noise) to every row of ``df``.

    ``min_pts`` belongs to the flat cut, whose clusters are numbered 0.. in order of
    their smallest cell.  ``size_in_rows`` (see ``hierarchy``) belongs to the other.
    """
    if cell_size is None:
        return hierarchical_clusters(df, vec_col, min_cluster_size, out_col=out_col, size_in_rows=size_in_rows)
    spark = df.sparkSession
    scratch = Scratch(spark)
    cell = F.transform(as_array(vec_col), lambda x: F.floor(x / F.lit(cell_size)).cast("long"))
    pts = df.withColumn("_cell", cell)
    cells = scratch(pts.groupBy("_cell").agg(F.count(F.lit(1)).alias("weight")), "cells")
    first = cells.select("_cell").first()
    k = len(first["_cell"]) if first is not None and first["_cell"] is not None else 0
    dense = cells.filter(F.col("weight") >= min_pts).select(F.col("_cell").alias("id"))
    offs = F.array(*[F.array(*[F.lit(v) for v in o]) for o in _offsets(k)]) if k else \
        F.array().cast("array<array<long>>")
    reach = dense.select(F.col("id").alias("src"), F.explode(
        F.transform(offs, lambda o: F.zip_with("id", o, lambda a, b: a + b))).alias("_cell"))
    touch = scratch(reach.join(cells, "_cell").select("src", F.col("_cell").alias("dst"), "weight"), "touch")
    member, path = components.connected_components(touch.filter(F.col("weight") >= min_pts).select("src", "dst"))
    scratch.paths.append(path)
    comps = dense.join(member.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))
    # Border cells: sparse cells touching dense cells take the smallest component among them.
    border = (touch.filter(F.col("weight") < min_pts)
              .join(comps.withColumnRenamed("id", "src"), "src")
              .groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("component")))
    cell_comp = scratch(comps.unionByName(border), "cell-components")
    sized = (cell_comp.join(cells.withColumnRenamed("_cell", "id"), "id")
             .groupBy("component").agg(F.sum("weight").alias("_w"), F.min("id").alias("_first")))
    order = scratch(sized.filter(F.col("_w") >= min_cluster_size).orderBy("_first").select(
        "component", F.monotonically_increasing_id().alias("m")), "order")
    labels, _ = store(cell_comp.join(dense_numbers(order, "m"), "component").select(
        F.col("id").alias("_cell"), F.col("label").alias(out_col)), "cell-labels")
    scratch.close()
    return pts.join(labels, "_cell", "left").withColumn(
        out_col, F.coalesce(out_col, F.lit(-1)).cast("long")).drop("_cell")

