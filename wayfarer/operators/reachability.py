"""Minimum spanning tree of points under mutual reachability.

The mutual reachability of two points is the largest of their distance and their
core distances.  Levels of the grid are taken from fine to coarse; those of side s
yield the tree's edges of at most s.  Before a level the points already joined make
components.  A component's points in one cell are a group, known by its box and its
smallest core distance; two groups of different components in touching cells may
hold an edge between those components, no shorter than their boxes' distance and no
longer than their boxes' span.  Groups that cannot hold the shortest edge of their
two components are dropped, those left are cut into the groups of the next finer
cells, until few pairs of points remain: only those are compared.  At the first level, where each
point is a component, near points give their edges at once.  The shortest edge
of every two components goes into Boruvka rounds (a combinable minimum a component,
the chosen edges contracted) that leave the tree's.

Edges are ordered by (length, smaller id, greater id), so the tree is unique and does
not depend on how the rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import points as points_module
from wayfarer.operators.components import connected_components
from wayfarer.operators.points import Grid, at_level, distance, join_large, spread

#: Pairs of points compared per point of the data before groups are cut finer.
COMPARED = 64
#: Edges contracted in one task; more go through distributed rounds.
KRUSKAL = 200_000
#: Edges that a task sorts to find the shortest of a component, about, in up to ``DEALT`` tasks.
SORTED, DEALT = 500_000, 200

EDGES = "a long, b long, w double"


def _boxes(points: DataFrame, level: int, width: int) -> DataFrame:
    """(comp, cell, n, core, low, high): the groups of a level."""
    ends = [F.array(*[f(F.col("v")[i]) for i in range(width)]) for f in (F.min, F.max)]
    return points.groupBy("comp", at_level("cell", level).alias("cell")).agg(
        F.count("*").alias("n"), F.min("core").alias("core"), ends[0].alias("low"), ends[1].alias("high"))


def _bounds(pairs: DataFrame, width: int, side: float) -> DataFrame:
    """Keeps pairs of groups (x..., y...) that may hold their components' shortest edge of at most ``side``."""
    near = far = F.lit(0.0)
    for i in range(width):
        gap = F.greatest(F.col("y_low")[i] - F.col("x_high")[i], F.col("x_low")[i] - F.col("y_high")[i], F.lit(0.0))
        span = F.greatest(F.col("y_high")[i] - F.col("x_low")[i], F.col("x_high")[i] - F.col("y_low")[i])
        near, far = near + gap * gap, far + span * span
    core = F.greatest("x_core", "y_core")
    # A rounding error of the bounds must not drop an edge.
    pairs = pairs.withColumn("least", F.greatest(F.sqrt(near), core) * (1 - 1e-12)).withColumn(
        "most", F.greatest(F.sqrt(far), core) * (1 + 1e-12)).filter(F.col("least") <= side)
    best = pairs.groupBy("x", "y").agg(F.min("most").alias("best"))
    return join_large(pairs, best, ["x", "y"]).filter(F.col("least") <= F.col("best")).drop("best", "least", "most")


def _as_side(groups: DataFrame, side: str) -> DataFrame:
    return groups.select(F.col("comp").alias(side), *[F.col(c).alias(f"{side}_{c}")
                                                      for c in ("cell", "n", "core", "low", "high")])


def short_edges(grid: Grid, points: DataFrame, level: int, n: int) -> DataFrame:
    """(x, y, w, a, b): the edges of at most the level's side where each point is a component.

    Two such components have one edge, so nothing is bounded or grouped.
    """
    # Edges are no shorter than their ends' core distances.
    points = points.filter(F.col("core") <= grid.side_at(level))
    cells = points.select(at_level("cell", level).alias("cell")).distinct()
    x = spread(points, n).select(F.col("id").alias("x"), "v", F.col("core").alias("x_core"), at_level("cell", level).alias("cell"))
    y = points.select(F.col("id").alias("y"), F.col("v").alias("u"), F.col("core").alias("y_core"),
                      at_level("cell", level).alias("other"))
    w = F.greatest(distance("v", "u", grid.width), "x_core", "y_core")
    pairs = join_large(join_large(x, grid.touching(cells, cells), "cell"), y, "other").filter("x < y")
    return pairs.select("x", "y", w.alias("w"), F.col("x").alias("a"), F.col("y").alias("b")).filter(
        F.col("w") <= grid.side_at(level))


def shortest_between(grid: Grid, points: DataFrame, level: int, n: int, floor: int) -> DataFrame:
    """(x, y, w, a, b): the shortest edge of every two components, where it is at most the level's side."""
    side, width, store = grid.side_at(level), grid.width, grid.store
    groups = store(_boxes(points, level, width), "groups")
    cells = groups.select("cell").distinct()
    touching = grid.touching(cells, cells).withColumnRenamed("cell", "x_cell").withColumnRenamed("other", "y_cell")
    pairs = join_large(join_large(_as_side(groups, "x"), touching, "x_cell"), _as_side(groups, "y"), "y_cell").filter("x < y")
    pairs = store(_bounds(pairs, width, side), "group-pairs")
    at = level
    while at > floor:
        work = pairs.agg(F.sum(F.col("x_n").cast("double") * F.col("y_n"))).head()[0] or 0
        if work <= max(COMPARED * n, points_module.FEW_PAIRS):
            break
        at -= 1
        finer = store(_boxes(points, at, width).withColumn("in", at_level("cell", 1)), "groups")
        halves = pairs.select("x", "y", F.col("x_cell").alias("x_in"), F.col("y_cell").alias("y_in"))
        for s in ("x", "y"):
            half = finer.select(F.col("in").alias(f"{s}_in"), F.col("comp").alias(s),
                                *[F.col(c).alias(f"{s}_{c}") for c in ("cell", "n", "core", "low", "high")])
            halves = join_large(halves, half, [s, f"{s}_in"]).drop(f"{s}_in")
        pairs = store(_bounds(halves, width, side), "group-pairs")
    found = pairs.select("x", "y", "x_cell", "y_cell")
    for s, name, v, core in (("x", "p", "v", "p_core"), ("y", "q", "u", "q_core")):
        found = join_large(found, points.select(
            F.col("comp").alias(s), at_level("cell", at).alias(f"{s}_cell"), F.col("id").alias(name),
            F.col("v").alias(v), F.col("core").alias(core)), [s, f"{s}_cell"])
    w = F.greatest(distance("v", "u", width), "p_core", "q_core")
    return found.select("x", "y", F.struct(
        w.alias("w"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).alias("e")).filter(
        F.col("e.w") <= side).groupBy("x", "y").agg(F.min("e").alias("e")).select("x", "y", "e.*")


def _kruskal(batches):
    """Tree edges among (x, y, w, a, b), all in one task."""
    rows = sorted((w, a, b, x, y) for batch in batches for x, y, w, a, b in zip(
        *(batch.column(c).to_pylist() for c in ("x", "y", "w", "a", "b"))))
    up: dict[int, int] = {}

    def find(c):
        while up.setdefault(c, c) != c:
            up[c] = c = up[up[c]]
        return c

    out = []
    for w, a, b, x, y in rows:
        x, y = find(x), find(y)
        if x != y:
            up[x] = y
            out.append((a, b, w))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
        (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "w"])


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    """``n`` edges dealt out evenly: a stored table's edges are packed closely, and a minimum of rows sorts them."""
    tasks = min(DEALT, -(-n // SORTED))
    return edges.repartition(tasks, "a", "b") if tasks > 1 else edges


def contracted_tree(edges: DataFrame, store: Callable, kruskal: int = KRUSKAL) -> DataFrame:
    """(a, b, w): the edges of (x, y, w, a, b) that are in the minimum spanning forest of x and y."""
    edges = store(edges, "edges")
    chosen, now = None, edges
    while True:
        left = now.count()
        if left <= kruskal:
            rest = store(now.coalesce(1).mapInArrow(_kruskal, EDGES), "tree")
            return rest if chosen is None else chosen.unionByName(rest)
        now = _dealt(now, left)
        e = F.struct("w", "a", "b", "x", "y")
        best = now.select(F.col("x").alias("c"), e.alias("e")).unionAll(
            now.select(F.col("y").alias("c"), e.alias("e"))).groupBy("c").agg(F.min("e").alias("e"))
        best = store(best.select("e.*").distinct(), "shortest")
        member, path = connected_components(best.select("x", "y"), kruskal)
        store.paths.append(path)
        for s in ("x", "y"):
            now = join_large(now, member.select(F.col("node").alias(s), F.col("component").alias("to")), s, "left") \
                .withColumn(s, F.coalesce("to", s)).drop("to")
        now = now.filter("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "w", "a", "b")
        now = store(now.groupBy("x", "y").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("x", "y", "e.*"), "edges")
        picked = best.select("a", "b", "w")
        chosen = picked if chosen is None else chosen.unionByName(picked)


def reachability_tree(grid: Grid, cores: DataFrame, n: int, start: int, store: Callable,
                      kruskal: int = KRUSKAL) -> DataFrame:
    """(a, b, w): the n - 1 edges of the minimum spanning tree; ``cores`` has (id, core)."""
    points = store(join_large(grid.points.select("id", "v", "cell"), cores, "id").withColumn("comp", F.col("id")), "reach")
    tree, joined, level = None, 0, start
    while joined < n - 1:
        edges = shortest_between(grid, points, level, n, 0) if joined else short_edges(grid, points, level, n)
        got = store(contracted_tree(edges, store, kruskal), "tree-edges")
        size = got.count()
        if size:
            tree = got if tree is None else tree.unionByName(got)
            joined += size
            if joined < n - 1:
                member, path = connected_components(tree.select("a", "b"), kruskal)
                store.paths.append(path)
                points = store(join_large(points.drop("comp"), member.select(
                    F.col("node").alias("id"), "component"), "id", "left").withColumn(
                    "comp", F.coalesce("component", "id")).drop("component"), "reach")
        level += 1
    return tree
