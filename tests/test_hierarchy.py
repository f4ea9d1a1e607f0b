"""Variable-density clusters against a brute force over all pairs of distinct vectors."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wayfarer.operators import hierarchy as H
from wayfarer.operators import points as points_module
from wayfarer.operators import reachability
from wayfarer.operators.points import Grid, core_distances, distinct_points
from wayfarer.operators.reachability import contracted_tree, reachability_tree
from wayfarer.storage import Scratch


def plain_reach(points, k):
    d = np.zeros((len(points), len(points)))
    for column in points.T:
        d = d + (column[:, None] - column[None, :]) ** 2
    d = np.sqrt(d)
    core = np.sort(d, axis=1)[:, k]
    return np.maximum(np.maximum(d, core[:, None]), core[None, :]), core


def plain_clusters(points, k, least):
    """Labels from the top down: cut at every length, follow the parts of ``least`` points or more."""
    points = np.asarray(points, float)
    n = len(points)
    if n <= k:
        return [-1] * n
    reach, _ = plain_reach(points, k)
    chosen = {}

    def parts(nodes, length):
        """Parts of ``nodes`` joined by edges shorter than ``length``."""
        out, left = [], set(nodes)
        while left:
            todo = [left.pop()]
            part = set(todo)
            while todo:
                i = todo.pop()
                near = [j for j in left if reach[i, j] < length]
                left.difference_update(near)
                part.update(near)
                todo.extend(near)
            out.append(frozenset(part))
        return out

    def longest(nodes):
        """Longest edge needed to join ``nodes``."""
        nodes = sorted(nodes)
        seen, best = {nodes[0]}, {j: reach[nodes[0], j] for j in nodes[1:]}
        top = 0.0
        while best:
            j = min(best, key=best.get)
            top = max(top, best.pop(j))
            seen.add(j)
            for m in best:
                best[m] = min(best[m], reach[j, m])
        return top

    def solve(nodes, born, root):
        """(stability, chosen clusters) of the cluster that is ``nodes`` when it ends (read from the top)."""
        stability, now = 0.0, nodes
        while True:
            length = longest(now)
            pieces = parts(now, length)
            big = [p for p in pieces if len(p) >= least]
            gone = len(now) - (len(big[0]) if len(big) == 1 else 0)
            stability += gone * ((1 / length) - (1 / born if born else 0.0))
            if len(big) != 1:
                break
            now = big[0]
        below = [solve(p, length, False) for p in big]
        under = sum(s for s, _ in below)
        if root or (big and under * (1 - 1e-9) > stability):
            return max(under, stability), [c for _, cs in below for c in cs]
        return stability, [nodes]

    _, clusters = solve(frozenset(range(n)), None, True)
    clusters.sort(key=min)
    label = [-1] * n
    for i, c in enumerate(clusters):
        for p in c:
            label[p] = i
    return label


def cases():
    rng = np.random.default_rng(4)
    three = np.concatenate([rng.normal([0, 0], 0.1, (60, 2)), rng.normal([4, 4], 0.6, (60, 2)),
                            rng.normal([-6, 5], 1.8, (40, 2)), rng.uniform(-20, 20, (12, 2))])
    nested = np.concatenate([rng.normal(0, 2.0, (70, 3)), rng.normal(0, 0.05, (30, 3)) + 1, rng.normal(9, 0.3, (40, 3))])
    grid = np.array([(i, j) for i in range(8) for j in range(6)] + [(i + 30, j) for i in range(5) for j in range(5)]
                    + [(i * 3 + 60, j * 3) for i in range(4) for j in range(4)], float)
    line = np.cumsum(rng.exponential(1, 90))[:, None]
    labels = np.unique(rng.integers(0, 2, (80, 7)).astype(float), axis=0)
    return {"three": three, "nested": nested, "grid": grid, "line": line, "labels": labels,
            "few": three[:5], "one": three[:1], "equal gaps": np.arange(30.0)[:, None]}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("k,least", [(3, 3), (2, 6), (5, 5), (1, 2)])
def test_one_task_equals_brute_force(name, k, least):
    points = cases()[name]
    points = points[np.lexsort(points.T[::-1])]
    assert H.small_labels(points, k, least).tolist() == plain_clusters(points, k, least)


def test_three_densities_are_three_clusters():
    label = np.array(H.small_labels(cases()["three"], 5, 15))
    blocks = [label[:60], label[60:120], label[120:160]]
    names = [np.bincount(b + 1).argmax() - 1 for b in blocks]
    assert sorted(names) == [0, 1, 2] and all((b == m).mean() > 0.7 for b, m in zip(blocks, names))


def frame(spark, points, parts=3):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(parts)
    return df.select("id", array_to_vector("v").alias("pca"))


def labels(df):
    return [r.cluster for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("name,branch", [("grid", 12)])
def test_all_paths_give_the_same_labels(spark, name, branch):
    points = cases()[name]
    order = np.lexsort(points.T[::-1])
    want = np.empty(len(points), int)
    want[order] = plain_clusters(points[order], 3, 3)
    df = frame(spark, points)
    assert labels(H.hierarchical_clusters(df)) == want.tolist()
    assert labels(H.hierarchical_clusters(df, small=0, branch=branch)) == want.tolist()


def test_copies_change_nothing(spark):
    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(c, s, (60, 2)) for c, s in (([0, 0], 0.1), ([5, 5], 0.3), ([-5, 5], 1.0))])
    plain = labels(H.hierarchical_clusters(frame(spark, blobs), min_cluster_size=10))
    copies = np.concatenate([blobs, *[blobs[:50]] * 8])
    got = labels(H.hierarchical_clusters(frame(spark, copies), min_cluster_size=10))
    assert len(set(plain) - {-1}) == 3
    assert got[:180] == plain and got[180:] == plain[:50] * 8


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_core_distances_and_tree_equal_brute_force(spark, monkeypatch, few):
    """With ``few`` 0 the grid's levels and ever smaller cells are gone through, 40 points or not."""
    monkeypatch.setattr(points_module, "FEW_PAIRS", few)
    monkeypatch.setattr(points_module, "PAIRS", 4)
    monkeypatch.setattr(points_module, "HALVINGS", 6)
    monkeypatch.setattr(reachability, "COMPARED", 1)
    points = cases()["three"][::4]
    points = points[np.lexsort(points.T[::-1])]
    scratch = Scratch(spark)
    stored = distinct_points(spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>"), scratch)
    number = {r.id: i for i, r in enumerate(stored.orderBy("id").collect())}
    reach, core = plain_reach(points, 4)
    grid = Grid(stored, scratch)
    start = grid.starting_level(len(points))
    assert (start < 6) == (few == 0)
    cores = core_distances(grid, 4, start)
    assert {number[r.id]: r.core for r in cores.collect()} == dict(enumerate(core.tolist()))
    tree = reachability_tree(grid, cores, len(points), start, scratch, kruskal=few or 30).collect()
    assert len(tree) == len(points) - 1
    assert sorted(r.w for r in tree) == sorted(H.small_tree(points, 4)[2].tolist())
    assert all(reach[number[r.a], number[r.b]] == r.w for r in tree)
    scratch.close()


def test_contracted_tree_is_that_of_all_edges(spark):
    rng = np.random.default_rng(1)
    edges = [(int(x), int(y), float(w), int(x), int(y)) for x, y, w in
             {(min(x, y), max(x, y)): (min(x, y), max(x, y), w) for x, y, w in
              zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(1, 9, 300)) if x != y}.values()]
    df = spark.createDataFrame(edges, "x long, y long, w double, a long, b long")
    scratch = Scratch(spark)
    one, many = (sorted(tuple(r) for r in contracted_tree(df, scratch, limit).collect()) for limit in (1000, 10))
    assert one == many and len(one) == 39
    scratch.close()


def test_nulls_odd_vectors_and_empty_tables(spark):
    rows = [(i, [float(i % 7), float(i // 7)]) for i in range(28)] + [(100, None), (101, [float("nan"), 0.0]),
                                                                      (102, [float("inf"), 0.0]), (103, [-0.0, 0.0])]
    rows += [(200 + i, [50.0 + i % 3, 50.0 + i // 3]) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, pca array<double>")
    df = df.select("id", F.when(F.col("pca").isNotNull(), array_to_vector(F.coalesce("pca", F.array()))).alias("pca"))
    got = {r.id: r.cluster for r in H.hierarchical_clusters(df).collect()}
    assert len(got) == len(rows) and {got[100], got[101], got[102]} == {-1}
    assert got[103] == got[0] == 0 and got[200] == 1
    assert H.hierarchical_clusters(df.limit(0)).count() == 0
    assert {r.cluster for r in H.hierarchical_clusters(df.limit(3)).collect()} == {-1}


def test_first_level_bounds_no_groups(spark, monkeypatch):
    """Points that are components of their own give edges at once: no table of groups as long as the points."""
    monkeypatch.setattr(points_module, "FEW_PAIRS", 10)
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(0, 1, (400, 3)), 3)
    kept, scratch = [], Scratch(spark)

    class Watched(Scratch):
        def __call__(self, df, name):
            got = super().__call__(df, name)
            kept.append((name, got.count()))
            return got

    watched = Watched(spark)
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>")
    table = distinct_points(rows, scratch)
    n = table.count()
    grid = Grid(table, watched)
    start = grid.starting_level(n)
    tree = reachability_tree(grid, core_distances(grid, 3, start), n, start, watched)
    got = sorted(r["w"] for r in tree.collect())
    _, _, w = H.small_tree(np.array([r["v"] for r in table.orderBy("id").collect()]), 3)
    assert np.allclose(got, sorted(w.tolist()), rtol=0, atol=1e-12)
    assert max((c for name, c in kept if name == "groups"), default=0) < n
    watched.close()
    scratch.close()


def test_edges_of_one_stored_file_are_dealt_out_before_they_are_sorted(spark, monkeypatch):
    rng = np.random.default_rng(12)
    pairs = {(int(min(x, y)), int(max(x, y))) for x, y in rng.integers(0, 60, (500, 2)) if x != y}
    rows = [(x, y, float(rng.integers(0, 9)), x, y) for x, y in sorted(pairs)]
    scratch = Scratch(spark)
    edges = scratch(spark.createDataFrame(rows, "x long, y long, w double, a long, b long").coalesce(1), "edges")
    want = sorted(tuple(r) for r in contracted_tree(edges, scratch, 1000).collect())
    monkeypatch.setattr(reachability, "SORTED", 50)
    dealt = reachability._dealt(edges, len(rows)).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(dealt) == -(-len(rows) // 50) and max(r["count"] for r in dealt) < 150
    assert sorted(tuple(r) for r in contracted_tree(edges, scratch, 10).collect()) == want
    scratch.close()


def test_tables_that_grow_with_the_points_are_not_sent_through_the_driver(spark, monkeypatch):
    """Stored rows and exploded cells look small to Spark; it must not broadcast them."""
    monkeypatch.setattr(points_module, "FEW_PAIRS", 0)
    rows = spark.createDataFrame([(p.tolist(),) for p in np.random.default_rng(2).normal(size=(200, 3))], "v array<double>")
    plans = []

    class Planned(Scratch):
        def __call__(self, df, name):
            got = super().__call__(df, name)
            if name in ("neighbours", "edges", "group-pairs", "reach"):
                plans.append(df._jdf.queryExecution().executedPlan().toString())
            return got

    planned, scratch = Planned(spark), Scratch(spark)
    grid = Grid(distinct_points(rows, scratch), planned)
    cores = core_distances(grid, 3, 15)
    assert reachability_tree(grid, cores, 200, 15, planned).count() == 199
    assert len(plans) > 4 and not any("BroadcastExchange" in plan for plan in plans)
    planned.close()
    scratch.close()
