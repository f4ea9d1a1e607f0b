"""Exact density clusters at a radius against all pairs of rows."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wayfarer.operators.radius import radius_clusters


def plain(points, radius, min_pts, min_size):
    """{row: (cluster, core)}: rows within the radius, cores linked, the rest to the smallest core."""
    points = np.asarray(points, float)
    d = np.zeros((len(points), len(points)))
    for column in points.T:
        d = d + (column[:, None] - column[None, :]) ** 2
    near = np.sqrt(d) <= radius
    core = near.sum(1) >= min_pts
    label = np.full(len(points), -1)
    order = sorted(range(len(points)), key=lambda i: (tuple(points[i]), i))
    for i in order:
        if core[i] and label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j] & core & (label < 0)):
                    label[m] = i
                    todo.append(m)
    for i in range(len(points)):
        if not core[i]:
            by = [j for j in order if core[j] and near[i, j]]
            label[i] = label[by[0]] if by else -1
    names = {}
    for i in order:
        if label[i] >= 0 and core[i] and (label == label[i]).sum() >= min_size:
            names.setdefault(label[i], len(names))
    return [(names.get(x, -1), bool(c)) for x, c in zip(label, core)]


def clustered(spark, points, **settings):
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    df = df.repartition(3).select("id", array_to_vector("v").alias("pca"))
    return [(r["cluster"], r["cluster_core"]) for r in radius_clusters(df, **settings).orderBy("id").collect()]


def data(name):
    rng = np.random.default_rng(8)
    if name == "blobs with copies":
        blobs = np.concatenate([rng.normal([0, 0], 0.3, (50, 2)), rng.normal([3, 3], 0.6, (50, 2)),
                                rng.uniform(-6, 8, (40, 2))])
        return np.concatenate([blobs, *[blobs[:20]] * 4, [blobs[-1]] * 30])
    if name == "lattice":
        return np.array([(i, j, k) for i in range(5) for j in range(5) for k in range(3)] + [(9, 9, 9)] * 4, float)
    if name == "hot cell":  # many points in one small cell, others around its rim
        return np.concatenate([rng.uniform(0, 0.2, (150, 2)), rng.uniform(-1.2, 1.4, (120, 2))])
    return rng.normal(0, 1, (120, 1))


@pytest.mark.parametrize("name,radius,min_pts,min_size", [
    ("blobs with copies", 0.9, 9, 20), ("lattice", 1.0, 4, 1),
    ("hot cell", 0.3, 8, 1), ("line", 0.05, 3, 4)])
def test_clusters_equal_all_pairs(spark, name, radius, min_pts, min_size):
    points = data(name)
    got = clustered(spark, points, radius=radius, min_pts=min_pts, min_cluster_size=min_size)
    assert got == plain(points, radius, min_pts, min_size)


def test_odd_rows_and_bad_radius(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [-0.0, 0.1]), (3, None), (4, [float("nan"), 0.0]), (5, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    df = df.select("id", F.when(F.col("v").isNotNull(), array_to_vector(F.coalesce("v", F.array()))).alias("pca"))
    got = {r["id"]: (r["cluster"], r["cluster_core"]) for r in radius_clusters(df, 0.2).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (-1, False), 4: (-1, False), 5: (-1, False)}
    assert radius_clusters(df.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        radius_clusters(df, 0.0)
