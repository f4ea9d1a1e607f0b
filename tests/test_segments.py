import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wayfarer.operators import density, isolation, quantiles


@pytest.mark.parametrize("q", [0.0, 0.05, 0.1, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, q):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    assert quantiles.exact_percentile(df, "v", q) == pytest.approx(np.percentile(vals, q * 100),
                                                                   abs=1e-12)


def blobs(spark, noise=5):
    rng = np.random.default_rng(0)
    pts = [(i, rng.normal([0, 0], 0.05).tolist()) for i in range(60)]
    pts += [(100 + i, rng.normal([5, 5], 0.05).tolist()) for i in range(60)]
    pts += [(200 + i, (rng.uniform(-20, 20, 2) + 40).tolist()) for i in range(noise)]
    df = spark.createDataFrame(pts, "id int, v array<double>")
    return df.select("id", array_to_vector("v").alias("pca"))


def test_density_separates_blobs(spark):
    out = density.density_cluster(blobs(spark), cell_size=0.5, min_pts=3,
                                  min_cluster_size=10).collect()
    lab = {r.id: r.cluster for r in out}
    a = {lab[i] for i in range(60)}
    b = {lab[100 + i] for i in range(60)}
    assert len(a) == 1 and len(b) == 1 and a != b and -1 not in a | b
    assert all(lab[200 + i] == -1 for i in range(5))


def test_connected_components_chain(spark):
    nodes = spark.range(10).select(F.col("id"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)] + [(6, 7)], "src long, dst long")
    comp = {r.id: r.component for r in density.connected_components(nodes, edges).collect()}
    assert [comp[i] for i in range(5)] == [0] * 5
    assert comp[6] == comp[7] == 6 and comp[9] == 9


def test_isolation_finds_planted_outliers(spark):
    rng = np.random.default_rng(1)
    pts = [(i, rng.normal(0, 1, 3).tolist()) for i in range(400)]
    pts += [(1000 + i, (rng.normal(0, 1, 3) + 12).tolist()) for i in range(8)]
    df = spark.createDataFrame(pts, "id int, v array<double>").select(
        "id", array_to_vector("v").alias("pca"))
    scored = isolation.isolation_scores(df, "id", n_trees=50, sample=128)
    flagged = isolation.flag_anomalies(scored, 0.02).collect()
    anomalies = {r.id for r in flagged if r.anomaly == -1}
    assert set(range(1000, 1008)) <= anomalies
    assert len(anomalies) <= 10
    again = {r.id: r.anomaly_score for r in isolation.isolation_scores(df, "id", n_trees=50,
                                                                         sample=128).collect()}
    assert again == {r.id: r.anomaly_score for r in flagged}


def test_sparse_components_equal_dense_standardised(spark):
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructField, StructType

    from wayfarer.operators import vectors

    rng = np.random.default_rng(4)
    rows = []
    for _ in range(80):
        dense = (rng.random(12) < 0.3).astype(float)
        dense[5] = 1.0  # a constant column
        idx = np.flatnonzero(dense)
        rows.append((Vectors.sparse(12, idx.tolist(), dense[idx].tolist()),))
    df = spark.createDataFrame(rows, StructType([StructField("v", VectorUDT())]))
    got = np.array([r.pca.toArray() for r in vectors.standardized_components(df, "v", 4).collect()])
    std = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(df) \
        .transform(df)
    want = PCA(k=4, inputCol="s", outputCol="p").fit(std).transform(std)
    want = np.array([r.p.toArray() for r in want.collect()])
    assert np.allclose(got, want, atol=1e-9)


def test_cluster_labels_do_not_depend_on_partitioning(spark):
    df = blobs(spark)
    a = {r.id: r.cluster for r in density.density_cluster(df, cell_size=0.5,
                                                          min_cluster_size=10).collect()}
    b = {r.id: r.cluster for r in density.density_cluster(
        df.repartition(7, F.col("id")), cell_size=0.5, min_cluster_size=10).collect()}
    assert a == b and set(a.values()) == {-1, 0, 1}
