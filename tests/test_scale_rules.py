"""Whole, stable results: all labels, stable clusters, keys by item, complete snapshots."""
import datetime as dt
import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wayfarer import storage
from wayfarer.functions.timeutil import epoch_seconds
from wayfarer.operators import attribution, density, importance, isolation, quantiles, topics, users, vectors
from wayfarer.sources import ga_export as GX


def test_components_over_more_than_two_thousand_labels(spark):
    rng = np.random.default_rng(1)
    n, labels = 60, 2600
    dense = np.zeros((n, labels))
    for i in range(n):
        dense[i, rng.choice(labels, 90, replace=False)] = 1
        dense[i, :600] = i % 2
        dense[i, 600:900] = i % 3 == 0
    rows = [(i, [f"l{j}" for j in np.flatnonzero(dense[i])]) for i in range(n)] + [(n, [])]
    dense = np.vstack([dense, np.zeros(labels)])
    df = spark.createDataFrame(rows, "user_id long, activity_list array<string>").repartition(3)
    got = np.array([r.pca.toArray() for r in vectors.reduce(df, 2).orderBy("user_id").collect()])
    std = dense.std(axis=0, ddof=1)
    x = (dense - dense.mean(axis=0))[:, std > 0] / std[std > 0]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :2] * s[:2]
    assert np.allclose(got.var(axis=0, ddof=1), want.var(axis=0, ddof=1), rtol=1e-6)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-3)


def test_border_cells_do_not_depend_on_partitioning(spark):
    # Two dense cells two apart; the sparse one between them touches both.
    pts = [(0.5, 0.5)] * 9 + [(2.5, 0.5)] * 9 + [(1.5, 0.5)]
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(pts)], "id long, v array<double>") \
        .select("id", array_to_vector("v").alias("pca"))
    seen = set()
    for parts in (1, 2, 5, 8, 11):
        out = density.density_cluster(df.repartition(parts, "id"), cell_size=1.0, min_pts=3).collect()
        seen.add(tuple(r["cluster"] for r in sorted(out, key=lambda r: r["id"])))
    assert seen == {(0,) * 9 + (1,) * 9 + (0,)}


def test_clusters_of_many_points_come_from_all_rows(spark):
    rng = np.random.default_rng(2)
    pts = [(i, rng.normal(i % 4 * 10, 0.1, 2).tolist()) for i in range(3000)]
    df = spark.createDataFrame(pts, "id long, v array<double>").select("id", array_to_vector("v").alias("pca"))
    found = density.density_cluster(df, min_cluster_size=40).groupBy("cluster", F.expr("id % 4").alias("blob")).count()
    rows = [r for r in found.collect() if r["cluster"] >= 0]
    assert len(rows) == 4 and len({r["cluster"] for r in rows}) == 4 and sum(r["count"] for r in rows) > 2500
    assert {r["cluster"] for r in density.density_cluster(df, cell_size=2.0).collect()} == {0, 1, 2, 3}


def test_not_set_is_one_class(spark):
    rows = []
    for i in range(40):
        rows.append((f"u{i}", "session_start", "(not set)", dt.datetime(2024, 1, 1, 0, i)))
        rows.append((f"u{i}", "session_start", "google / cpc", dt.datetime(2024, 1, 1, 1, i)))
    rows += [("u0", "session_start", "rare / x", dt.datetime(2024, 1, 1)),
             ("v", "session_start", "rare / x", dt.datetime(2024, 1, 2))]
    clean = spark.createDataFrame(rows, "user_id string, event_name string, source_medium string, "
                                        "event_timestamp timestamp_ntz")
    even = {(r["user_id"], r["medium_column"]): r["score"] for r in
            attribution.medium_mix_long(clean, "even").collect()}
    assert even["u0", "medium_not_set"] == even["u0", "medium_google_cpc"] == 0.5
    assert even["v", "medium_not_set"] == 1.0 and ("v", "(not set)") not in even


def test_wide_columns_are_bounded(spark):
    mix = spark.createDataFrame([("u", f"m{i}", 1.0) for i in range(5)],
                                "user_id string, medium_column string, score double")
    with pytest.raises(ValueError):
        attribution.medium_columns(mix, 4)
    assert attribution.medium_mix_wide(mix, ["m1", "zz"]).head().asDict() == {"user_id": "u", "m1": 1.0, "zz": 0.0}


def test_patterns_with_the_separator_in_an_item_stay_apart(spark):
    pats = spark.createDataFrame([(["a -> b", "c"],), (["a", "b -> c"],)], "sequence array<string>")
    js = spark.createDataFrame([("x", ["a -> b", "c"], 1), ("y", ["a", "b -> c"], 0)],
                               "user_id string, activity_list array<string>, converted int")
    got = {r["user_id"]: r["contained_keys"] for r in importance.sequence_features(js, pats).collect()}
    assert got == {"x": ['["a -> b","c"]'], "y": ['["a","b -> c"]']}


def test_repeated_ids_are_scored_row_by_row(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 50, rng.normal(size=3).tolist(), "k") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, v array<double>, note string").select(
        "id", "note", array_to_vector("v").alias("pca"))
    scored = isolation.isolation_scores(df, "id", n_trees=10, sample=32)
    assert scored.count() == 150 and scored.columns == ["id", "note", "pca", "anomaly_score"]


def test_epoch_seconds_in_another_time_zone(spark):
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT timestamp_micros(1704067200500000) AS t, "
                       "TIMESTAMP_NTZ '2024-01-01 00:00:00.5' AS n")
        assert tuple(df.select(epoch_seconds("t"), epoch_seconds("n")).head()) == (1704067200, 1704067200)
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_snapshots_are_whole_and_keyed_on_all_parameters(spark, tmp_path):
    day, root = dt.date(2024, 1, 30), str(tmp_path)
    GX.write_snapshot(spark.range(5), root, "t", day, 30, event_names=["page_view"])
    assert GX.read_snapshot(spark, root, "t", day, 30) is None
    assert GX.read_snapshot(spark, root, "t", day, 30, True, ["page_view"]) is None
    assert GX.read_snapshot(spark, root, "t", day, 30, event_names=["page_view"]).count() == 5
    os.remove(os.path.join(GX.snapshot_path(root, "t", day, 30, event_names=["page_view"]), "_SUCCESS"))
    assert GX.read_snapshot(spark, root, "t", day, 30, event_names=["page_view"]) is None


def test_empty_conversion_paths_are_refused():
    for bad in ("", "  ", "?x=1", "https://host"):
        with pytest.raises(ValueError):
            users.normalise_paths([bad])
    assert users.normalise_paths(["/", "/Thanks"]) == ["/", "/thanks/"]


def test_merged_topics_are_chains_of_near_directions(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import IntegerType, StructField, StructType
    angles = {0: 0.0, 1: 0.4, 2: 0.8, 3: 2.0, 4: 2.3, 5: 4.0, -1: 0.1}
    rows = [(t, Vectors.dense([float(np.cos(a)) * (t + 2), float(np.sin(a)) * (t + 2)])) for t, a in angles.items()]
    cen = spark.createDataFrame(rows, StructType([StructField("topic", IntegerType()),
                                                  StructField("centroid", VectorUDT())]))
    got = {r["topic"]: r["merged"] for r in topics.reduce_topics(cen, 0.9).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_ranks_of_long_hashes(spark):
    rng = np.random.default_rng(9)
    values = sorted(int(v) for v in rng.integers(0, 1 << 60, 2000)) + [1 << 60] * 3
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert quantiles.values_at_ranks(df, "v", [0, 999, 2002, 2003]) == {
        0: values[0], 999: values[999], 2002: 1 << 60}


def test_scratch_tables_are_dropped(spark):
    scratch = storage.Scratch(spark)
    before = set(storage.left())
    kept = scratch(spark.range(3), "t")
    assert kept.count() == 3 and len(set(storage.left()) - before) == 1
    scratch.close()
    assert set(storage.left()) == before


def test_journey_stages_store_only_what_is_read(spark):
    from wayfarer.plans import catalog
    st = catalog.stages(spark, "/root/testdata/sf0.001")
    assert not st.scratch.paths
    assert st.counts.count() > 0
    assert [os.path.basename(p).rsplit("-", 1)[0] for p in st.scratch.paths] == ["clean-events"]
    st.close()
    assert F and not st.scratch.paths
