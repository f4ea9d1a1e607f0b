import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import prose
from wayfarer.llm import embedding_dedup, minhash_dedup, suffix_dedup
from wayfarer.llm.components import connected_components


def test_components_are_the_smallest_reachable_id(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (240, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 1000)]
    groups = brute.Groups({x for p in pairs for x in p})
    for a, b in pairs:
        groups.join(a, b)
    got, _ = connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(4))
    want = {x: groups.find(x) for x in groups.up if groups.find(x) != x}
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_components_of_nothing(spark):
    got, _ = connected_components(spark.createDataFrame([], "a long, b long"))
    assert got.count() == 0


def test_near_duplicates_are_the_brute_force_s(documents, texts):
    got, _ = minhash_dedup.near_duplicates(documents)
    rows = {r["doc_id"]: r for r in got.collect()}
    want = brute.near_duplicates(list(enumerate(texts)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows.values())


def test_chains_of_near_copies_need_more_than_their_leader(spark):
    """Neighbours of a chain link, its ends do not; one bucket search must find all links."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(30):
        changed = list(words)
        for j in range(k):
            changed[12 * j] = f"c{j}"
        rows.append((k, " ".join(changed)))
    got, _ = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute.near_duplicates(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "MEMBERS", 2)
    test_chains_of_near_copies_need_more_than_their_leader(spark)


def test_signature_estimate_is_close():
    rng = np.random.default_rng(1)
    mul, add = minhash_dedup.permutations()
    for share in (0.2, 0.5, 0.85, 0.95):
        n = 2000
        both = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
        rest = [rng.integers(0, 2**64, (n - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        sig = [minhash_dedup.pack(minhash_dedup.minima(np.concatenate([both, r]), mul, add)[None]).view(np.uint64)[0]
               for r in rest]
        estimate = minhash_dedup.agreement(sig[0], sig[1][None])[0]
        assert abs(estimate - len(both) / n) < 0.17


def test_near_duplicate_rows_of_one_id_null_ids_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 1), (1, text, 1), (None, text, 2), (3, text, 3), (4, None, 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df)[0].collect()}
    assert got == {(1, 1, True), (3, 1, False), (4, 4, True), (None, None, True)}
    left = minhash_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r[0] or 0, r[2]) for r in left.collect()) == [(0, 2), (0, 5), (1, 1), (4, 4)]


def test_rows_of_one_id_with_different_texts(spark):
    """The second text of id 1 and that of id 5 are like no other: no row of the stage may lose them."""
    rng = random.Random(41)
    a, c, d = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (1, c), (0, c), (5, d), (5, a + " more"), (7, ""), (7, None), (9, d + " tail"), (9, d + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df)[0].collect()}
    assert got == {(0, 0, True), (1, 0, False), (5, 0, False), (7, 7, True), (9, 0, False)}
    left = sorted(((r[0], r[1] or "") for r in minhash_dedup.drop_near_duplicates(df).collect()))
    assert left == sorted([(1, a), (0, c), (5, d), (7, ""), (7, "")])
    clash = minhash_dedup.drop_near_duplicates(df.withColumns({"row": F.lit(1), "kept_row": F.lit(2)}))
    assert clash.columns == ["doc_id", "text", "row", "kept_row"] and clash.count() == 5


def test_near_duplicates_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(empty)[0].count() == 0
    assert minhash_dedup.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [256, 2])
def test_removal_is_the_brute_force_s(documents, texts, group):
    got = suffix_dedup.remove_repeats(documents, group=group).collect()
    want = dict(enumerate(brute.removal(texts)))
    assert {r["doc_id"]: tuple(r["removal"]) for r in got} == want
    for r in got:
        if r["removal"]["n_removed"] == 0:
            assert r["text"] == texts[r["doc_id"]]


def test_removal_with_clashing_names_and_repeated_ids(spark):
    text = "abcdefghij" * 30
    rows = [(1, text, "a", 1), (1, text, "b", 2), (None, None, "c", 3), (2, "short", None, 4)]
    df = spark.createDataFrame(rows, "uid long, text string, removal string, z int")
    got = suffix_dedup.remove_repeats(df)
    assert got.columns[:-1] == df.columns
    rows = sorted((r["z"], r["text"], r[-1]["n_removed"]) for r in got.collect())
    assert rows == [(1, "", 300), (2, "", 300), (3, None, 0), (4, "short", 0)]


def test_removal_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def embedding_truth(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    ids = sorted({i for i, _ in rows if i is not None})
    links, groups = {i: 0 for i in ids}, brute.Groups(ids)
    for a in good:
        for b in good:
            x, y = good[a], good[b]
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {i: (links[i], groups.find(i)) for i in ids}


def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centres[i % 12] * (1 + i % 3) + rng.normal(scale=0.03 * (i % 9), size=16)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(300 + i, rows[7][1]) for i in range(20)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16),
             (405, [1.0] * 5), (406, [2.0] * 5), (407, [float("inf")] * 16), (408, [1e30] * 16), (409, [1.0] * 16)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"cells": 9, "block": 7, "max_sample": 60}])
def test_embedding_links_are_the_brute_force_s(spark, settings):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           embedding_dedup.near_duplicates(df, **settings).collect()}
    assert got == embedding_truth(rows)


def test_embedding_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r[0] or 0), r[1], r[2] or 0, r[3]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_embeddings_are_not_dealt_out_by_the_cells_they_probe(spark, monkeypatch):
    """A task reads the stored blocks: nothing is shuffled, and written to disk, a cell and query."""
    plans = {}

    def kept(df, name, store=embedding_dedup.store):
        got = store(df, name)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return got

    monkeypatch.setattr(embedding_dedup, "store", kept)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large blocks
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
               embedding_dedup.near_duplicates(df, cells=9, block=7).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == embedding_truth(rows)
    assert "Scan parquet" in plans["links"] and "Exchange" not in plans["links"]


def test_rows_of_one_id_with_different_embeddings(spark):
    """Ids 1 and 2 have two far vectors each: cells of different places, blocks of one smallest id."""
    rng = np.random.default_rng(12)
    far = embedding_dedup.unit(rng.normal(size=(4, 16)))
    rows = [(1, far[0]), (1, far[1]), (2, far[2]), (2, far[3]), (5, 2 * far[0]), (6, far[1] + 1e-4), (7, far[3] + 1e-4)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, cells=4, block=1).collect()}
    assert got == {(1, 1), (2, 2), (5, 1), (6, 1), (7, 2)}


def test_embeddings_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).count() == 0


def test_probes_and_lookups_bound_the_truth():
    rng = np.random.default_rng(6)
    x = embedding_dedup.unit(rng.normal(size=(400, 12)))
    y = embedding_dedup.unit(x + rng.normal(scale=0.06, size=x.shape))
    radius = float(np.sqrt(0.1))
    q = embedding_dedup.Quantiser(x[:200], 10)
    cell, codes, error = q.encode(y)
    for i, cells in enumerate(q.probes(x, radius)):
        if x[i] @ y[i] >= 0.95:
            assert cell[i] in cells
            distance = np.sqrt(q.lookup(x[i:i + 1], cell[i], codes[i:i + 1])[0, 0])
            assert distance <= radius + error[i] + 1e-3
            assert abs(distance - np.linalg.norm(x[i] - y[i])) <= error[i] + 1e-3


def test_dedup_plans_have_no_cross_join(documents):
    df = suffix_dedup.remove_repeats(documents)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert documents.agg(F.count("*")).head()[0] > 0
