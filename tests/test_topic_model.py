import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import points
from wayfarer.plans import topic_model
from wayfarer.storage import Scratch

VOCABULARY = ["abcdefgh", "ijklmnop", "qrstuvwx"]


def journeys(spark, n, seed, start=0):
    rng = random.Random(seed)
    rows = [(f"u{start + i}", [f"page {x * 3}" for x in rng.sample(VOCABULARY[i % 3], rng.randint(3, 6))])
            for i in range(n)]
    df = spark.createDataFrame(rows, "user_id string, activity_list array<string>")
    return df.withColumn("activity_list_text", F.array_join("activity_list", " -> "))


def test_nearest_points_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    there, asked = rng.normal(size=(60, 2)), np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(5, 2)) * 50])
    scratch = Scratch(spark)
    frame = lambda x: spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)],
                                            "id long, v array<double>, weight long")
    got = points.nearest(points.Grid(frame(there), scratch), frame(asked).select("id", "v"), 18)
    d = np.linalg.norm(asked[:, None] - there[None], axis=2)
    assert {r["id"]: r["other"] for r in got.collect()} == dict(enumerate(d.argmin(axis=1).tolist()))
    scratch.close()


def test_model_gives_fitted_journeys_their_topics_back_and_new_ones_a_like_one(spark, tmp_path):
    df = journeys(spark, 150, 1)
    model, result = topic_model.fit_topics(df, min_topic_size=20)
    path = str(tmp_path / "model")
    assert topic_model.versions(spark, path) == []
    with pytest.raises(ValueError):
        topic_model.load_model(spark, path)
    assert model.save(path) == 1 and model.save(path) == 2
    kept = topic_model.load_model(spark, path)
    own = {r["user_id"]: r["topic"] for r in result.assignments.collect()}
    assert {r["user_id"]: r["topic"] for r in kept.assign(df).collect()} == own
    named = [{own[f"u{i}"] for i in range(g, 150, 3)} - {-1} for g in range(3)]
    assert all(named) and not named[0] & named[1] and not named[1] & named[2]
    new = {r["user_id"]: r["topic"] for r in kept.assign(journeys(spark, 60, 2, 1000)).collect()}
    assert all(new[f"u{1000 + i}"] in named[i % 3] | {-1} for i in range(60))
    odd = spark.createDataFrame([("x", ["never seen"]), ("y", None), ("z", [])], "user_id string, activity_list array<string>")
    assert len({r["topic"] for r in kept.assign(odd).collect()}) == 1 and kept.assign(odd).count() == 3
    # A version whose last table is missing is not there.
    import shutil
    shutil.rmtree(f"{path}/v000002/model")
    assert topic_model.versions(spark, path) == [1]
    assert {r["topic"] for r in kept.info.collect()} == set(own.values())


def test_language_prompts_store_one_row_a_language(spark, tmp_path, monkeypatch):
    """The shortest texts are found without dealing all texts out by their language."""
    from wayfarer.operators import patterns
    from wayfarer.plans import cluster_queries

    rows = [(i, "word " * (1 + i % 7) + "ab"[i % 2], "en" if i % 3 else "de") for i in range(40)]
    rows += [(40, "only", "fr"), (41, None, "fr"), (42, "lost", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    kept, real = [], patterns.materialize
    monkeypatch.setattr(patterns, "materialize", lambda df, *a: kept.append(real(df, *a)) or kept[-1])
    got = {r["topic"]: r["prompt"] for r in cluster_queries.q_language_prompts(spark, str(tmp_path)).collect()}
    assert kept and all(df.count() <= 3 for df in kept)
    assert set(got) == {"en", "de", "fr"}
    for lang, prompt in got.items():
        texts = sorted({t for _, t, la in rows if la == lang and t is not None}, key=lambda t: (len(t), t))[:3]
        assert "\n".join(f"- {t}" for t in texts) in prompt
