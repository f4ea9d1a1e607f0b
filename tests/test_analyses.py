import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import importance, sampling, topics
from wayfarer.plans import catalog, review
from wayfarer.plans import topics as plan_topics


def planted(spark, n=300, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        conv = i % 2
        base = rnd.sample(list("abcdefgh"), 4)
        if conv and rnd.random() < 0.9:
            base = ["x", "y"] + base + ["z"]
        rows.append((f"u{i}", base, conv))
    return spark.createDataFrame(rows, "user_id string, activity_list array<string>, "
                                       "converted int")


def test_planted_pattern_ranks_first(spark):
    df = planted(spark)
    top = importance.sequence_importance(df, top_n=3, min_freq=20, min_seq_len=3,
                                         train_fraction=1.0).collect()
    assert top[0].sequence == "x -> y -> z" and top[0].importance > 0


def test_importance_matches_newton(spark):
    df = planted(spark, 200, 9)
    imp = importance.sequence_importance(df, top_n=1000, min_freq=15, min_seq_len=2,
                                         train_fraction=1.0)
    got = {r.sequence: r.importance for r in imp.collect()}
    feats = importance.sequence_features(df, importance.frequent_sequences(
        df, min_freq=15, min_len=2)).collect()
    names = sorted(got)
    x = np.array([[1.0 if n in set(r.contained) else 0.0 for n in names] for r in feats])
    y = np.array([r.converted for r in feats], dtype=float)
    xa = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xa.shape[1])
    for _ in range(50):  # Newton on 0.5*|w|^2 + sum(logloss), intercept unpenalised
        p = 1 / (1 + np.exp(-xa @ w))
        reg = np.r_[w[:-1], 0.0]
        g = xa.T @ (p - y) + reg
        h = xa.T @ (xa * (p * (1 - p))[:, None]) + np.diag(np.r_[np.ones(len(names)), 0.0])
        w -= np.linalg.solve(h, g)
    for i, n in enumerate(names):
        assert got[n] == pytest.approx(w[i], abs=1e-3)


def test_importance_requires_columns(spark):
    with pytest.raises(ValueError):
        importance.sequence_importance(spark.createDataFrame([(1,)], "x int"))


def test_balance_is_exact(spark):
    df = planted(spark, 101)
    out = sampling.balance_classes(df)
    counts = {r.converted: r["count"] for r in out.groupBy("converted").count().collect()}
    assert counts[0] == counts[1] == 50


def test_class_tfidf_against_pandas(spark):
    docs = [("a", "Apple apple banana x"), ("a", "Cherry apple"), ("b", "banana BANANA kiwi"),
            ("b", "Äpfel ä kiwi")]
    df = spark.createDataFrame(docs, "topic string, text string")
    got = {(r.topic, r.keyword): r.weight for r in topics.class_tfidf(df, top_k=50).collect()}
    import re
    words = [(t, w.lower()) for t, s in docs for w in re.findall(r"[^\W]{2,}", s)]
    pdf = pd.DataFrame(words, columns=["topic", "word"])
    tf = pdf.groupby(["topic", "word"]).size()
    size = tf.groupby(level=0).sum()
    f = tf.groupby(level=1).sum()
    a = float(int(size.mean()))
    want = {(t, w): round(c / size[t] * np.log(1 + a / f[w]), 9) for (t, w), c in tf.items()}
    assert got == pytest.approx(want)


def test_topics_on_three_vocabularies(spark):
    rnd = random.Random(2)
    rows = []
    for g, vocab in enumerate([list("abcd"), list("efgh"), list("ijkl")]):
        for i in range(60):
            seq = rnd.sample(vocab, 3)
            rows.append((f"g{g}-{i}", [f"Navigated to: /{s}/" for s in seq]))
    df = spark.createDataFrame(rows, "user_id string, activity_list array<string>") \
        .withColumn("activity_list_text", F.array_join("activity_list", " -> "))
    res = plan_topics.journey_topics(df, min_topic_size=30, cell_size=2.0)
    assign = {r.user_id: r.topic for r in res.assignments.collect()}
    groups = [{assign[f"g{g}-{i}"] for i in range(60)} for g in range(3)]
    assert all(len(s) == 1 and -1 not in s for s in groups)
    assert len(set.union(*groups)) == 3
    info = res.info.filter(F.col("topic") >= 0).collect()
    assert all(len(r.representative_docs) == 3 and len(r.keywords) > 0 for r in info)
    prompts = res.prompts.collect()
    assert all("[DOCUMENTS]" not in p.prompt and "- Navigated" in p.prompt for p in prompts)


def test_labeler_hook(spark):
    prompts = spark.createDataFrame([(0, "p0"), (1, "p1")], "topic int, prompt string")
    out = topics.label_topics(prompts, lambda s: "topic: label " + s)
    assert {r.topic: r.label for r in out.collect()} == {0: "label p0", 1: "label p1"}


def test_converter_review_runs(spark):
    j = catalog.journeys_df(spark, "/root/testdata/sf0.001")
    rep = review.converter_review(j, top_n=5)
    assert set(rep.columns) == {"kind", "sequence", "freq", "length"}
    with pytest.raises(ValueError):
        review.converter_review(j, reducer="umap")


def test_reduce_topics_merges_parallel(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import IntegerType, StructField, StructType
    schema = StructType([StructField("topic", IntegerType()), StructField("centroid", VectorUDT())])
    cen = spark.createDataFrame(
        [(0, Vectors.dense([1.0, 1.0, 0.0])), (1, Vectors.dense([2.0, 2.1, 0.0])),
         (2, Vectors.dense([0.0, 0.0, 1.0])), (-1, Vectors.dense([1.0, 1.0, 0.0]))],
        schema)
    got = {r.topic: r.merged for r in topics.reduce_topics(cen, 0.9).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_count_containing(spark):
    from wayfarer.operators.patterns import count_containing
    df = spark.createDataFrame([(list("abc"),), (list("acb"),), (list("xa"),)],
                               "activity_list array<string>")
    assert count_containing(df, ["a", "b"]).first()["count"] == 2
    assert count_containing(df, []).first()["count"] == 3


def test_representatives_see_every_distinct_text(spark):
    """Many rows of the text nearest the centroid are one candidate; all others reach MMR."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    vecs = {f"t{i:02}": rng.normal(size=3) + [4.0, 0.0, 0.0] for i in range(40)}
    vecs["many"] = np.array([4.0, 0.0, 0.0])
    rows = [(0, "many", Vectors.dense(vecs["many"]))] * 30
    rows += [(0, d, Vectors.dense(v)) for d, v in vecs.items() if d != "many"]
    rows += [(1, "only", Vectors.dense([0.0, 1.0, 0.0]))] * 12
    df = spark.createDataFrame(rows, ["topic", "doc", "embedding"])
    got = {r.topic: r.representative_docs for r in topics.representative_docs(df).collect()}

    unit = {d: v / np.linalg.norm(v) for d, v in vecs.items()}
    centre = sum(unit[d] * (30 if d == "many" else 1) for d in unit) / (len(rows) - 12)
    want = []
    for _ in range(3):
        score = {d: (0.5 if want else 1.0) * u @ centre - 0.5 * max([u @ unit[w] for w in want], default=0.0)
                 for d, u in unit.items() if d not in want}
        want.append(max(sorted(score), key=score.get))
    assert got == {0: want, 1: ["only"]}
