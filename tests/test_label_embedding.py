import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wayfarer.operators import label_embedding as L
from wayfarer.plans.topics import journey_topics


def sections(spark, n=240, seed=3):
    """Three sections of eight labels; a journey stays in one, some labels of a section never meet."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = i % 3
        some = [f"s{g}-{x}" for x in range(8)]
        half = some[:6] if rng.random() < 0.5 else some[2:]
        rows.append((f"u{i}", rng.sample(half, rng.randint(3, 5))))
    df = spark.createDataFrame(rows, "user_id string, activity_list array<string>")
    return rows, df.withColumn("activity_list_text", F.array_join("activity_list", " -> "))


def test_information_equals_counting(spark):
    rows, df = sections(spark, 60)
    n = Counter()
    for _, s in rows + [("x", ["a", None, "a", "b"])]:
        s = [x for x in s if x is not None]
        for i, a in enumerate(s):
            for b in s[i + 1:i + 3]:
                if a != b:
                    n[a, b] += 1
                    n[b, a] += 1
    own, total = Counter(), sum(n.values())
    for (a, _), c in n.items():
        own[a] += c
    want = {p: math.log(c * total / (own[p[0]] * own[p[1]])) for p, c in n.items()}
    odd = spark.createDataFrame([("x", ["a", None, "a", "b"]), ("y", None), ("z", [])], "user_id string, activity_list array<string>")
    got = L.neighbour_information(df.select("user_id", "activity_list").unionByName(odd)).collect()
    assert {(r["label"], r["neighbour"]) for r in got} == {p for p, w in want.items() if w > 1e-12}
    assert all(abs(r["w"] - want[r["label"], r["neighbour"]]) < 1e-9 for r in got)


def test_labels_of_a_section_lie_together_and_make_its_topic(spark):
    rows, df = sections(spark)
    labels = L.label_vectors(df, k=4)
    v = {r["label"]: np.array(r["v"]) for r in labels.collect()}
    assert len(v) == 24
    inside = [v[a] @ v[b] for a in v for b in v if a < b and a[:2] == b[:2]]
    across = [v[a] @ v[b] for a in v for b in v if a[:2] != b[:2]]
    assert min(inside) > max(across)
    # Labels that never meet in a journey, of one section.
    assert not any({"s0-0", "s0-7"} <= set(s) for _, s in rows) and v["s0-0"] @ v["s0-7"] > max(across)
    placed = L.embed_journeys(df, labels)
    res = journey_topics(df, min_topic_size=30, reduced=placed, n_docs=1)
    topic = {r["user_id"]: r["topic"] for r in res.assignments.collect()}
    named = [Counter(topic[f"u{i}"] for i in range(g, 240, 3)) for g in range(3)]
    sets = [set(c) - {-1} for c in named]
    assert all(sets) and not sets[0] & sets[1] and not sets[1] & sets[2] and not sets[0] & sets[2]
    odd = spark.createDataFrame([("n", ["unknown"]), ("m", None)], "user_id string, activity_list array<string>")
    assert {tuple(r["pca"].toArray()) for r in L.embed_journeys(odd, labels).collect()} == {(0.0,) * 4}
