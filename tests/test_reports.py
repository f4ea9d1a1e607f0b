import pandas as pd
from pyspark.sql import functions as F

from wayfarer.operators import reports, topics


def test_divergence_report_text(spark):
    top = spark.createDataFrame([("A -> B", "A -> C", "C", 0.125, 4, 0.5)],
                                "conversion_seq string, non_conversion_seq string, "
                                "diversion string, divergence_score double, "
                                "non_conv_freq bigint, weight double")
    text = reports.divergence_report(top).first().report
    assert text.splitlines() == ["Conversion Sequence: A -> B",
                                 "Non-Conversion Sequence: A -> C", "Diversion Node: C",
                                 "Diversion Score: 0.12 Frequency: 4"]


def test_pattern_report_and_ranking(spark):
    pats = spark.createDataFrame([("a -> b", 3), ("a -> c", 5), ("b -> c", 3)],
                                 "sequence string, freq bigint")
    lines = [r.line for r in reports.pattern_report(pats, 2).orderBy("rank").collect()]
    assert lines == ["1. Count: 5, Sequence: a -> c", "2. Count: 3, Sequence: a -> b"]
    users = spark.createDataFrame([("u2", 3), ("u1", 3), ("u3", 9)], "user_id string, pageviews int")
    assert [r.user_id for r in reports.by_pageviews(users).collect()] == ["u3", "u1", "u2"]


def test_pluggable_embedder_gets_instruction(spark):
    def embedder(batches):
        for pdf in batches:
            assert (pdf["instruction"] == "intent").all()
            yield pd.DataFrame({"id": pdf["id"],
                                "embedding": [[float(len(t)), 1.0] for t in pdf["text"]]})

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "user_id int, activity_list_text string")
    out = topics.embed_with(df, embedder, "intent", "user_id", "activity_list_text")
    got = {r.user_id: r.embedding.toArray().tolist() for r in out.collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0]}
    try:
        topics.embed_with(df, embedder, "", "user_id", "activity_list_text")
        raise AssertionError("empty instruction accepted")
    except ValueError:
        pass
    assert out.filter(F.size(F.lit([1])) > 0).count() == 2
