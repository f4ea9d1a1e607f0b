import pytest
from pyspark.sql import functions as F

from wayfarer.operators import attribution as A
from wayfarer.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clean(spark):
    return catalog.stages(spark, SF).clean


@pytest.mark.parametrize("strategy", ["first", "last"])
def test_one_credit_per_user(clean, strategy):
    mix = A.medium_mix_long(clean, strategy)
    per = mix.groupBy("user_id").agg(F.sum("score").alias("s"), F.max("score").alias("m"))
    assert per.filter((F.col("s") != 1.0) | (F.col("m") != 1.0)).count() == 0


def test_first_is_alphabetical(clean):
    mix = A.medium_mix_long(clean, "first").collect()
    by_user = {}
    for r in mix:
        by_user.setdefault(r.user_id, []).append((r.medium, r.score))
    for rows in by_user.values():
        assert min(rows)[1] == 1.0


def test_even_sums_to_one(clean):
    mix = A.medium_mix_long(clean, "even")
    s = mix.groupBy("user_id").agg(F.sum("score").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in s)


def test_time_order_option(clean):
    mix = A.medium_mix_long(clean, "first", order_by="time")
    assert mix.groupBy("user_id").agg(F.sum("score").alias("s")) \
        .filter(F.col("s") != 1.0).count() == 0


def test_bad_strategy(clean):
    with pytest.raises(ValueError):
        A.medium_mix_long(clean, "linear")


def test_quantile_cut_interpolates(spark):
    rows = [("a / x",)] * 1 + [("b / x",)] * 2 + [("c / x",)] * 10 + [("d / x",)] * 20
    df = spark.createDataFrame([(f"u{i}", "session_start", sm) for i, (sm,) in enumerate(rows)],
                               "user_id string, event_name string, source_medium string")
    kept = {r.source_medium for r in A.kept_mediums(df).collect()}
    # q = 1.3 (linear), so only the category counted once is cut.
    assert kept == {"b / x", "c / x", "d / x"}


def test_wide_form_sums_equal_slugs(spark):
    long = spark.createDataFrame(
        [("u1", "a b", "medium_a_b", 0.5), ("u1", "a-b", "medium_a_b", 0.5)],
        "user_id string, medium string, medium_column string, score double")
    wide = A.medium_mix_wide(long).first()
    assert wide.medium_a_b == 1.0
