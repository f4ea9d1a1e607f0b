"""Properties that must hold whatever the data (fixture notes, section 5 item 4)."""
import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfarer.operators import clean, divergence, patterns
from wayfarer.plans import catalog
from wayfarer.plans.journey_plan import build_journeys
from wayfarer.sources import events_adapter as A

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def flat(spark):
    return catalog.flat_events(spark, SF)


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_journeys_unchanged_under_repartition(spark, flat):
    cols = ["user_id", "unique_pages", "unique_pageviews", "engaged_sessions",
            "activity_list_text", "converted"]
    _, a = build_journeys(flat, A.GOAL_EVENT, A.CONVERSION_PAGE_PATH, A.BRAND, with_mix=False)
    shuffled = flat.repartition(13, F.rand(seed=1)).sortWithinPartitions(F.rand(seed=2))
    _, b = build_journeys(shuffled, A.GOAL_EVENT, A.CONVERSION_PAGE_PATH, A.BRAND,
                          with_mix=False)
    assert rows(a, cols) == rows(b, cols)


def test_nothing_at_or_after_first_conversion(spark):
    st = catalog.stages(spark, SF)
    fc = (st.clean.filter(F.col("page_location").isin(A.CONVERSION_PAGE_PATH))
          .groupBy("user_id").agg(F.min("event_timestamp").alias("fc")))
    late = st.truncated.join(fc, "user_id").filter(F.col("event_timestamp") >= F.col("fc"))
    assert late.count() == 0


def test_gap_matches_plain_lag(spark, flat):
    c = clean.clean_events(flat, A.GOAL_EVENT, A.BRAND, bucket_seconds=1800)
    w = Window.partitionBy("user_id").orderBy(clean.order_key())
    plain = c.withColumn("g", F.coalesce(F.col("event_timestamp_sec")
                                         - F.lag("event_timestamp_sec").over(w), F.lit(0))
                         .cast("double"))
    assert plain.filter(F.col("g") != F.col("event_timestamp_diff")).count() == 0


def test_hot_user_with_a_third_of_rows(spark):
    base = dt.datetime(2024, 1, 1)
    n_hot, n_cold = 6000, 12000
    hot = [(i, "bot.1", base + dt.timedelta(seconds=37 * i), "page_view",
            f"https://h/p{i % 50}") for i in range(n_hot)]
    cold = [(n_hot + i, f"u.{i % 400}", base + dt.timedelta(seconds=101 * i), "page_view",
             f"https://h/p{i % 9}") for i in range(n_cold)]
    schema = "event_id bigint, user_pseudo_id string, event_timestamp timestamp_ntz, " \
             "event_name string, page_location string"
    df = spark.createDataFrame(hot + cold, schema).select(
        "*", F.col("event_timestamp").cast("date").alias("event_date"),
        F.lit("s").alias("ga_session_id"), F.lit(1).cast("bigint").alias("ga_session_number"),
        F.lit(1).cast("bigint").alias("session_engaged"), F.lit("t").alias("page_title"),
        F.lit(None).cast("string").alias("campaign"), F.lit("g").alias("source"),
        F.lit("m").alias("medium"), F.lit("g / m").alias("source_medium"),
        F.lit("r").alias("geo_region"), F.lit("c").alias("geo_city"),
        F.lit("d").alias("device_category"))
    c = clean.clean_events(df, "purchase", [])
    gaps = c.filter(F.col("user_id") == "bot_1").agg(
        F.sum("event_timestamp_diff").alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert gaps.n == n_hot and gaps.s == 37.0 * (n_hot - 1)
    events, journeys = build_journeys(df, "purchase", ["/none/"], [], removal_phrases=[])
    bot = journeys.filter(F.col("user_id") == "bot_1").first()
    assert bot.unique_pageviews == n_hot and len(bot.activity_list) == 50


def test_divergence_scores_in_unit_interval(spark):
    j = catalog.journeys_df(spark, SF)
    conv, non = divergence.class_patterns(j, 3, 3)
    cls = divergence.divergence_classes(non, conv)
    bad = cls.filter((F.col("score") < 0) | (F.col("score") >= 1))
    assert bad.count() == 0


def test_closed_patterns_have_no_equal_support_extension(spark):
    j = catalog.journeys_df(spark, SF)
    allp = patterns.all_frequent_sequences(j, min_freq=10)
    closed = patterns.closed_only(allp)
    ext = (allp.alias("q").join(closed.alias("p"), F.col("q.freq") == F.col("p.freq"))
           .filter((F.size("q.sequence") == F.size("p.sequence") + 1)))
    ext = ext.filter(F.exists(patterns.one_item_deletions(F.col("q.sequence")),
                              lambda d: d == F.col("p.sequence")))
    assert ext.count() == 0
