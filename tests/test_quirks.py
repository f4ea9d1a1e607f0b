"""Kept quirks of the original pipeline (survey section 2.11)."""
import datetime as dt

from pyspark.sql import functions as F

from wayfarer.operators import clean, journeys
from wayfarer.plans.journey_plan import build_journeys

SCHEMA = ("event_id bigint, user_pseudo_id string, event_date date, "
          "event_timestamp timestamp_ntz, event_name string, ga_session_id string, "
          "ga_session_number bigint, session_engaged bigint, page_location string, "
          "page_title string, campaign string, source string, medium string, "
          "source_medium string, geo_region string, geo_city string, device_category string")
DAY = dt.date(2024, 1, 5)


def row(i, user, ts, name, loc=None, source="google", medium="cpc", sm="google / cpc",
        engaged=1):
    return (i, user, DAY, ts, name, f"{user}.s", 1, engaged, loc, "T", None, source, medium,
            sm, None, None, None)


def t(m, s=0):
    return dt.datetime(2024, 1, 5, 10, m, s)


def test_urlless_session_start_moves_only_when_sharing(spark):
    rows = [row(1, "a", t(0), "session_start"), row(2, "a", t(0), "page_view", "https://x/p"),
            row(3, "a", t(5), "session_start"), row(4, "a", t(9), "page_view", "https://x/q")]
    c = clean.clean_events(spark.createDataFrame(rows, SCHEMA), "purchase", [])
    got = {(r.event_id, r.event_name): r.event_timestamp for r in c.collect()}
    assert got[(1, "session_start")] == t(0) - dt.timedelta(seconds=2)
    assert got[(3, "session_start")] == t(5)


def test_medium_rewrite_and_label_fallback(spark):
    rows = [row(1, "b", t(0), "session_start", "https://x/", source="Newsletter ",
                medium="(none)", sm="(not set)"),
            row(2, "b", t(1), "page_view", "https://x/a")]
    c = clean.clean_events(spark.createDataFrame(rows, SCHEMA), "purchase", [])
    ss = c.filter(F.col("event_name") == "session_start").first()
    assert ss.medium == "direct" and ss.source_medium == "(not set)"
    lab = journeys.label_events(c).filter(F.col("event_name") == "session_start").first()
    assert lab.label == "Originated from: newsletter"


def test_empty_removal_list_removes_nobody_and_null_mix(spark):
    rows = [row(i, "c", t(i), "page_view", f"https://x/jobs/{i}") for i in range(5)]
    rows += [row(10, "d", t(0), "session_start", "https://x/"),
             row(11, "d", t(1), "page_view", "https://x/a"),
             row(12, "d", t(2), "page_view", "https://x/b")]
    df = spark.createDataFrame(rows, SCHEMA)
    _, js = build_journeys(df, "purchase", ["/none/"], [], removal_phrases=[])
    got = {r.user_id: r for r in js.collect()}
    assert set(got) == {"c", "d"}
    assert got["c"]["(not set)"] is None          # no session start: NULL, not 0
    _, js2 = build_journeys(df, "purchase", ["/none/"], [], removal_phrases=["jobs"])
    assert {r.user_id for r in js2.collect()} == {"d"}


def test_engaged_ratio_may_exceed_one(spark):
    rows = [row(1, "e", t(0), "session_start", "https://x/"),
            row(2, "e", t(0), "page_view", "https://x/"),
            row(3, "e", t(1), "page_view", "https://x/a"),
            row(4, "e", t(2), "page_view", "https://x/b")]
    from wayfarer.operators import users
    c = clean.clean_events(spark.createDataFrame(rows, SCHEMA), "purchase", [])
    counts = users.user_counts(c).first()
    # four page-view rows (one a copy of the session start) over three instants
    assert counts.pageviews == 3 and counts.engaged_sessions == 1.33


def test_counts_round_like_numpy(spark):
    from wayfarer.operators.users import round_half_even
    df = spark.createDataFrame([(23, 40), (49, 40), (1, 8), (3, 8)], "k long, n long")
    got = [r.b for r in df.select(round_half_even(F.col("k") / F.col("n"), 2).alias("b")).collect()]
    assert got == [0.57, 1.23, 0.12, 0.38]


def test_rounding_sweep_matches_numpy(spark):
    import numpy as np

    from wayfarer.operators.users import round_half_even
    pairs = [(k, n) for n in range(1, 301) for k in range(0, 2 * n + 1)]
    df = spark.createDataFrame(pairs, "k long, n long")
    rows = df.select("k", "n", round_half_even(F.col("k") / F.col("n"), 2).alias("b")).collect()
    assert all(r.b == float(np.round(r.k / r.n, 2)) for r in rows)
