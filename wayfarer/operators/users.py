"""Per-user counts, page-count band, removals, converters, conversion cut."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as T

# The columns of the page-band table.
MULTI_COLUMNS = [
    "user_id", "page_location", "page_title", "event_date", "event_name",
    "event_timestamp", "event_timestamp_sec", "event_timestamp_diff", "geo_region",
    "geo_city", "device_category", "campaign", "source", "medium", "source_medium",
    "ga_session_id", "session_engaged",
]


def round_half_even(x: F.Column, digits: int) -> F.Column:
    """numpy's rounding: scale, round half-even on the binary value, unscale.

    ``bround(x, 2)`` rounds the shortest decimal form instead, so 0.575
    (stored as 0.57499999...) would become 0.58 rather than 0.57.
    """
    scale = float(10 ** digits)
    return F.bround(x * F.lit(scale), 0) / F.lit(scale)


def user_counts(clean: DataFrame) -> DataFrame:
    """Page-view counts per user; engaged_sessions rounded half-even to 2.

    Several distinct counts in one aggregate run as an expand + two-level
    aggregation, so a user with a huge share of rows is still split by value
    before the final per-user merge.
    """
    pv = clean.filter(F.col("event_name") == "page_view")
    g = pv.groupBy("user_id").agg(
        F.count_distinct("event_date").alias("unique_days"),
        F.count_distinct("page_location").alias("unique_pages"),
        F.count_distinct("event_timestamp").alias("pageviews"),
        F.sum("session_engaged").alias("_engaged"),
        F.count_distinct("ga_session_id").alias("total_sessions"),
    )
    ratio = round_half_even(F.col("_engaged") / F.col("pageviews"), 2)
    return g.select("user_id", "unique_days", "unique_pages", "pageviews",
                    ratio.alias("engaged_sessions"), "total_sessions")


def converters(clean: DataFrame, goal_event: str) -> DataFrame:
    """Distinct users with the goal event (never collected)."""
    return (clean.filter(F.col("event_name") == goal_event)
            .select("user_id").distinct())


def multi_page_users(counts: DataFrame, low: int = 2, high: int = 75) -> DataFrame:
    """Users strictly inside the page-count band."""
    return counts.filter((F.col("unique_pages") > low) & (F.col("unique_pages") < high)) \
        .select("user_id")


def multi_page_events(clean: DataFrame, counts: DataFrame) -> DataFrame:
    """Events of band users, 17 columns plus the ``event_id`` tie-break."""
    users = multi_page_users(counts)
    return clean.join(users, "user_id", "left_semi").select(*MULTI_COLUMNS, "event_id")


def removed_users(events: DataFrame, removal_phrases: Iterable[str]) -> DataFrame:
    """Users who saw a page whose location holds a removal phrase."""
    rx = T.phrase_regex(removal_phrases)
    if rx is None:
        return events.select("user_id").limit(0)
    return events.filter(F.col("page_location").rlike(rx)).select("user_id").distinct()


def remove_users(events: DataFrame, removal_phrases: Iterable[str]) -> DataFrame:
    """Drop every row of a user who saw a removal phrase (the user, not the row)."""
    if T.phrase_regex(removal_phrases) is None:
        return events
    return events.join(removed_users(events, removal_phrases), "user_id", "left_anti")


def normalise_paths(conversion_page_path: Iterable[str]) -> list[str]:
    if isinstance(conversion_page_path, str):
        raise TypeError("conversion_page_path must be a list of paths, not a str")
    out = []
    for p in conversion_page_path:
        x = p.strip()
        for sep in ("?", "#"):
            x = x.split(sep, 1)[0]
        for scheme in ("http://", "https://"):
            if x.startswith(scheme):
                rest = x[len(scheme):]
                x = rest[rest.index("/"):] if "/" in rest else ""
                break
        x = x.strip().lower()
        if not x:
            raise ValueError(f"conversion path {p!r} is empty; name the home page as '/'")
        out.append(x.rstrip("/") + "/")
    return out


def first_conversion(events: DataFrame, conversion_page_path: Iterable[str]) -> DataFrame:
    """Earliest timestamp per user on a conversion page (any event kind)."""
    paths = normalise_paths(conversion_page_path)
    return (events.filter(F.col("page_location").isin(paths))
            .groupBy("user_id")
            .agg(F.min("event_timestamp").alias("first_conversion_timestamp")))


def cut_at_conversion(events: DataFrame, conversion_page_path: Iterable[str]) -> DataFrame:
    """Keep rows strictly before the user's first conversion page view."""
    fc = first_conversion(events, conversion_page_path)
    out = events.join(fc, "user_id", "left").filter(
        F.col("first_conversion_timestamp").isNull()
        | (F.col("event_timestamp") < F.col("first_conversion_timestamp")))
    return out.drop("first_conversion_timestamp", "event_timestamp_sec")


def journey_users(clean: DataFrame, removal_phrases: Iterable[str],
                  conversion_page_path: Iterable[str], low: int = 2,
                  high: int = 75) -> DataFrame:
    """Users kept for journeys, with their first conversion time, in one pass.

    Band, removal and first conversion are all per-user facts over the cleaned
    events, so one combinable aggregate replaces the semi, anti and left joins
    of the step-by-step form (same rows: removal and conversion look only at
    band users' own rows).
    """
    rx = T.phrase_regex(removal_phrases)
    paths = normalise_paths(conversion_page_path)
    loc, name = F.col("page_location"), F.col("event_name")
    aggs = [
        F.count_distinct(F.when(name == "page_view", loc)).alias("_pages"),
        F.min(F.when(loc.isin(paths), F.col("event_timestamp")))
        .alias("first_conversion_timestamp"),
    ]
    if rx is not None:
        aggs.append(F.max(loc.rlike(rx).cast("int")).alias("_removed"))
    per = clean.groupBy("user_id").agg(*aggs)
    keep = (F.col("_pages") > low) & (F.col("_pages") < high)
    if rx is not None:
        keep = keep & (F.col("_removed") == 0)
    return per.filter(keep).select("user_id", "first_conversion_timestamp")


def journey_events(clean: DataFrame, removal_phrases: Iterable[str],
                   conversion_page_path: Iterable[str]) -> DataFrame:
    """Band users' events, removed users dropped, cut before first conversion."""
    users = journey_users(clean, removal_phrases, conversion_page_path)
    out = clean.join(users, "user_id").filter(
        F.col("first_conversion_timestamp").isNull()
        | (F.col("event_timestamp") < F.col("first_conversion_timestamp")))
    return out.select(*[c for c in MULTI_COLUMNS if c != "event_timestamp_sec"], "event_id")
