"""Event labels and the per-user ordered activity list (the journey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.text import join_path
from wayfarer.operators.clean import order_key

PAGE_REPRS = ("page_location", "page_title")


def label_events(events: DataFrame, page_repr: str = "page_location") -> DataFrame:
    """Add ``label``: page views name the page, session starts the origin."""
    if page_repr not in PAGE_REPRS:
        raise ValueError(f"unknown page_repr {page_repr!r}; use one of {', '.join(PAGE_REPRS)}")
    name = F.col("event_name")
    origin = F.concat(F.lit("Originated from: "), F.col("source_medium"))
    origin = F.when((origin == "Originated from: (not set)")
                    & (F.col("source") != "(not set)"),
                    F.concat(F.lit("Originated from: "), F.col("source"))).otherwise(origin)
    label = (F.when(name == "page_view",
                    F.concat(F.lit("Navigated to: "), F.col(page_repr)))
             .when(name == "session_start", origin).otherwise(F.lit("")))
    return events.withColumn("label", F.coalesce(label, F.lit("")))


def activity_lists(labelled: DataFrame) -> DataFrame:
    """user_id, activity_list: distinct non-empty labels in first-seen order.

    Labels are first reduced to one row per (user, label) with the earliest
    order key (a map-side combinable ``min``), so the per-user collect holds
    distinct labels only, never the raw event rows.
    """
    firsts = (labelled.filter(F.col("label") != "")
              .groupBy("user_id", "label")
              .agg(F.min(order_key()).alias("_first")))
    return firsts.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_first", "label"))),
                    lambda x: x["label"]).alias("activity_list"))


def aggregate_journeys(labelled: DataFrame) -> DataFrame:
    """Per-user journey summary over all remaining rows."""
    stats = labelled.groupBy("user_id").agg(
        F.count_distinct("event_date").alias("unique_days"),
        F.count_distinct("page_location").alias("unique_pages"),
        F.count_distinct("event_timestamp").alias("unique_pageviews"),
        F.sum("session_engaged").alias("_engaged"),
        F.count_distinct("ga_session_id").alias("total_sessions"),
    )
    lists = activity_lists(labelled)
    ratio = F.coalesce(F.try_divide(F.col("_engaged").cast("double"),
                                    F.col("unique_pageviews").cast("double")), F.lit(0.0))
    out = stats.join(lists, "user_id", "left").select(
        "user_id", "unique_days", "unique_pages", "unique_pageviews",
        ratio.alias("engaged_sessions"), "total_sessions",
        F.coalesce("activity_list", F.array().cast("array<string>")).alias("activity_list"))
    return out.withColumn("activity_list_text", join_path("activity_list"))


def flag_converted(df: DataFrame, converter_users: DataFrame) -> DataFrame:
    """Add ``converted`` (1 when the user has the goal event, else 0)."""
    flags = converter_users.select("user_id", F.lit(1).alias("_conv"))
    return df.join(flags, "user_id", "left").withColumn(
        "converted", F.coalesce("_conv", F.lit(0)).cast("int")).drop("_conv")
