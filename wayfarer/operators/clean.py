"""Event cleaning: flat clickstream rows -> cleaned, time-ordered events.

Order of the steps matters and follows the original pipeline:
relevant events, null keys, engaged default, user id, PII users, session
starts copied as page views, page views without URL, null timestamps,
duplicate-instant session starts moved back 2 s, epoch seconds and the gap to
the user's previous event, defaults, lower-casing, URL and title rules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions import text as T
from wayfarer.functions.timeutil import epoch_seconds

# Fixed value: the mark that redacted user ids hold.
PII_MARK = "___PII_REDACTED___"

# Fixed default values of the cleaning step.
FILL_DEFAULTS = {
    "campaign": "(not set)",
    "medium": "(not set)",
    "source_medium": "(not set)",
    "source": "(not set)",
    "page_location": "/",
    "page_title": "(not set)",
}

CLEAN_COLUMNS = [
    "event_id", "user_id", "event_date", "event_name", "event_timestamp",
    "event_timestamp_sec", "event_timestamp_diff", "geo_region", "geo_city",
    "device_category", "campaign", "source", "medium", "source_medium",
    "ga_session_id", "ga_session_number", "session_engaged", "page_location",
    "page_title",
]


def event_rank(name_col="event_name") -> F.Column:
    """Tie-break rank inside one instant: session_start, page_view, the rest."""
    n = F.col(name_col)
    return F.when(n == "session_start", 0).when(n == "page_view", 1).otherwise(2)


def order_key(ts="event_timestamp", name="event_name", eid="event_id") -> F.Column:
    """Deterministic time order of a user's events (ties broken by kind, id)."""
    return F.struct(F.col(ts).alias("ts"), event_rank(name).alias("rank"),
                    F.col(eid).alias("event_id"))


def _with_event_id(flat: DataFrame) -> DataFrame:
    if "event_id" in flat.columns:
        return flat
    # Sources without an id get a content hash as the final tie-break.
    return flat.withColumn("event_id", F.xxhash64(*[F.col(c) for c in flat.columns]))


def gap_within_bucket(df: DataFrame, user="user_id", sec="event_timestamp_sec",
                      bucket_seconds: int = 3600) -> DataFrame:
    """First half of the gap: ``_bucket`` and the lag inside (user, bucket).

    A plain ``lag`` over ``partitionBy(user)`` puts each user in one task; a
    single bot user can hold a large share of all rows.  The lag runs inside
    (user, time bucket) groups instead; ``carry_gap`` fills the first row of
    each bucket.
    """
    b = F.floor(F.col(sec) / F.lit(bucket_seconds)).cast("long")
    df = df.withColumn("_bucket", b)
    w_in = Window.partitionBy(user, "_bucket").orderBy(order_key())
    return df.withColumn("_prev", F.lag(sec).over(w_in))


def carry_gap(df: DataFrame, user="user_id", sec="event_timestamp_sec") -> DataFrame:
    """Second half: the first row of a bucket takes the last second of the
    user's previous non-empty bucket, from a one-row-per-(user, bucket) summary.
    Gives ``event_timestamp_diff`` (seconds since the previous event, 0 first)."""
    last = df.groupBy(user, "_bucket").agg(F.max(sec).alias("_last"))
    carry = last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(user).orderBy("_bucket"))
    ).select(user, "_bucket", "_carry")
    df = df.join(carry, [user, "_bucket"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    gap = F.coalesce(F.col(sec) - prev, F.lit(0)).cast("double")
    return df.withColumn("event_timestamp_diff", gap).drop("_bucket", "_prev", "_carry")


def previous_event_gap(df: DataFrame, user="user_id", sec="event_timestamp_sec",
                       bucket_seconds: int = 3600) -> DataFrame:
    """Seconds since the user's previous event (0 for the first), as double."""
    return carry_gap(gap_within_bucket(df, user, sec, bucket_seconds), user, sec)


def relevant_events(flat: DataFrame, goal_event: str) -> DataFrame:
    """Relevant events with usable keys, cleaned ids, and no PII users."""
    df = _with_event_id(flat)
    df = df.filter(F.col("event_name").isin("session_start", "page_view", goal_event))
    if dict(df.dtypes)["event_timestamp"] == "string":
        # Text that is no timestamp becomes null, and its row goes with the null keys.
        df = df.withColumn("event_timestamp", F.expr("try_cast(event_timestamp AS timestamp_ntz)"))
    df = df.dropna(subset=["user_pseudo_id", "event_timestamp", "event_name"])
    df = df.withColumn("session_engaged",
                       F.coalesce(F.col("session_engaged").cast("long"), F.lit(0)).cast("long"))
    df = df.withColumn("user_pseudo_id",
                       F.translate(F.col("user_pseudo_id").cast("string"), ".", "_"))
    return df.filter(~F.col("user_pseudo_id").contains(PII_MARK))


def clean_events(flat: DataFrame, goal_event: str, brand: Iterable[str],
                 bucket_seconds: int = 3600) -> DataFrame:
    """Cleaned events (schema ``CLEAN_COLUMNS``) from flat clickstream rows."""
    return finish_clean(clean_base(flat, goal_event, brand, bucket_seconds))


def finish_clean(base: DataFrame) -> DataFrame:
    """Add the cross-bucket part of the gap and fix the column order."""
    return carry_gap(base).select(*CLEAN_COLUMNS)


def clean_base(flat: DataFrame, goal_event: str, brand: Iterable[str],
               bucket_seconds: int = 3600) -> DataFrame:
    """Every cleaning step up to the within-bucket gap (see ``finish_clean``).

    ``finish_clean`` reads this twice (rows and per-bucket summary); callers
    that write the result once can persist this base around the write.
    """
    T.brand_pattern(brand)  # validates the argument early
    df = relevant_events(flat, goal_event)

    # Session starts with a URL are also page views: one scan, explode in place.
    copy = (F.col("event_name") == "session_start") & F.col("page_location").isNotNull()
    df = df.withColumn(
        "event_name",
        F.explode(F.when(copy, F.array(F.lit("session_start"), F.lit("page_view")))
                  .otherwise(F.array(F.col("event_name")))))
    df = df.filter(~((F.col("event_name") == "page_view") & F.col("page_location").isNull()))
    df = df.filter(F.col("event_timestamp").isNotNull())

    # Session starts sharing an instant with another event of the user move back 2 s.
    same_instant = Window.partitionBy("user_pseudo_id", "event_timestamp")
    shared = F.count(F.lit(1)).over(same_instant) > 1
    moved = (F.col("event_name") == "session_start") & shared
    df = df.withColumn(
        "event_timestamp",
        F.when(moved, F.col("event_timestamp") - F.expr("INTERVAL 2 SECONDS"))
        .otherwise(F.col("event_timestamp")))
    df = df.withColumnRenamed("user_pseudo_id", "user_id")
    df = df.withColumn("event_timestamp_sec", epoch_seconds("event_timestamp"))
    df = gap_within_bucket(df, bucket_seconds=bucket_seconds)

    df = df.fillna(FILL_DEFAULTS)
    for c in ("campaign", "source", "medium", "source_medium"):
        df = df.withColumn(c, T.strip_lower(c))
    df = df.withColumn("medium", F.when(F.col("medium") == "(none)", "direct")
                       .otherwise(F.col("medium")))
    df = df.withColumn("page_location", T.url_path("page_location"))
    title = T.remove_brand(T.title_prefix("page_title"), brand)
    title = F.when(title == "", "(not set)").otherwise(title)
    title = F.when(F.col("page_location") == "/", "Home").otherwise(title)
    df = df.withColumn("page_title", title)
    keep = [c for c in CLEAN_COLUMNS if c != "event_timestamp_diff"]
    return df.select(*keep, "_bucket", "_prev")
