"""Traffic-medium attribution per user (first / last / even credit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions import text as T

STRATEGIES = ("first", "last", "even")
NOT_SET = "(not set)"
MOST_COLUMNS = 1000


def medium_counts(clean: DataFrame) -> DataFrame:
    """Session starts per source_medium."""
    return (clean.filter(F.col("event_name") == "session_start")
            .groupBy("source_medium").agg(F.count(F.lit(1)).alias("count")))


def kept_mediums(clean: DataFrame, quantile: float = 0.10) -> DataFrame:
    """Categories whose count is strictly above the exact, interpolated quantile.

    The quantile is a scalar subquery over the category counts (one value per
    category, so its buffer is bounded by the number of categories).
    """
    counts = medium_counts(clean)
    q = counts.select(F.percentile("count", F.lit(quantile))).scalar()
    return (counts.filter(F.col("count") > q)
            .select("source_medium", "count",
                    T.medium_slug("source_medium").alias("medium_column")))


def medium_mix_long(clean: DataFrame, strategy: str = "first",
                    order_by: str = "name") -> DataFrame:
    """Attribution scores in long form: user_id, medium, medium_column, score.

    ``medium`` is the kept source_medium or ``(not set)``; ``medium_column`` is
    the wide column name.  ``order_by="name"`` ranks a user's mediums
    alphabetically, as the original does; ``"time"`` ranks them by the user's
    first session start with that medium.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {', '.join(STRATEGIES)}")
    if order_by not in ("name", "time"):
        raise ValueError("order_by must be 'name' or 'time'")
    ss = clean.filter(F.col("event_name") == "session_start") \
        .select("user_id", "source_medium", "event_timestamp")
    kept = kept_mediums(clean).select("source_medium", "medium_column")
    tagged = ss.join(kept.select("source_medium", F.lit(True).alias("_kept")), "source_medium", "left").select(
        "user_id", F.when(F.col("_kept"), F.col("source_medium")).otherwise(F.lit(NOT_SET)).alias("medium"),
        "event_timestamp")
    # One row per (user, medium) before any per-user window.  ``(not set)`` is one
    # class, whether it is a kept medium or stands for dropped ones.
    per = tagged.groupBy("user_id", "medium").agg(F.min("event_timestamp").alias("_first_seen"))
    per = per.join(kept.withColumnRenamed("source_medium", "medium"), "medium", "left").withColumn(
        "medium_column", F.coalesce("medium_column", F.lit(NOT_SET)))
    key = ["medium"] if order_by == "name" else ["_first_seen", "medium"]
    user = Window.partitionBy("user_id")
    if strategy == "even":
        score = F.lit(1.0) / F.count(F.lit(1)).over(user)
    else:
        asc = [F.col(k).asc() for k in key]
        desc = [F.col(k).desc() for k in key]
        w = user.orderBy(*(asc if strategy == "first" else desc))
        score = F.when(F.row_number().over(w) == 1, 1.0).otherwise(0.0)
    return per.select("user_id", "medium", "medium_column", score.alias("score"))


def medium_columns(mix_long: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """Sorted wide column names; more than ``most`` is an error, as the wide form is then unfit."""
    found = sorted(r[0] for r in mix_long.select("medium_column").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} mediums: name the wide columns or use the long form")
    return found


def medium_mix_wide(mix_long: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per user, one double column per medium (equal slugs are summed).

    Without ``columns`` the names are looked up, up to ``MOST_COLUMNS``.
    """
    cols = columns if columns is not None else medium_columns(mix_long)
    return (mix_long.groupBy("user_id").pivot("medium_column", cols)
            .agg(F.sum("score")).fillna(0.0, subset=cols))
