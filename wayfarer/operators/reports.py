"""Text reports over the ranked tables (what the analyses print)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# The wording of the report lines below is fixed.


def divergence_report(top: DataFrame) -> DataFrame:
    """One text block per divergence row; the score is rounded half-even to 2."""
    score = F.bround("divergence_score", 2).cast("string")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Conversion Sequence: "), F.col("conversion_seq")),
        F.concat(F.lit("Non-Conversion Sequence: "), F.col("non_conversion_seq")),
        F.concat(F.lit("Diversion Node: "), F.col("diversion")),
        F.concat(F.lit("Diversion Score: "), score, F.lit(" Frequency: "),
                 F.col("non_conv_freq").cast("string")))
    return top.select("weight", "non_conv_freq", "non_conversion_seq", "conversion_seq",
                      text.alias("report"))


def pattern_report(patterns: DataFrame, top_n: int = 5) -> DataFrame:
    """``N. Count: f, Sequence: s`` for the top_n patterns (freq desc, text asc)."""
    ranked = patterns.orderBy(F.col("freq").desc(), F.col("sequence").asc()).limit(top_n)
    # At most top_n rows reach this window.
    order = Window.orderBy(F.col("freq").desc(), F.col("sequence").asc())
    rank = F.row_number().over(order)
    return ranked.select(rank.alias("rank"), F.concat(
        rank.cast("string"), F.lit(". Count: "), F.col("freq").cast("string"),
        F.lit(", Sequence: "), F.col("sequence")).alias("line"))


def by_pageviews(df: DataFrame, col: str = "pageviews") -> DataFrame:
    """Users by page views, most first (a global sort: for final reports only)."""
    return df.orderBy(F.col(col).desc(), F.col("user_id").asc())
