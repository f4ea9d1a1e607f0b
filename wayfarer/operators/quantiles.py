"""Exact quantiles without a single-buffer aggregate over all rows.

``percentile`` keeps every value in one aggregation buffer.  Here the value at a
rank is closed in on in rounds: the range that holds it is cut into equal
buckets, each round counts the buckets (a fixed number of rows, with their
smallest and largest value) and goes on inside the one that holds the rank, until
that bucket has a single value or so few rows that they can be looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets a round; no fewer than LEAST are used.
ACCURACY, LEAST = 1024, 16
#: Rows of a bucket that are looked at directly.
FEW = 4096


def values_at_ranks(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """Exact order statistics (0-based ranks in ascending order) of ``col``.

    Ranks beyond the non-null values are left out.
    """
    vals = df.select(F.col(col).alias("v")).filter(F.col("v").isNotNull())
    n, low, high = vals.agg(F.count("*"), F.min("v"), F.max("v")).head()
    return _values(vals, sorted({r for r in ranks if 0 <= r < n}), n, low, high)


def _values(vals: DataFrame, ranks: list[int], n: int, low, high) -> dict[int, float]:
    found: dict[int, float] = {}
    # (wanted ranks, rows below the range, rows in it, its smallest and largest value)
    ranges = [(ranks, 0, n, low, high)] if ranks else []
    while ranges:
        wanted, below, size, low, high = ranges.pop()
        if low == high:
            found.update((r, low) for r in wanted)
            continue
        inside = vals.filter(F.col("v").between(F.lit(low), F.lit(high)))
        if size <= FEW:
            values = sorted(r[0] for r in inside.collect())
            found.update((r, values[r - below]) for r in wanted)
            continue
        # Monotone in v, whatever rounding does; the ends fall into different buckets.
        place = F.floor((F.col("v") - F.lit(low)) / (F.lit(high) - F.lit(low)) * max(ACCURACY, LEAST))
        rows = inside.groupBy(place.alias("b")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(rows, key=lambda r: r["low"]):
            here = [x for x in wanted if below <= x < below + r["n"]]
            if here:
                ranges.append((here, below, r["n"], r["low"], r["high"]))
            below += r["n"]
    return found


def exact_percentile(df: DataFrame, col: str, q: float) -> float | None:
    """Linear-interpolated quantile (the pandas / numpy default), exactly."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    vals = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n, low, high = vals.agg(F.count("*"), F.min("v"), F.max("v")).head()
    if n == 0:
        return None
    pos = q * (n - 1)
    lower, upper = math.floor(pos), math.ceil(pos)
    got = _values(vals, sorted({lower, upper}), n, low, high)
    return got[lower] + (got[upper] - got[lower]) * (pos - lower)
