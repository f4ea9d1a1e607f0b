"""Time-zone independent timestamp helpers (TIMESTAMP_NTZ holds UTC wall-clock time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch, floored, in any session time zone.

    A TIMESTAMP is an instant already; a TIMESTAMP_NTZ is taken as UTC.
    """
    c = _col(ts)
    return F.when(F.typeof(c) == "timestamp", F.unix_seconds(c.cast("timestamp"))).otherwise(
        F.timestamp_diff("SECOND", epoch_ntz(), c.cast("timestamp_ntz")))


def from_epoch_micros(us) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) from epoch microseconds."""
    return F.timestamp_add("MICROSECOND", _col(us), epoch_ntz())

