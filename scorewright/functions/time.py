"""Timestamps as whole microseconds, the unit every interval comparison here uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; zone-free timestamps are read in the session zone."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    """The zone-free timestamp of a microsecond count."""
    return F.timestamp_micros(value).cast("timestamp_ntz")


def floor_to(value: Column, width: int) -> Column:
    """Start of the width-wide slot that holds a microsecond count."""
    return value - F.pmod(value, F.lit(width).cast("bigint"))
