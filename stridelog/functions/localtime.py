"""Customer-local calendar values of raw UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ts: Column, tz: str) -> Column:
    """Wall-clock time in ``tz`` of a zone-free UTC timestamp.

    The same value as ``convert_timezone('UTC', tz, ts)``, which resolves the zone anew for
    every row and took several times as long as the scan itself. ``from_utc_timestamp``
    resolves a constant zone once; taking only the offset from it, between whole seconds since
    the epoch, keeps the session time zone out of the result.
    """
    epoch = F.unix_timestamp(ts)
    shifted = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(epoch), tz))
    return ts + F.expr("INTERVAL '1' SECOND") * (shifted - epoch)


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(local_time(ts, tz))


def local_week(ts: Column, tz: str) -> Column:
    """Monday of the local week, as DATE."""
    return F.trunc(local_date(ts, tz), "week")


def local_month(ts: Column, tz: str) -> Column:
    """First day of the local month, as DATE."""
    return F.trunc(local_date(ts, tz), "month")
