"""Sessions split at gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.localtime import local_time
from ..functions.numeric import seconds_between

SESSION_GAP_SECONDS = 1800


def bursts(rows: DataFrame, gap: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Collapse (user_id, ts) events to one row per user and aligned ``gap``-second slot.

    Two events in the same slot are less than ``gap`` seconds apart, hence in the same
    session, so nothing is lost by keeping only the slot's first and last timestamp and its
    count. The collapse runs on the map side and leaves at most 86400 / gap rows per user and
    day, however many events the user has.
    """
    slot = F.floor(F.unix_timestamp("ts") / F.lit(gap)).alias("slot")
    return rows.groupBy("user_id", slot).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def sessionize(slots: DataFrame, gap: int = SESSION_GAP_SECONDS) -> DataFrame:
    """(user_id, session_id, events, first_ts, last_ts) from ``bursts``.

    A session starts at the first event and after every pause of more than ``gap`` whole
    seconds. ``session_id`` counts the sessions of a user from 1. Extra columns that depend
    on the user only (a domain) may be joined before or after.
    """
    return _numbered(slots.withColumn("opens", F.lit(1)), gap)


def continue_sessions(
    last: DataFrame, slots: DataFrame, gap: int = SESSION_GAP_SECONDS
) -> DataFrame:
    """The sessions of ``slots`` after earlier events, of which only the ``last`` session is known.

    ``last`` has one row (user_id, session_id, events, first_ts, last_ts) per user, all before
    the slots. It comes out again, continued or not, with the sessions that follow it; numbers go
    on from its own. So events can be sessionized load by load, and the result is the same as for
    all of them together.
    """
    known = last.select(
        "user_id",
        F.lit(None).cast("bigint").alias("slot"),  # sorts first
        "events",
        "first_ts",
        "last_ts",
        F.col("session_id").alias("opens"),
    )
    new = slots.select("user_id", "slot", "events", "first_ts", "last_ts", F.lit(1).alias("opens"))
    return _numbered(known.unionByName(new), gap)


def _numbered(slots: DataFrame, gap: int) -> DataFrame:
    """Sessions of slots that add ``opens`` to the number of sessions if they open one."""
    by_user = W.partitionBy("user_id").orderBy("slot")
    pause = seconds_between(F.lag("last_ts").over(by_user), F.col("first_ts"))
    return (
        slots.withColumn("opens", F.when(pause <= gap, 0).otherwise(F.col("opens")))
        .withColumn("session_id", F.sum("opens").over(by_user))
        .groupBy("user_id", "session_id")
        .agg(
            F.sum("events").alias("events"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )


def derived_sessions(rows: DataFrame, tz: str, gap: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Sessions with local date and bounds, for (user_id, ts) events."""
    return described(sessionize(bursts(rows, gap), gap), tz)


def described(sessions: DataFrame, tz: str) -> DataFrame:
    """Local date and bounds of sessions."""
    start = local_time(F.col("first_ts"), tz)
    return sessions.select(
        "user_id",
        "session_id",
        F.to_date(start).alias("session_date"),
        start.alias("session_start"),
        local_time(F.col("last_ts"), tz).alias("session_end"),
        F.col("events").alias("event_count"),
        seconds_between(F.col("first_ts"), F.col("last_ts")).alias("duration_seconds"),
    )
