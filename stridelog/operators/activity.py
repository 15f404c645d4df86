"""Noise filtering, the unified activity stream and its per-user roll-ups.

Reports do not join raw events with the domain lookup. They first collapse the events to one
row per user and report key (a day, a month, a feature, ...), which Spark does on the map
side, and attribute those few rows afterwards. A user who owns a third of all events then
weighs no more in the join than any other user active on the same days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.localtime import local_date, local_month, local_time, local_week
from ..functions.text import like_prefix
from ..params import Params
from ..sources.tables import Tables
from .domains import domains_of
from .skew import spread_lookup

# --- Fixed values: event names that carry no user intent. ----------------------------------
NOISE_EVENTS = (
    "atlan_analaytics_aggregateinfo_fetch",
    "api_error_emit",
    "api_evaluator_cancelled",
    "api_evaluator_succeeded",
    "Experiment Started",
    "$experiment_started",
    "web_vital_metric_inp_track",
    "web_vital_metric_ttfb_track",
    "performance_metric_user_timing_discovery_search",
    "performance_metric_user_timing_app_bootstrap",
    "web_vital_metric_fcp_track",
    "web_vital_metric_lcp_track",
)
WORKFLOW_PATTERN = "workflow_%"
# --- End of fixed values. ------------------------------------------------------------------


def drop_noise(tracks: DataFrame, include_workflows: bool = False) -> DataFrame:
    """Tracked events without noise; events without a name are noise too.

    The ``_`` in the workflow pattern is a wildcard: "workflow" alone is kept, any longer
    name starting with it is dropped.
    """
    event = F.col("event_text")
    kept = tracks.filter(event.isNotNull() & ~event.isin(*NOISE_EVENTS))
    return kept if include_workflows else kept.filter(~like_prefix(event, WORKFLOW_PATTERN))


def page_rows(t: Tables, start: datetime | None, end: datetime | None = None) -> DataFrame:
    """(user_id, ts, name, source, domain) of page views."""
    return t.pages_between(start, end).select(
        "user_id",
        F.col("timestamp").alias("ts"),
        "name",
        F.lit("page").alias("source"),
        "domain",
    )


def track_rows(
    t: Tables, p: Params, start: datetime | None, end: datetime | None = None
) -> DataFrame:
    """(user_id, ts, name, source) of tracked events without noise."""
    return drop_noise(t.tracks_between(start, end), p.include_workflows).select(
        "user_id",
        F.col("timestamp").alias("ts"),
        F.col("event_text").alias("name"),
        F.lit("track").alias("source"),
    )


def activity_events(t: Tables, p: Params) -> DataFrame:
    """Unified event log, one row per page view or kept event.

    Page views carry their own domain, events that of their user (NULL if unknown). The events
    of users who own a large share of them are dealt out evenly.
    """
    events = track_rows(t, p, p.start)
    tracks = spread_lookup(events, domains_of(t), "user_id", F.struct("ts", "name"))
    rows = tracks.unionByName(page_rows(t, p.start))
    ts = F.col("ts")
    return rows.select(
        "user_id",
        local_time(ts, p.tz).alias("event_ts"),
        local_date(ts, p.tz).alias("event_date"),
        local_week(ts, p.tz).alias("event_week"),
        local_month(ts, p.tz).alias("event_month"),
        "source",
        F.col("name").alias("activity_name"),
        "domain",
    )


def day_key(p: Params) -> Column:
    return local_date(F.col("ts"), p.tz).alias("event_date")


def week_key(p: Params) -> Column:
    return local_week(F.col("ts"), p.tz).alias("event_week")


def month_key(p: Params) -> Column:
    return local_month(F.col("ts"), p.tz).alias("event_month")


def roll_up(rows: DataFrame, keys: Sequence[Column | str], *measures: Column) -> DataFrame:
    """One row per (user_id, *keys) with events, first_ts, last_ts and further measures."""
    return rows.groupBy("user_id", *keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *measures,
    )


def own_domain_activity(
    pages: DataFrame, tracks: DataFrame, domains: DataFrame, keys: Sequence[Column | str]
) -> DataFrame:
    """(user_id, domain, *keys, events, first_ts, last_ts), page views by their own domain.

    Tracks are rolled up, then get their user's domain; those without one are dropped. Page
    views stay single rows (events = 1): they join nothing, so the report's own aggregate,
    which every caller applies next, combines them on the map side just as well.
    """
    attributed = roll_up(tracks, keys).join(domains, "user_id")
    views = pages.select(
        "user_id",
        "domain",
        *keys,
        F.lit(1).cast("bigint").alias("events"),
        F.col("ts").alias("first_ts"),
        F.col("ts").alias("last_ts"),
    )
    return views.unionByName(attributed)


def home_domain_activity(
    pages: DataFrame,
    tracks: DataFrame,
    domains: DataFrame,
    keys: Sequence[Column | str],
    *measures: Column,
) -> DataFrame:
    """As above, but page views too take their user's domain: one row per (user_id, *keys)."""
    rows = pages.drop("domain").unionByName(tracks)
    return roll_up(rows, keys, *measures).join(domains, "user_id")
