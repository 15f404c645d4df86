"""Depth of use: sessions, activity tiers, power users, daily distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.localtime import local_date, local_month
from ..functions.numeric import (
    mean,
    minutes_between,
    pct,
    ratio,
    round_half_up,
    seconds_between,
)
from ..functions.taxonomy import BREADTH
from ..operators.activity import (
    day_key,
    home_domain_activity,
    month_key,
    page_rows,
    track_rows,
)
from ..operators.domains import domains_of
from ..operators.sessions import bursts, sessionize
from ..params import Params
from ..sources.tables import Tables


def _domain_sessions(t: Tables, p: Params) -> DataFrame:
    """Sessions of the users attributed to the domain.

    Users are selected after the collapse to bursts and before the window, so the join moves
    neither raw events nor other customers' sessions.
    """
    rows = (
        page_rows(t, p.start)
        .select("user_id", "ts")
        .unionByName(track_rows(t, p, p.start).select("user_id", "ts"))
    )
    members = domains_of(t, p.require_domain()).select("user_id")
    return sessionize(bursts(rows).join(members, "user_id"))


def _length_report(sessions: DataFrame, period: str, length: str) -> DataFrame:
    """Counts, users and length statistics of the sessions per period.

    Sessions collapse to a histogram (period, length) in one hash aggregate; the exact median
    is then a weighted percentile over the few distinct lengths. Distinct users are counted
    by marking each user's first session of the period: the sessions lie together by user
    already, so that needs no further exchange.
    """
    in_period = W.partitionBy("user_id", period).orderBy("session_id")
    histogram = (
        sessions.withColumn("first", F.row_number().over(in_period) == 1)
        .groupBy(period, length)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("first").alias("users"),
            F.sum("events").alias("events"),
        )
    )
    n = F.sum("n")
    return histogram.groupBy(period).agg(
        n.alias("total_sessions"),
        F.sum("users").alias("unique_users"),
        mean(F.sum(F.col(length) * F.col("n")), n).alias("avg_length"),
        F.percentile(length, 0.5, F.col("n")).alias("median_length"),
        mean(F.sum("events"), n).alias("avg_events_per_session"),
        F.max(length).alias("max_length"),
    )


def session_duration(t: Tables, p: Params) -> DataFrame:
    """Sessions per local month: length in minute boundaries crossed, events.

    Sessions of one event, of no minute and of eight hours or more are left out.
    """
    sessions = (
        _domain_sessions(t, p)
        .filter(F.col("events") > 1)
        .withColumn("minutes", minutes_between(F.col("first_ts"), F.col("last_ts")))
        .filter((F.col("minutes") > 0) & (F.col("minutes") < 480))
        .withColumn("session_month", local_month(F.col("first_ts"), p.tz))
    )
    return (
        _length_report(sessions, "session_month", "minutes")
        .select(
            F.lit(p.domain).alias("domain"),
            "session_month",
            "total_sessions",
            "unique_users",
            F.col("avg_length").alias("avg_session_minutes"),
            F.col("median_length").alias("median_session_minutes"),
            "avg_events_per_session",
            F.col("max_length").alias("max_session_minutes"),
        )
        .orderBy(F.desc("session_month"))
    )


def session_duration_daily(t: Tables, p: Params) -> DataFrame:
    """Sessions per local day: length in seconds, events.

    Sessions of one event, of no second and of eight hours or more are left out.
    """
    sessions = (
        _domain_sessions(t, p)
        .filter(F.col("events") > 1)
        .withColumn("seconds", seconds_between(F.col("first_ts"), F.col("last_ts")))
        .filter((F.col("seconds") > 0) & (F.col("seconds") < 28800))
        .withColumn("session_date", local_date(F.col("first_ts"), p.tz))
    )
    return (
        _length_report(sessions, "session_date", "seconds")
        .select(
            "session_date",
            "total_sessions",
            "unique_users",
            F.col("avg_length").alias("avg_duration_seconds"),
            F.col("median_length").alias("median_duration_seconds"),
            "avg_events_per_session",
            F.col("max_length").alias("max_duration_seconds"),
        )
        .orderBy(F.desc("session_date"))
    )


def actions_per_session(t: Tables, p: Params) -> DataFrame:
    """Events per session and local month; sessions of one event count.

    The 90th percentile interpolates between integers at a tenth, so one decimal is exact.
    """
    histogram = (
        _domain_sessions(t, p)
        .groupBy(local_month(F.col("first_ts"), p.tz).alias("event_month"), "events")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n, weight = F.sum("n"), F.col("n")
    return (
        histogram.groupBy("event_month")
        .agg(
            n.alias("total_sessions"),
            mean(F.sum(F.col("events") * weight), n).alias("avg_actions_per_session"),
            F.percentile("events", 0.5, weight).alias("median_actions_per_session"),
            F.round(F.percentile("events", 0.9, weight), 1).alias("p90_actions"),
        )
        .select(
            F.lit(p.domain).alias("domain"),
            "event_month",
            "total_sessions",
            "avg_actions_per_session",
            "median_actions_per_session",
            "p90_actions",
        )
        .orderBy(F.desc("event_month"))
    )


def engagement_tiers(t: Tables, p: Params) -> DataFrame:
    """Users per activity tier and month.

    All users of the domain are ranked in every month with activity: none -> Dormant, percent
    rank >= 0.9 among all -> Power, at least the median of the active -> Heavy, else Light.

    A user's tier depends on the number of events only, so the ranking runs over the
    histogram (month, events, users) instead of over the users: no window holds a domain's
    users and no users x months product is built. ``percent_rank`` is the share of the other
    users with fewer events, compared in integers.
    """
    members = domains_of(t, p.require_domain())
    user_months = home_domain_activity(
        page_rows(t, p.start), track_rows(t, p, p.start), members, [month_key(p)]
    )
    histogram = user_months.groupBy("event_month", "events").agg(F.count("user_id").alias("n"))
    size = F.broadcast(members.agg(F.count(F.lit(1)).alias("members")))  # one row

    month = W.partitionBy("event_month")
    fewer = F.sum("n").over(
        month.orderBy("events").rowsBetween(W.unboundedPreceding, -1)
    )
    dormant = F.col("members") - F.sum("n").over(month)
    below = dormant + F.coalesce(fewer, F.lit(0))
    others = F.col("members") - 1
    median = F.percentile("events", 0.5, F.col("n")).over(month)
    tiers = histogram.crossJoin(size).select(
        "event_month",
        "members",
        "n",
        F.when((others > 0) & (below * 10 >= others * 9), "Power")
        .when(F.col("events") >= median, "Heavy")
        .otherwise("Light")
        .alias("tier"),
    )
    idle = (
        histogram.groupBy("event_month")
        .agg(F.sum("n").alias("active"))
        .crossJoin(size)
        .select(
            "event_month",
            "members",
            (F.col("members") - F.col("active")).alias("n"),
            F.lit("Dormant").alias("tier"),
        )
        .filter(F.col("n") > 0)
    )
    ranks = F.array(*[F.lit(tier) for tier in ("Power", "Heavy", "Light", "Dormant")])
    return (
        tiers.unionByName(idle)
        .groupBy("event_month", "members", "tier")
        .agg(F.sum("n").alias("user_count"))
        .select(
            "event_month",
            "tier",
            "user_count",
            pct(F.col("user_count"), F.col("members")).alias("pct_of_users"),
        )
        .orderBy(F.desc("event_month"), F.array_position(ranks, F.col("tier")))
    )


def power_users(t: Tables, p: Params) -> DataFrame:
    """The 25 best rows by a score of active days (40), breadth (30) and log volume (30).

    Page views without a name do not count. The score is NULL, and sorts first, if nobody
    used any feature. A user with several (email, username) pairs gets one row for each; the
    25 best users are fixed before that join, which cannot bring in any other user.
    """
    members = domains_of(t, p.require_domain())
    name = F.col("name")
    bits, none = BREADTH.bits(), F.lit(0)
    pages = (
        page_rows(t, p.start)
        .filter(name.isNotNull())
        .withColumn("area", F.coalesce(BREADTH.page_label(name, bits), none))
    )
    tracks = track_rows(t, p, p.start).withColumn(
        "area", F.coalesce(BREADTH.event_label(name, bits), none)
    )
    # One row per user and day, features as bits: days and features need no distinct count.
    totals = (
        home_domain_activity(pages, tracks, members, [day_key(p)], F.bit_or("area").alias("areas"))
        .groupBy("user_id")
        .agg(
            F.sum("events").alias("total_events"),
            F.count("event_date").alias("active_days"),
            F.bit_count(F.bit_or("areas")).cast("bigint").alias("feature_breadth"),
        )
    )
    best = totals.agg(  # one row
        F.max("active_days").alias("max_days"),
        F.max("feature_breadth").alias("max_breadth"),
        F.ln(1 + F.max("total_events")).alias("max_volume"),
    )
    score = (
        F.lit(40.0) * F.col("active_days") / F.nullif("max_days", F.lit(0))
        + F.lit(30.0) * F.col("feature_breadth") / F.nullif("max_breadth", F.lit(0))
        + F.lit(30.0) * F.ln(1 + F.col("total_events")) / F.nullif("max_volume", F.lit(0.0))
    )
    order = [F.desc_nulls_first("power_score"), F.col("user_id")]
    top = (
        totals.crossJoin(F.broadcast(best))
        .select(
            "user_id",
            "total_events",
            "active_days",
            "feature_breadth",
            round_half_up(score, 1).alias("power_score"),
        )
        .orderBy(*order)
        .limit(25)
    )
    top_ids = F.broadcast(top.select(F.col("user_id").alias("id")))  # at most 25 rows
    names = (
        t.users.join(top_ids, "id", "left_semi")
        .groupBy(F.col("id").alias("user_id"), "email", "username")
        .agg(F.max("role").alias("role"), F.max("job_role").alias("job_role"))
    )
    return (
        top.join(names, "user_id", "left")
        .select(
            "user_id",
            "email",
            "username",
            "role",
            "job_role",
            "total_events",
            "active_days",
            "feature_breadth",
            "power_score",
        )
        .orderBy(*order, F.asc_nulls_last("email"), F.asc_nulls_last("username"))
        .limit(25)
    )


def daily_engagement_matrix(t: Tables, p: Params) -> DataFrame:
    """Users per local day and band of daily events.

    The second count is of users with a session that day. Every event belongs to a session,
    so it always equals the first; no sessions are computed for it.
    """
    events = F.col("events")
    band = (
        F.when(events == 0, "0 events")
        .when(events.between(1, 4), "1-4 events")
        .when(events.between(5, 9), "5-9 events")
        .when(events.between(10, 19), "10-19 events")
        .otherwise("20+ events")
    )
    return (
        home_domain_activity(
            page_rows(t, p.start),
            track_rows(t, p, p.start),
            domains_of(t, p.require_domain()),
            [day_key(p)],
        )
        .groupBy("event_date", band.alias("bucket"))
        .agg(
            F.count("user_id").alias("user_count"),
            F.count("user_id").alias("user_count_active_audience"),
        )
        .orderBy(F.desc("event_date"), "bucket")
    )


def avg_pageviews_per_user_daily(t: Tables, p: Params) -> DataFrame:
    """Page views per active user and local day."""
    views = page_rows(t, p.start).filter(F.col("domain") == p.require_domain())
    users, total = F.count_distinct("user_id"), F.count(F.lit(1))
    return (
        views.groupBy(day_key(p))
        .agg(
            users.alias("active_users"),
            total.alias("total_pageviews"),
            ratio(total, users, scale=2).alias("avg_pageviews_per_user"),
        )
        .orderBy(F.desc("event_date"))
    )
