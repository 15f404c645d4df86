"""Daily, weekly and monthly active users, stickiness, user roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.localtime import local_time
from ..functions.numeric import half_up, ntz, pct, ratio
from ..operators.activity import (
    day_key,
    month_key,
    own_domain_activity,
    page_rows,
    track_rows,
    week_key,
)
from ..operators.domains import domains_of, in_domain
from ..operators.users import identities
from ..params import Params
from ..sources.tables import Tables


def _activity(t: Tables, p: Params, *keys: Column) -> DataFrame:
    return own_domain_activity(
        in_domain(page_rows(t, p.start), p),
        track_rows(t, p, p.start),
        domains_of(t, p.domain),
        keys,
    )


def _active_users(t: Tables, p: Params, key: Column, name: str, measure: str) -> DataFrame:
    return (
        _activity(t, p, key)
        .groupBy("domain", name)
        .agg(F.count_distinct("user_id").alias(measure))
    )


def dau_by_domain(t: Tables, p: Params) -> DataFrame:
    """Distinct users per domain and local day."""
    return _active_users(t, p, day_key(p), "event_date", "dau").orderBy(
        "domain", F.desc("event_date")
    )


def wau_by_domain(t: Tables, p: Params) -> DataFrame:
    """Distinct users per domain and local week (Monday)."""
    return _active_users(t, p, week_key(p), "event_week", "wau").orderBy(
        "domain", F.desc("event_week")
    )


def mau_by_domain(t: Tables, p: Params) -> DataFrame:
    """Distinct users per domain and local month, with the change from the month before.

    "Before" is the previous month that has activity, not the previous calendar month.
    """
    return with_change(_active_users(t, p, month_key(p), "event_month", "mau"))


def with_change(months: DataFrame) -> DataFrame:
    """The monthly report from (domain, event_month, mau)."""
    previous = F.lag("mau").over(W.partitionBy("domain").orderBy("event_month"))
    delta = F.col("mau") - F.col("prev_month_mau")
    return (
        months.withColumn("prev_month_mau", previous)
        .withColumn("mau_delta", delta)
        .withColumn("mau_change_pct", pct(F.col("mau_delta"), F.col("prev_month_mau")))
        .orderBy("domain", F.desc("event_month"))
    )


def mau_dau_ratio(t: Tables, p: Params) -> DataFrame:
    """Average daily over monthly users. Days without activity do not enter the average.

    The level is decided on the exact ratio, not on the rounded one. In all-customer mode
    page views without a domain do not count. A user's days of a month are the bits of one
    number, so nothing is counted distinct.
    """
    day_bit = F.expr("shiftleft(1L, day(event_date) - 1)")
    user_months = (
        _activity(t, p, month_key(p), day_key(p))
        .filter(F.col("domain").isNotNull())
        .groupBy("domain", "event_month", "user_id")
        .agg(F.bit_or(day_bit).alias("day_bits"))
    )
    known = F.col("user_id").isNotNull()
    months = user_months.groupBy("domain", "event_month").agg(
        F.count("user_id").alias("mau"),
        F.bit_count(F.bit_or("day_bits")).cast("bigint").alias("days"),
        F.sum(F.when(known, F.bit_count("day_bits")).otherwise(0)).alias("user_days"),
    )
    return stickiness(months)


def stickiness(months: DataFrame) -> DataFrame:
    """The ratio report from (domain, event_month, mau, days, user_days)."""
    mau, days, total = F.col("mau"), F.col("days"), F.col("user_days")
    million = 10**6
    avg_dau = half_up(total * million, days)
    return months.select(
        "domain",
        "event_month",
        "mau",
        ratio(avg_dau, F.lit(million), scale=1).alias("avg_dau"),
        ratio(avg_dau, mau * million, scale=3, division=12).alias("stickiness_ratio"),
        F.when((mau > 0) & (total * 10 >= mau * days * 3), "Strong")
        .when((mau > 0) & (total * 10 >= mau * days), "Moderate")
        .otherwise("Episodic")
        .alias("engagement_level"),
    ).orderBy("domain", F.desc("event_month"))


def user_roster_by_domain(t: Tables, p: Params) -> DataFrame:
    """Every active user of a domain with activity totals, status and, if known, identity.

    A user with several (email, username, role) combinations gets one row for each.
    """
    p.require_domain()
    activity = (
        _activity(t, p, day_key(p))
        .groupBy("user_id")
        .agg(
            F.sum("events").alias("total_events"),
            F.count_distinct("event_date").alias("active_days"),
            local_time(F.min("first_ts"), p.tz).alias("first_activity"),
            local_time(F.max("last_ts"), p.tz).alias("last_activity"),
        )
    )
    known = identities(t.users).withColumnRenamed("id", "user_id")
    last = F.col("last_activity")
    return (
        activity.join(known, "user_id", "left")
        .select(
            "user_id",
            "email",
            "username",
            "role",
            "license_type",
            "job_role",
            "user_created_at",
            "total_events",
            "active_days",
            "first_activity",
            "last_activity",
            F.datediff(F.lit(p.as_of.date()), F.to_date(last)).alias("days_since_last_activity"),
            F.when(last >= ntz(p.days_ago(30)), "Active")
            .when(last >= ntz(p.days_ago(90)), "Inactive")
            .when(last.isNull(), "Never Active")
            .otherwise("Churned")
            .alias("status"),
        )
        .orderBy(F.desc("total_events"), "user_id", "email", "username", "role")
    )
