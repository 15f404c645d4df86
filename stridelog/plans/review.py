"""Account review: data pack, comparison of customers, risk alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up, ntz, pct, ratio
from ..operators.activity import (
    month_key,
    own_domain_activity,
    page_rows,
    track_rows,
)
from ..operators.domains import domains_of
from ..operators.users import user_created, user_latest
from ..params import Params
from ..sources.tables import Tables
from .health import account_months, user_months


def qbr_deck_data(t: Tables, p: Params) -> DataFrame:
    """Four sections as text rows: monthly users, top pages, top users, new users.

    All users without a snapshot share one row of the top users. The activity of the look-back
    is rolled up once to (user, month, source, name) and feeds the first three sections.
    """
    domain = p.require_domain()
    since = p.months_ago(p.months_back)
    activity = (
        own_domain_activity(
            page_rows(t, since).filter(
                F.col("name").isNotNull() & (F.col("domain") == domain)
            ),
            track_rows(t, p, since),
            domains_of(t, domain),
            [month_key(p), "source", "name"],
        )
        .groupBy("user_id", "event_month", "source", "name")
        .agg(F.sum("events").alias("events"))
        # Always true. It keeps the roll-up whole in every section, so that they share it.
        .filter(F.col("events") > 0)
    )
    users = F.count_distinct("user_id")
    viewers = F.count_distinct(F.when(F.col("source") == "page", F.col("user_id")))

    mau = activity.groupBy("event_month").agg(users.alias("n")).select(
        *_section(
            "1_MAU_TREND", _text(F.col("event_month")), F.col("n"), F.lit("monthly_active_users")
        )
    )
    pages = (
        activity.groupBy("name")
        .agg(viewers.alias("n"), F.max(F.col("source") == "page").alias("is_page"))
        .filter("is_page")
        .orderBy(F.desc("n"), "name")
        .limit(10)
        .select(*_section("2_TOP_FEATURES", F.col("name"), F.col("n"), F.lit("unique_users")))
    )
    snapshots = t.users.filter(F.col("id").isNotNull())
    known = user_latest(snapshots, "email", "role", created=True).withColumnRenamed("id", "user_id")
    # Both sections group by all attributes first, so that they share one reduction of snapshots.
    attributes = ["email", "role", "user_created_at"]
    top_users = (
        activity.groupBy("user_id")
        .agg(F.sum("events").alias("events"))
        .join(known, "user_id", "left")
        .groupBy(*attributes)
        .agg(F.sum("events").alias("events"))
        .groupBy("email", "role")
        .agg(F.sum("events").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("email"), F.asc_nulls_last("role"))
        .limit(10)
        .select(*_section("3_TOP_USERS", F.col("email"), F.col("n"), F.col("role")))
    )
    created = known.filter(F.col("user_created_at") >= ntz(since))
    new_users = (
        domains_of(t, domain)
        .join(created, "user_id")
        .groupBy(*attributes)
        .agg(F.count("user_id").alias("users"))
        .groupBy(F.trunc("user_created_at", "month").alias("month"))
        .agg(F.sum("users").alias("n"))
        .select(*_section("4_NEW_USERS", _text(F.col("month")), F.col("n"), F.lit("new_users")))
    )
    return (
        mau.unionByName(pages)
        .unionByName(top_users)
        .unionByName(new_users)
        .orderBy("section", F.asc_nulls_last("period"))
    )


def _section(name: str, period: Column, value: Column, metric: Column) -> list[Column]:
    return [
        F.lit(name).alias("section"),
        period.alias("period"),
        value.cast("string").alias("metric_value"),
        metric.alias("metric_name"),
    ]


def _text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def multi_customer_comparison(t: Tables, p: Params) -> DataFrame:
    """Key figures of all domains side by side; domains without recent activity included.

    Stickiness is user-days over users times the days of the whole month.
    """
    return comparison(account_months(t, p, user_months(t, p, first=-1, last=0)), p)


def comparison(accounts: DataFrame, p: Params) -> DataFrame:
    """The comparison from ``account_months``."""
    curr, prev = F.col("curr"), F.col("prev")
    possible = F.greatest(curr, F.lit(1)) * p.days_in_month
    return (
        accounts.select(
            "domain",
            F.col("members").alias("total_users"),
            curr.alias("current_mau"),
            prev.alias("prev_mau"),
            (curr - prev).alias("mau_delta"),
            pct(curr, F.col("members")).alias("license_util_pct"),
            ratio(F.coalesce("curr_days", F.lit(0)), possible, scale=3).alias("stickiness"),
            F.col("features").alias("feature_breadth"),
        )
        .orderBy(F.desc("current_mau"), "domain")
    )


def trending_alert(t: Tables, p: Params) -> DataFrame:
    """Risk flags per domain: falling users, no new users, low stickiness.

    A domain whose users fall to none has no current month to compare, so it raises neither
    the first nor the last alert. All flags come from one row per domain.
    """
    now = F.col("event_month") == F.lit(p.month())
    before = F.col("event_month") == F.lit(p.month(-1))
    status = (
        user_months(t, p, first=-1, last=0)
        .groupBy("user_id")
        .agg(
            F.max(now).alias("now"),
            F.max(before).alias("before"),
            F.sum(F.when(now, F.col("days"))).alias("days"),
        )
    )
    recent = (
        user_created(t.users)
        .filter(F.col("user_created_at") >= ntz(p.days_ago(30)))
        .select(F.col("id").alias("user_id"), F.lit(1).alias("recent"))
    )
    accounts = (
        domains_of(t)
        .join(status, "user_id", "left")
        .join(recent, "user_id", "left")
        .groupBy("domain")
        .agg(
            F.count_if("now").alias("curr"),
            F.count_if("before").alias("prev"),
            F.sum("days").alias("days"),
            F.count("recent").alias("recent"),
        )
    )
    curr, prev, days = F.col("curr"), F.col("prev"), F.col("days")
    possible = curr * p.days_in_month
    change = F.format_string("%.1f", pct(curr - prev, prev))
    thousandths = half_up(days * 1000, possible) / F.lit(1000.0)
    shortest = F.regexp_replace(F.format_string("%.3f", thousandths), r"\.?0+$", "")
    alerts = F.array(
        _alert(
            "MAU_DROP_20PCT",
            (curr > 0) & (curr * 10 < prev * 8),
            F.concat(
                F.lit("MAU dropped from "), prev, F.lit(" to "), curr, F.lit(" ("), change,
                F.lit("%)"),
            ),
        ),
        _alert(
            "ZERO_NEW_USERS",
            F.col("recent") == 0,
            F.lit("No new users created in the last 30 days"),
        ),
        _alert(
            "LOW_STICKINESS",
            (curr > 0) & (days * 20 < possible),
            F.concat(F.lit("DAU/MAU ratio: "), shortest),
        ),
    )
    return (
        accounts.select("domain", F.inline(F.filter(alerts, lambda alert: alert.raised)))
        .drop("raised")
        .orderBy("domain", "alert_type")
    )


def _alert(kind: str, raised: Column, detail: Column) -> Column:
    return F.struct(
        raised.alias("raised"), F.lit(kind).alias("alert_type"), detail.alias("detail")
    )
