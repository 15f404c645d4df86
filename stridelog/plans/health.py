"""Customer health: score, summary, licence and role use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.localtime import local_time
from ..functions.numeric import INT_DIVISION, PCT_DIVISION, half_up, ntz, pct, ratio
from ..functions.taxonomy import HEALTH
from ..operators.activity import day_key, page_rows, roll_up, track_rows
from ..operators.domains import domains_of, in_domain
from ..operators.users import user_latest
from ..params import Params
from ..sources.tables import Tables


def user_months(t: Tables, p: Params, first: int, last: int | None = None) -> DataFrame:
    """(user_id, event_month, days): active local days per user and month.

    Only months from ``first`` up to ``last`` (offsets from the current one) are scanned, and
    nothing before the report's start.
    """
    start = max(p.start, p.month_start_utc(first))
    end = None if last is None else p.month_start_utc(last + 1)
    rows = page_rows(t, start, end).drop("domain").unionByName(track_rows(t, p, start, end))
    return (
        roll_up(rows, [day_key(p)])
        .groupBy("user_id", F.trunc("event_date", "month").alias("event_month"))
        .agg(F.count(F.lit(1)).alias("days"))
    )


def account_months(t: Tables, p: Params, months: DataFrame) -> DataFrame:
    """One row per domain from the activity in ``months``:

    members, curr and prev (users of this and last month), kept (users of both), curr_days
    (user-days of this month), features (feature areas viewed this month).

    Each input has one row per user and meets the domain lookup on the user id, so the lookup,
    a scan of all page-view history, is built once and a single aggregate by domain follows.
    """
    now = F.col("event_month") == F.lit(p.month())
    before = F.col("event_month") == F.lit(p.month(-1))
    status = months.groupBy("user_id").agg(
        F.max(now).alias("now"),
        F.max(before).alias("before"),
        F.sum(F.when(now, F.col("days"))).alias("days"),
    )
    used = user_features(t, p)
    areas = [c for c in used.columns if c != "user_id"]
    breadth = sum(
        (F.coalesce(F.max(F.col(area).cast("bigint")), F.lit(0)) for area in areas),
        start=F.lit(0).cast("bigint"),
    )
    return (
        domains_of(t)
        .join(status, "user_id", "left")
        .join(used, "user_id", "left")
        .groupBy("domain")
        .agg(
            F.count("user_id").alias("members"),
            F.count_if("now").alias("curr"),
            F.count_if("before").alias("prev"),
            F.count_if(F.col("now") & F.col("before")).alias("kept"),
            F.sum("days").alias("curr_days"),
            breadth.alias("features"),
        )
    )


def user_features(t: Tables, p: Params) -> DataFrame:
    """(user_id, one flag per feature area) of page views since the current month began.

    The month starts at midnight of the as-of clock and page views are compared in UTC.
    """
    name = F.col("name")
    return (
        t.pages_between(p.month_start())
        .filter(name.isNotNull())
        .groupBy("user_id")
        .agg(
            *[
                F.max(rule.matches(name)).alias(f"area_{i}")
                for i, rule in enumerate(HEALTH.pages)
            ]
        )
    )


def customer_health_scorecard(t: Tables, p: Params) -> DataFrame:
    """Health score (0-100) and its parts for every domain active in the last months.

    A quarter each: users active this month, trend against last month, breadth out of six
    features, retention of last month's users. Odd but intended:

    * the score is NULL, so the status Critical, if last month had no active user or exactly
      one; the "no users last month" branch of the trend therefore never shows;
    * a domain without users this month gets 0 for the trend and a NULL stickiness;
    * the average covers the current and three earlier months, and any later one in the data;
    * stickiness divides by the days of the month elapsed before today, at least one.
    """
    months = user_months(t, p, first=-3)
    # A left join that counts the matched days: lookup and user-months are then the very plans
    # that account_months uses, and their exchanges are shared.
    average = (
        domains_of(t)
        .join(months, "user_id", "left")
        .groupBy("domain", "event_month")
        .agg(F.count("days").alias("mau"))
        .groupBy("domain")
        .agg(F.sum("mau").alias("mau_sum"), F.count("event_month").alias("months"))
        .filter(F.col("months") > 0)
    )
    return scorecard(account_months(t, p, months), average, p)


def scorecard(accounts: DataFrame, average: DataFrame, p: Params) -> DataFrame:
    """The score from ``account_months`` and (domain, mau_sum, months)."""
    curr, prev, members = F.col("curr"), F.col("prev"), F.col("members")
    features, kept = F.col("features"), F.col("kept")
    elapsed = max(p.as_of.day - 1, 1)
    million = 10**6
    mean_mau = half_up(F.col("mau_sum") * million, F.col("months"))
    return (
        accounts.join(average, "domain")
        .select(
            "domain",
            members.alias("total_user_count"),
            curr.alias("current_mau"),
            prev.alias("prev_mau"),
            ratio(mean_mau, F.lit(million), scale=0).alias("avg_mau_3m"),
            pct(curr, members).alias("license_util_pct"),
            ratio(
                F.col("curr_days"), curr * elapsed, scale=3, division=INT_DIVISION
            ).alias("stickiness"),
            features.alias("features_used"),
            pct(kept, prev).alias("retention_pct"),
            _health_score(curr, members, _trend(curr, prev), features, kept, prev).alias(
                "health_score"
            ),
        )
        .withColumn(
            "health_status",
            F.when(F.col("health_score") >= 70, "Healthy")
            .when(F.col("health_score") >= 40, "At Risk")
            .otherwise("Critical"),
        )
        .orderBy(F.desc_nulls_first("health_score"), "domain")
    )


def _trend(curr: Column, prev: Column) -> Column:
    """Twice the trend term: 2 steady or growing, 1 down by up to a fifth, else 0."""
    return (
        F.when(prev == 0, 1)
        .when((curr > 0) & (curr >= prev), 2)
        .when((curr > 0) & (curr * 10 >= prev * 8), 1)
        .otherwise(0)
    )


def _health_score(
    curr: Column, members: Column, trend2: Column, features: Column, kept: Column, prev: Column
) -> Column:
    """Sum of the four quarters in units of 10^-7, with the places each division keeps.

    The user share is an integer division (six places), the other two carry a numerator with
    one decimal place (seven).
    """
    unit = 10**PCT_DIVISION
    share = F.least(half_up(curr * 10**INT_DIVISION, members), F.lit(10**INT_DIVISION))
    several = F.when(prev > 1, prev)
    total = (
        share * (25 * unit // 10**INT_DIVISION)
        + trend2 * (25 * unit // 2)
        + half_up(features * (25 * unit), 6)
        + half_up(kept * (25 * unit), several)
    )
    return half_up(total, unit).cast("double")


def domain_summary_snapshot(t: Tables, p: Params) -> DataFrame:
    """Users, monthly actives and last activity of every domain.

    Page views without a name do not count as activity.
    """
    rows = (
        page_rows(t, p.start)
        .filter(F.col("name").isNotNull())
        .select("user_id", "ts")
        .unionByName(track_rows(t, p, p.start).select("user_id", "ts"))
    )

    def active_in(offset: int) -> Column:
        """Local month as a range of UTC instants: no row is converted."""
        low, high = ntz(p.month_start_utc(offset)), ntz(p.month_start_utc(offset + 1))
        return F.max((F.col("ts") >= low) & (F.col("ts") < high))

    users = rows.groupBy("user_id").agg(
        active_in(0).alias("now"), active_in(-1).alias("before"), F.max("ts").alias("last_ts")
    )
    now, before = F.col("active_this_month"), F.col("active_last_month")
    return (
        domains_of(t)
        .join(users, "user_id", "left")
        .groupBy("domain")
        .agg(
            F.count("user_id").alias("total_users"),
            F.count_if("now").alias("active_this_month"),
            F.count_if("before").alias("active_last_month"),
            local_time(F.max("last_ts"), p.tz).alias("last_activity"),
        )
        .filter(F.col("total_users") > 0)
        .select(
            "domain",
            "total_users",
            "active_this_month",
            "active_last_month",
            (now - before).alias("mau_delta"),
            pct(now - before, before).alias("mau_change_pct"),
            pct(now, F.col("total_users")).alias("license_util_pct"),
            "last_activity",
            F.datediff(F.lit(p.as_of.date()), F.to_date("last_activity")).alias(
                "days_since_last_activity"
            ),
        )
        .orderBy(F.desc("active_this_month"), "domain")
    )


def _active_members(t: Tables, p: Params, since, attribute: str) -> DataFrame:
    """Users of the domain with role, ``attribute`` and whether active since then.

    The members are attributed already, so track users need no domain look-up of their own.
    All three inputs have one row per user and meet on the user id.
    """
    active = (
        in_domain(page_rows(t, since), p)
        .select("user_id")
        .unionByName(track_rows(t, p, since).select("user_id"))
        .distinct()
        .withColumn("active", F.lit(1))
    )
    known = user_latest(t.users, "role", attribute).withColumnRenamed("id", "user_id")
    return (
        domains_of(t, p.domain).join(known, "user_id", "left").join(active, "user_id", "left")
    )


def license_utilization(t: Tables, p: Params) -> DataFrame:
    """Users active in the last month per role and licence type."""
    total, active = F.count("user_id"), F.count("active")
    return (
        _active_members(t, p, p.months_ago(1), "license_type")
        .groupBy("domain", "role", "license_type")
        .agg(
            total.alias("total_users"),
            active.alias("active_users"),
            (total - active).alias("inactive_users"),
            pct(active, total).alias("utilization_pct"),
        )
        .orderBy(
            F.desc("total_users"),
            "domain",
            F.asc_nulls_last("role"),
            F.asc_nulls_last("license_type"),
        )
    )


def role_distribution(t: Tables, p: Params) -> DataFrame:
    """Users active in the last 30 days per role and job role."""
    total, active = F.count("user_id"), F.count("active")
    return (
        _active_members(t, p, p.days_ago(30), "job_role")
        .groupBy("domain", "role", "job_role")
        .agg(
            total.alias("total_users"),
            active.alias("active_users"),
            pct(active, total).alias("active_pct"),
        )
        .orderBy(
            F.desc("total_users"),
            "domain",
            F.asc_nulls_last("role"),
            F.asc_nulls_last("job_role"),
        )
    )
