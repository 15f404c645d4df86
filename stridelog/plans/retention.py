"""Who comes back: cohorts, activation, churn, day-N retention, funnel."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.localtime import local_date
from ..functions.numeric import months_between, ntz, pct
from ..functions.taxonomy import GOVERNANCE_ACTIONS, SEARCH_EVENTS
from ..operators.activity import (
    day_key,
    month_key,
    own_domain_activity,
    page_rows,
    track_rows,
)
from ..operators.domains import domains_of, in_domain
from ..operators.keyfilter import possible_keys
from ..operators.users import user_created, user_latest
from ..params import Params
from ..sources.tables import Tables


def monthly_retention_cohort(t: Tables, p: Params) -> DataFrame:
    """Share of each first-activity month's users that is active n months later.

    A user's page views select by their own domain, the user must have one. Cells without
    users are absent. A cohort's size is its own month's cell.
    """
    activity = own_domain_activity(
        in_domain(page_rows(t, p.start), p),
        track_rows(t, p, p.start),
        domains_of(t, p.domain),
        [month_key(p)],
    )
    user_months = activity.select("user_id", "event_month").distinct()
    if p.domain is None:
        user_months = user_months.join(domains_of(t), "user_id", "left_semi")
    else:  # a page view with this domain already gives its user one
        user_months = user_months.filter(F.col("user_id").isNotNull())

    first = F.min("event_month").over(W.partitionBy("user_id"))
    cohort = W.partitionBy("cohort_month")
    size = F.max(F.when(F.col("months_since_start") == 0, F.col("active_users"))).over(cohort)
    return (
        user_months.withColumn("cohort_month", first)
        .withColumn(
            "months_since_start", months_between(F.col("cohort_month"), F.col("event_month"))
        )
        .groupBy("cohort_month", "months_since_start")
        .agg(F.count("user_id").alias("active_users"))
        .withColumn("cohort_size", size)
        .select(
            "cohort_month",
            "cohort_size",
            "months_since_start",
            "active_users",
            pct(F.col("active_users"), F.col("cohort_size")).alias("retention_pct"),
        )
        .orderBy("cohort_month", "months_since_start")
    )


def activation_funnel(t: Tables, p: Params) -> DataFrame:
    """How soon new users act after their account was created.

    Accounts are dated in UTC, first events in local time, and events of any date count. An
    event before the creation date is a negative delay, which counts as activated.

    Only events of the new users can matter, so those of all other users are left out, as far as
    a filter of fixed size can tell, before the roll-up over all history.
    """
    domain = p.require_domain()
    created = (
        user_created(t.users)
        .filter(F.col("user_created_at") >= ntz(p.start))
        .withColumnRenamed("id", "user_id")
    )
    accounts = domains_of(t, domain).join(created, "user_id")
    pages = page_rows(t, None).filter(F.col("domain") == domain)
    # The new users are attributed to the domain already, so their events need no look-up.
    events = pages.select("user_id", "ts").unionByName(track_rows(t, p, None).select("user_id", "ts"))
    first_event = (
        possible_keys(events, accounts.select("user_id"), "user_id")
        .groupBy("user_id")
        .agg(F.min("ts").alias("first_ts"))
    )
    delay = F.datediff(
        local_date(F.col("first_ts"), p.tz), F.to_date("user_created_at")
    )
    new_users = (
        accounts.join(first_event, "user_id", "left")
        .withColumn("delay", delay)
        .withColumn("creation_month", F.trunc("user_created_at", "month"))
    )

    def within(days: int) -> Column:
        return F.count_if(F.col("delay") <= days)

    total = F.count(F.lit(1))
    return (
        new_users.groupBy("creation_month")
        .agg(
            total.alias("total_new_users"),
            *[within(days).alias(f"activated_{days}d") for days in (1, 7, 14, 30)],
            F.count_if(F.col("delay").isNull()).alias("never_activated"),
            *[pct(within(days), total).alias(f"pct_{days}d") for days in (1, 7, 30)],
        )
        .orderBy(F.desc("creation_month"))
    )


def churned_users(t: Tables, p: Params) -> DataFrame:
    """Users active last month and not this month.

    Local months are compared as UTC instants, so only those two months are scanned. One
    aggregate per user replaces the difference of two user sets. A missing user id never
    equals itself, hence counts as churned.
    """
    domain = p.require_domain()
    # The three-month look-back always covers the previous month; it is kept for clarity.
    start = max(p.months_ago(3), p.month_start_utc(-1))
    end = p.month_start_utc(1)
    activity = own_domain_activity(
        page_rows(t, start, end).filter(F.col("domain") == domain),
        track_rows(t, p, start, end),
        domains_of(t, domain),
        [],
    )
    this_month = ntz(p.month_start_utc())
    gone = (
        activity.groupBy("user_id")
        .agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
        .filter(
            (F.col("first_ts") < this_month)
            & (F.col("user_id").isNull() | (F.col("last_ts") < this_month))
        )
        .select("user_id")
    )
    known = user_latest(t.users, "email", "username", "role", "job_role")
    return (
        gone.join(known.withColumnRenamed("id", "user_id"), "user_id", "left")
        .select(
            "user_id",
            "email",
            "username",
            "role",
            "job_role",
            F.lit(p.month(-1)).alias("last_active_month"),
        )
        .orderBy("user_id")
    )


def reactivated_users(t: Tables, p: Params) -> DataFrame:
    """Every return of a user after 30 or more days without activity."""
    domain = p.require_domain()
    days = (
        own_domain_activity(
            page_rows(t, p.start).filter(F.col("domain") == domain),
            track_rows(t, p, p.start),
            domains_of(t, domain),
            [day_key(p)],
        )
        .select("user_id", "event_date")
        .distinct()
    )
    before = F.lag("event_date").over(W.partitionBy("user_id").orderBy("event_date"))
    returns = (
        days.withColumn("last_active_before_gap", before)
        .withColumn("gap_days", F.datediff("event_date", "last_active_before_gap"))
        .filter(F.col("gap_days") >= 30)
    )
    known = user_latest(t.users, "email", "username", "role")
    return (
        returns.join(known.withColumnRenamed("id", "user_id"), "user_id", "left")
        .select(
            "user_id",
            "email",
            "username",
            "role",
            "last_active_before_gap",
            F.col("event_date").alias("reactivation_date"),
            "gap_days",
        )
        .orderBy(F.desc("reactivation_date"), F.desc("gap_days"), "user_id")
    )


def daily_retention_session_to_pageview(t: Tables, p: Params) -> DataFrame:
    """Day-N retention, returning by a page view."""
    return _day_n_retention(t, p, page_returns=True, track_returns=F.lit(False))


def daily_retention_session_to_search(t: Tables, p: Params) -> DataFrame:
    """Day-N retention, returning by a search or an assistant prompt."""
    searches = F.col("name").isin(*SEARCH_EVENTS)
    return _day_n_retention(t, p, page_returns=False, track_returns=searches)


def daily_retention_session_to_session(t: Tables, p: Params) -> DataFrame:
    """Day-N retention, returning by any activity; day 0 is always complete."""
    return _day_n_retention(t, p, page_returns=True, track_returns=F.lit(True))


def _day_n_retention(
    t: Tables, p: Params, page_returns: bool, track_returns: Column
) -> DataFrame:
    """Of the users active on a day, the share that returns n days later, for n in [0, N).

    Only days with all N days behind them are cohorts; offsets nobody returned on stay, as 0.

    One row per user and active day carries whether it is a return; a range frame over the
    next N days collects the return days. These become offsets, one row each, and are counted by
    (cohort, offset) on the map side, so the work follows the returns there are, not N. Two more
    marks count the users of a cohort and keep cohorts of which no user is known. A cohort's at
    most N + 2 counts then make its row, and the zero cells need no separate grid.
    """
    domain = p.require_domain()
    pages = page_rows(t, p.start).filter(F.col("domain") == domain)
    activity = own_domain_activity(
        pages.withColumn("returned", F.lit(page_returns)),
        track_rows(t, p, p.start).withColumn("returned", track_returns),
        domains_of(t, domain),
        [day_key(p), "returned"],
    )
    user_days = (
        activity.groupBy("user_id", "event_date")
        .agg(F.max("returned").alias("returned"))
        .withColumn("day_no", F.unix_date("event_date"))
    )
    ahead = W.partitionBy("user_id").orderBy("day_no").rangeBetween(0, p.retention_days - 1)
    return_days = F.collect_list(F.when(F.col("returned"), F.col("day_no"))).over(ahead)
    last_cohort = p.as_of.date() - timedelta(days=p.retention_days)
    member, nobody = F.lit(-1), F.lit(-2)
    offsets = F.transform("return_days", lambda day: day - F.col("day_no"))
    marks = F.when(
        F.col("user_id").isNotNull(), F.concat(F.array(member), offsets)
    ).otherwise(F.array(nobody))
    counts = (
        user_days.withColumn("return_days", return_days)
        .filter(F.col("event_date") <= F.lit(last_cohort))
        .select(F.col("event_date").alias("cohort_date"), F.explode(marks).alias("mark"))
        .groupBy("cohort_date", "mark")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    of = F.map_from_entries(F.collect_list(F.struct("mark", "n")))
    count_of = lambda mark: F.coalesce(F.try_element_at("of", mark), F.lit(0))
    return (
        counts.groupBy("cohort_date")
        .agg(of.alias("of"))
        .select(
            "cohort_date",
            count_of(member).alias("cohort_size"),
            "of",
            F.explode(F.sequence(F.lit(0), F.lit(p.retention_days - 1))).alias("day_n"),
        )
        .select(
            "cohort_date",
            "cohort_size",
            "day_n",
            count_of(F.col("day_n")).alias("retained_users"),
            pct(count_of(F.col("day_n")), F.col("cohort_size")).alias("retention_pct"),
        )
        .orderBy(F.desc("cohort_date"), "day_n")
    )


def retention_rate_aggregate(t: Tables, p: Params) -> DataFrame:
    """Per week of first activity, the share of users with a page view within seven days.

    "Within" is the first day and the seven after it. A page view is itself activity, so a
    user's first page view decides, and the join of users with their page views is not needed.
    """
    domain = p.require_domain()
    activity = own_domain_activity(
        page_rows(t, p.start).filter(F.col("domain") == domain),
        track_rows(t, p, p.start),
        domains_of(t, domain),
        ["source"],
    )
    first_page = F.min(F.when(F.col("source") == "page", F.col("first_ts")))
    users = (
        activity.groupBy("user_id")
        .agg(F.min("first_ts").alias("first_ts"), first_page.alias("first_page_ts"))
        .select(
            "user_id",
            local_date(F.col("first_ts"), p.tz).alias("first_day"),
            local_date(F.col("first_page_ts"), p.tz).alias("first_page_day"),
        )
        .filter(F.col("first_day") <= F.lit(p.days_ago(7).date()))
    )
    viewed = F.count_if(
        F.col("user_id").isNotNull()
        & (F.col("first_page_day") <= F.date_add("first_day", 7))
    )
    active = F.count("user_id")
    return (
        users.groupBy(F.trunc("first_day", "week").alias("cohort_week"))
        .agg(
            active.alias("users_with_activity"),
            viewed.alias("users_with_pageview_7d"),
            pct(viewed, active).alias("retention_rate_pct"),
        )
        .orderBy(F.desc("cohort_week"))
    )


def funnel_session_to_pageview(t: Tables, p: Params) -> DataFrame:
    """Active users -> users with a page view -> users with two, over [start, end).

    From the second step on, users are split by whether they also did governance work. All
    steps come from one aggregate per user and one over the users.
    """
    domain = p.require_domain()
    if p.end is None:
        raise ValueError("this report needs an end")
    pages = page_rows(t, p.start, p.end).filter(F.col("domain") == domain)
    tracks = track_rows(t, p, p.start, p.end)
    users = (
        own_domain_activity(
            pages.withColumn("governed", F.lit(False)),
            tracks.withColumn("governed", GOVERNANCE_ACTIONS.matches(F.col("name"))),
            domains_of(t, domain),
            ["source", "governed"],
        )
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.sum(F.when(F.col("source") == "page", F.col("events")).otherwise(0)).alias("views"),
            F.max("governed").alias("governed"),
        )
    )
    views, governed = F.col("views"), F.col("governed")
    totals = users.agg(
        F.count(F.lit(1)).alias("n1"),
        F.count_if(views >= 1).alias("n2"),
        F.count_if((views >= 1) & governed).alias("g2"),
        F.count_if(views >= 2).alias("n3"),
        F.count_if((views >= 2) & governed).alias("g3"),
    )
    nothing = F.lit(None).cast("bigint")

    def step(name: str, order: int, n: str, g: str | None, before: str | None) -> Column:
        return F.struct(
            F.lit(name).alias("step_name"),
            F.lit(order).alias("step_order"),
            F.col(n).alias("total_users"),
            (F.col(g) if g else nothing).alias("with_governance"),
            (F.col(n) - F.col(g) if g else nothing).alias("without_governance"),
            pct(F.col(n), F.col("n1")).alias("conversion_from_step1_pct"),
            pct(F.col(n), F.col(before) if before else nothing).alias("conversion_from_prev_pct"),
        )

    steps = F.array(
        step("Step 1: Active User", 1, "n1", None, None),
        step("Step 2: Pageview", 2, "n2", "g2", "n1"),
        step("Step 3: 2+ Pageviews", 3, "n3", "g3", "n2"),
    )
    return totals.select(F.inline(steps)).orderBy("step_order")
