"""Reports from the stored state: the rows of the direct reports, without reading events.

The state holds whole UTC days, so ``Params.start`` must be a midnight, and it covers the days up
to its mark: a report is equal to the direct one if there are no later events.
"""

from __future__ import annotations

from datetime import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bitmaps import common, size, united
from ..operators.sessions import described
from ..params import Params
from ..sources.state import PAGE, TRACK, WORKFLOW, Stored
from .active import stickiness, with_change
from .health import scorecard
from .review import comparison


def dau_by_domain(s: Stored, p: Params) -> DataFrame:
    """Distinct users per domain and local day."""
    days = _counts(_active(s, p, F.col("event_date")), "dau")
    return days.withColumnRenamed("period", "event_date").orderBy("domain", F.desc("event_date"))


def wau_by_domain(s: Stored, p: Params) -> DataFrame:
    """Distinct users per domain and local week (Monday)."""
    weeks = _counts(_active(s, p, F.trunc("event_date", "week")), "wau")
    return weeks.withColumnRenamed("period", "event_week").orderBy("domain", F.desc("event_week"))


def mau_by_domain(s: Stored, p: Params) -> DataFrame:
    """Distinct users per domain and local month, with the change from the month before."""
    months = _counts(_active(s, p, F.trunc("event_date", "month")), "mau")
    return with_change(months.withColumnRenamed("period", "event_month"))


def mau_dau_ratio(s: Stored, p: Params) -> DataFrame:
    """Average daily over monthly users; a month's set is the union of its days' sets."""
    days = _active(s, p, F.col("event_date")).filter(F.col("domain").isNotNull())
    month = F.trunc("period", "month").alias("event_month")
    per_day = _counts(days, "dau").groupBy("domain", month)
    per_day = per_day.agg(F.count("period").alias("days"), F.sum("dau").alias("user_days"))
    months = united(days.withColumn("event_month", month), "domain", "event_month")
    users = months.groupBy("domain", "event_month").agg(F.sum(size()).alias("mau"))
    return stickiness(users.join(per_day, ["domain", "event_month"]))


def customer_health_scorecard(s: Stored, p: Params) -> DataFrame:
    """Health score and its parts for every domain active in the last months."""
    days = _at_home(s, p, first=-3)
    months = _months(days).groupBy("domain").agg(
        F.sum("mau").alias("mau_sum"), F.count("event_month").alias("months")
    )
    return scorecard(_account_months(s, p, days), months, p)


def multi_customer_comparison(s: Stored, p: Params) -> DataFrame:
    """Key figures of all domains side by side."""
    return comparison(_account_months(s, p, _at_home(s, p, first=-1, last=0)), p)


def derived_sessions(s: Stored, tz: str | None = None) -> DataFrame:
    """All sessions with local date and bounds."""
    if s.sessions is None:
        raise ValueError("the state took in late events of past days, so it has no sessions")
    return described(s.sessions, tz or s.tz)


def _active(s: Stored, p: Params, period: Column) -> DataFrame:
    """(domain, period, bucket, users): the users of each domain active in each period.

    Page views count for their own domain. Tracked events count for their user's: their sets,
    united over the period first, meet the sets of the domains' users.
    """
    days = _days(s, p).withColumn("period", period)
    views, homes = days.filter(F.col("kind") == PAGE), s.homes
    if p.domain is not None:
        views = views.filter(F.col("domain") == p.domain)
        homes = homes.filter(F.col("domain") == p.domain)
    events = united(days.filter(F.col("kind") != PAGE), "period")
    attributed = common(events, homes, "domain", "period")
    viewed = views.select("domain", "period", "bucket", "users")
    return united(viewed.unionByName(attributed), "domain", "period")


def _days(s: Stored, p: Params) -> DataFrame:
    """The daily sets since the report's start, of the kinds of events it counts."""
    if p.tz != s.tz:
        raise ValueError(f"the state is kept for {s.tz}, not for {p.tz}")
    if p.start.time() != time():
        raise ValueError("the state holds whole days: start must be a midnight")
    kinds = [PAGE, TRACK, WORKFLOW] if p.include_workflows else [PAGE, TRACK]
    since = F.col("utc_day") >= F.lit(p.start.date())
    return s.active.filter(since & F.col("kind").isin(kinds))


def _at_home(s: Stored, p: Params, first: int, last: int | None = None) -> DataFrame:
    """(domain, day, bucket, users): active users by their own domain, in the months from
    ``first`` to ``last`` (offsets from the current one)."""
    day = F.col("event_date")
    days = _days(s, p).filter(day >= F.lit(p.month(first)))
    if last is not None:
        days = days.filter(day < F.lit(p.month(last + 1)))
    days = united(days.withColumnRenamed("event_date", "day"), "day")
    return common(days, s.homes, "domain", "day")


def _months(days: DataFrame) -> DataFrame:
    """(domain, event_month, mau)."""
    month = F.trunc("day", "month")
    months = united(days.withColumn("event_month", month), "domain", "event_month")
    return months.groupBy("domain", "event_month").agg(F.sum(size()).alias("mau"))


def _account_months(s: Stored, p: Params, days: DataFrame) -> DataFrame:
    """The columns of ``health.account_months`` for every domain that has users."""
    now, before = F.lit(p.month()), F.lit(p.month(-1))
    month = F.trunc("day", "month").alias("month")
    pair = united(days.select("domain", month, "bucket", "users"), "domain", "month")
    pair = pair.filter(F.col("month").isin(p.month(), p.month(-1)))
    status = pair.groupBy("domain").agg(
        F.sum(F.when(F.col("month") == now, size())).alias("curr"),
        F.sum(F.when(F.col("month") == before, size())).alias("prev"),
    )
    both = pair.groupBy("domain", "bucket").agg(
        F.bitmap_and_agg("users").alias("users"), F.count(F.lit(1)).alias("n")
    )
    kept = both.filter(F.col("n") == 2).groupBy("domain").agg(F.sum(size()).alias("kept"))
    this_month = days.filter(F.trunc("day", "month") == now)
    user_days = this_month.groupBy("domain").agg(F.sum(size()).alias("curr_days"))
    viewed = s.areas.filter(F.col("utc_day") >= F.lit(p.month()))
    viewed = common(united(viewed, "area"), s.homes, "domain", "area")
    areas = viewed.select("domain", "area").distinct().groupBy("domain")
    areas = areas.agg(F.count("area").alias("features"))
    members = s.homes.groupBy("domain").agg(F.sum(size()).alias("members"))
    joined = members
    for part in (status, kept, user_days, areas):
        joined = joined.join(part, "domain", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("curr", "prev", "kept", "features")}
    return joined.withColumns(zero)


def _counts(sets: DataFrame, name: str) -> DataFrame:
    return sets.groupBy("domain", "period").agg(F.sum(size()).alias(name))
