"""Data profile and catalogs of domains, events and pages. Days here are UTC days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.activity import drop_noise
from ..operators.domains import domains_of
from ..params import Params
from ..sources.tables import Tables

_CATALOG_MONTHS = 3


def _utc_day() -> Column:
    return F.to_date("timestamp")


def _n_rows() -> Column:
    return F.count(F.lit(1))


def discover_domains(t: Tables, p: Params) -> DataFrame:
    """Domains seen in the last three months."""
    return (
        t.pages_between(p.months_ago(_CATALOG_MONTHS))
        .filter(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(
            F.count_distinct("user_id").alias("total_users"),
            _n_rows().alias("total_pageviews"),
            F.min(_utc_day()).alias("first_activity"),
            F.max(_utc_day()).alias("last_activity"),
        )
        .orderBy(F.desc("total_users"), "domain")
    )


def discover_events(
    t: Tables, p: Params, term: str | None = None, domain: str | None = None
) -> DataFrame:
    """Events of the last three months by users with a known domain.

    ``term`` keeps events whose lower-cased name matches ``%term%``, ``domain`` those of one
    customer. Collapsing to (event, user) first turns the distinct users into a plain count.
    """
    tracks = drop_noise(t.tracks_between(p.months_ago(_CATALOG_MONTHS)), p.include_workflows)
    if term is not None:
        tracks = tracks.filter(F.lower("event_text").like(f"%{term}%"))
    per_user = tracks.groupBy("event_text", "user_id").agg(
        _n_rows().alias("n"),
        F.min(_utc_day()).alias("first_day"),
        F.max(_utc_day()).alias("last_day"),
    )
    return (
        per_user.join(domains_of(t, domain), "user_id")
        .groupBy("event_text")
        .agg(
            F.sum("n").alias("total_occurrences"),
            F.count("user_id").alias("unique_users"),
            F.count_distinct("domain").alias("domains_using"),
            F.min("first_day").alias("first_seen"),
            F.max("last_day").alias("last_seen"),
        )
        .orderBy(F.desc("total_occurrences"), "event_text")
    )


def discover_pages(t: Tables, p: Params) -> DataFrame:
    """Page names of the last three months.

    Users and domains are counted separately over the (page, user, domain) groups, so no group is
    repeated for a second distinct count; the joined results have one row per page.
    """
    groups = (
        t.pages_between(p.months_ago(_CATALOG_MONTHS))
        .filter(F.col("name").isNotNull())
        .groupBy(F.col("name").alias("page_name"), "user_id", "domain")
        .agg(
            _n_rows().alias("n"),
            F.min(_utc_day()).alias("first_day"),
            F.max(_utc_day()).alias("last_day"),
        )
    )
    ranges = (
        F.sum("n").alias("n"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
    )
    users = (
        groups.groupBy("page_name", "user_id")
        .agg(*ranges)
        .groupBy("page_name")
        .agg(
            F.sum("n").alias("total_views"),
            F.count("user_id").alias("unique_users"),
            F.min("first_day").alias("first_seen"),
            F.max("last_day").alias("last_seen"),
        )
    )
    domains = (
        groups.groupBy("page_name", "domain")
        .agg(*ranges)
        .filter(_plausible("n", [], "first_day", "last_day"))
        .groupBy("page_name")
        .agg(F.count("domain").alias("domains_using"))
    )
    return (
        users.join(domains, "page_name")
        .select(
            "page_name",
            "total_views",
            "unique_users",
            "domains_using",
            "first_seen",
            "last_seen",
        )
        .orderBy(F.desc("total_views"), "page_name")
    )


def profile_tracks(t: Tables, p: Params) -> DataFrame:
    """Shape, range and fill counts of the tracked events, noise included."""
    return _profile_events(
        t.tracks,
        "TRACKS",
        filled={"has_amplitude_session_id": "context_actions_amplitude_session_id"},
        distinct={"distinct_event_types": "event_text"},
    )


def profile_pages(t: Tables, p: Params) -> DataFrame:
    """Shape, range and fill counts of the page views."""
    return _profile_events(
        t.pages,
        "PAGES",
        filled={
            "has_domain": "domain",
            "has_email": "email",
            "has_session_uuid": "session_uuid",
            "has_amplitude_session_id": "context_actions_amplitude_session_id",
        },
        distinct={"distinct_page_names": "name"},
    )


def _profile_events(
    events: DataFrame, label: str, filled: dict[str, str], distinct: dict[str, str]
) -> DataFrame:
    """One summary row. The events are collapsed to their (user, day, name) combinations; users,
    days and names are then counted separately over these, so no row is repeated for a second
    distinct count, and the one-row results are put side by side."""
    named = list(distinct.values())
    groups = events.groupBy("user_id", _utc_day().alias("day"), *named).agg(
        _n_rows().alias("n"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        *[F.count(column).alias(alias) for alias, column in filled.items()],
    )
    total = [_total(alias).alias(alias) for alias in filled]
    measures = ["n", *filled]
    users = (
        groups.groupBy("user_id")
        .agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            *[F.sum(c).alias(c) for c in measures],
        )
        .agg(
            F.lit(label).alias("table_name"),
            _total("n").alias("total_rows"),
            F.count("user_id").alias("distinct_users"),
            F.min("first_ts").alias("earliest_event"),
            F.max("last_ts").alias("latest_event"),
            *total,
        )
    )
    sets = {"days_with_data": "day", **distinct}
    for alias, column in sets.items():
        values = groups.groupBy(column).agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            *[F.sum(c).alias(c) for c in measures],
        )
        values = values.filter(_plausible("n", list(filled), "first_ts", "last_ts"))
        users = users.join(F.broadcast(values.agg(F.count(column).alias(alias))))
    return users.select(
        "table_name",
        "total_rows",
        "distinct_users",
        "earliest_event",
        "latest_event",
        "days_with_data",
        *filled,
        *distinct,
    )


def _plausible(n: str, counts: list[str], first: str, last: str) -> Column:
    """True for every group.

    It reads all columns of the collapsed rows, so that each count works on the same ones: else
    the optimizer drops those that a count does not need, and the rows are scanned and collapsed
    anew for every count instead of once.
    """
    fits = (F.col(n) >= 1) & F.coalesce(F.col(first) <= F.col(last), F.lit(True))
    for count in counts:
        fits &= F.col(count) <= F.col(n)
    return fits


def _total(column: str) -> Column:
    """Sum of partial counts; 0, not NULL, over no rows, as a count would give."""
    return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))


def profile_users(t: Tables, p: Params) -> DataFrame:
    """Shape, range and fill counts of the user snapshots."""
    return t.users.agg(
        F.lit("USERS").alias("table_name"),
        _n_rows().alias("total_rows"),
        F.count_distinct("id").alias("distinct_users"),
        F.min("received_at").alias("earliest_received"),
        F.max("received_at").alias("latest_received"),
        F.count("email").alias("has_email"),
        F.count("role").alias("has_role"),
        F.count("session_uuid").alias("has_session_uuid"),
        F.count("domain").alias("has_domain"),
        F.count("job_role").alias("has_job_role"),
        F.count("license_type").alias("has_license_type"),
        F.count("created_at").alias("has_created_at"),
    )


def profile_overlap(t: Tables, p: Params) -> DataFrame:
    """How many page-view users have a snapshot. Both sides are distinct before the join."""
    known = t.users.select(F.col("id").alias("user_id")).distinct().withColumn("known", F.lit(1))
    users = t.pages.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    return users.join(known, "user_id", "left").agg(
        _n_rows().alias("pages_users"),
        F.count("known").alias("pages_matched_to_users"),
        F.count_if(F.col("known").isNull()).alias("pages_unmatched"),
    )


def profile_domain_coverage(t: Tables, p: Params) -> DataFrame:
    """Users and page views per domain, over all time."""
    return (
        t.pages.filter(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(
            F.count_distinct("user_id").alias("distinct_users"),
            _n_rows().alias("total_events"),
            F.min("timestamp").alias("earliest"),
            F.max("timestamp").alias("latest"),
        )
        .orderBy(F.desc("total_events"), "domain")
    )


def profile_top_events(t: Tables, p: Params) -> DataFrame:
    """The 30 most frequent events, whether or not their users have a domain."""
    return (
        drop_noise(t.tracks, p.include_workflows)
        .groupBy("event_text")
        .agg(_n_rows().alias("cnt"), F.count_distinct("user_id").alias("unique_users"))
        .orderBy(F.desc("cnt"), "event_text")
        .limit(30)
    )


def profile_role_sessions(t: Tables, p: Params) -> DataFrame:
    """Sessions and users per day and role in the snapshots; the 30 newest rows."""
    return (
        t.users.filter(F.col("session_uuid").isNotNull())
        .groupBy(F.to_date("received_at").alias("day"), "role")
        .agg(
            F.count_distinct("session_uuid").alias("unique_sessions"),
            F.count_distinct("id").alias("unique_users"),
        )
        .orderBy(F.desc_nulls_first("day"), F.asc_nulls_last("role"))
        .limit(30)
    )
