"""Which pages, events, connectors and features customers use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INT_DIVISION, mean, ratio
from ..functions.taxonomy import MATRIX, QUADRANT, TREND, Taxonomy
from ..operators.activity import (
    month_key,
    own_domain_activity,
    page_rows,
    roll_up,
    track_rows,
    week_key,
)
from ..operators.domains import domains_of, in_domain
from ..operators.users import identities
from ..params import Params
from ..sources.tables import Tables

_TOP = 50


def top_pages_by_domain(t: Tables, p: Params) -> DataFrame:
    """Most viewed (page, tab) pairs; a missing tab is a group of its own."""
    views = in_domain(t.pages_between(p.start), p).filter(
        F.col("name").isNotNull() & F.col("domain").isNotNull()
    )
    return (
        views.groupBy("domain", F.col("name").alias("page_name"), "tab")
        .agg(
            F.count(F.lit(1)).alias("page_views"),
            F.count_distinct("user_id").alias("unique_users"),
        )
        .withColumn("views_per_user", _per_user("page_views"))
        .orderBy(F.desc("page_views"), "domain", "page_name", F.asc_nulls_last("tab"))
        .limit(_TOP)
    )


def top_events_by_domain(t: Tables, p: Params) -> DataFrame:
    """Most frequent events of users with a known domain."""
    per_user = roll_up(track_rows(t, p, p.start), [F.col("name").alias("event_text")])
    return (
        per_user.join(domains_of(t, p.domain), "user_id")
        .groupBy("domain", "event_text")
        .agg(
            F.sum("events").alias("event_count"),
            F.count("user_id").alias("unique_users"),
        )
        .withColumn("events_per_user", _per_user("event_count"))
        .orderBy(F.desc("event_count"), "domain", "event_text")
        .limit(_TOP)
    )


def _per_user(total: str) -> Column:
    return ratio(F.col(total), F.col("unique_users"), scale=1, division=INT_DIVISION)


def connector_usage(t: Tables, p: Params) -> DataFrame:
    """Interactions per connector and asset type.

    Users and assets are collapsed and counted separately, so no row is repeated for a second
    distinct count; the joined results have one row per connector and type.
    """
    views = in_domain(t.pages_between(p.start), p).filter(
        F.col("connector_name").isNotNull() & F.col("domain").isNotNull()
    )
    views = views.withColumn("asset_type", F.col("type_name"))
    group = ["domain", "connector_name", "asset_type"]
    users = (
        views.groupBy(*group, "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*group)
        .agg(F.sum("n").alias("interactions"), F.count("user_id").alias("unique_users"))
    )
    assets = (
        views.groupBy(*group, "asset_guid")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*group)
        .agg(F.count("asset_guid").alias("unique_assets_viewed"))
        .withColumnRenamed("asset_type", "counted_type")
    )
    same_type = F.col("asset_type").eqNullSafe(F.col("counted_type"))
    return (
        users.join(assets, ["domain", "connector_name"])
        .filter(same_type)
        .select(*group, "interactions", "unique_users", "unique_assets_viewed")
        .orderBy(F.desc("interactions"), *group)
    )


# Output flag and the feature area it reports. Fixed values.
_FLAGS = {
    "used_discovery": "Discovery",
    "used_chrome_ext": "Chrome Extension",
    "used_insights": "Insights/SQL",
    "used_governance": "Governance",
    "used_ai_copilot": "AI Copilot",
    "used_lineage": "Lineage",
    "used_asset_profile": "Asset Profile",
    "used_admin": "Admin",
    "used_workflows": "Workflows",
    "used_data_quality": "Data Quality",
    "used_data_products": "Data Products",
    "used_marketplace": "Marketplace",
}


def feature_adoption_matrix(t: Tables, p: Params) -> DataFrame:
    """0/1 use of twelve features per month and user.

    A user who touched only an area without a flag (Home, Notifications, Usage Analytics)
    still gets a row, of zeros. Flags are maxima, so duplicates need no removal. A user with
    several (email, username, role) combinations gets one row for each.
    """
    p.require_domain()
    used = _feature_activity(t, p, MATRIX, month_key(p).alias("activity_month"))
    flags = used.groupBy("domain", "activity_month", "user_id").agg(
        *[
            F.max(F.when(F.col("feature") == area, 1).otherwise(0)).alias(flag)
            for flag, area in _FLAGS.items()
        ]
    )
    known = identities(t.users).select(
        F.col("id").alias("user_id"), "email", "username", "role"
    )
    return (
        flags.join(known, "user_id", "left")
        .select(
            "domain", "activity_month", "user_id", "email", "username", "role", *_FLAGS
        )
        .orderBy(F.desc("activity_month"), "user_id", "email", "username", "role")
    )


def feature_engagement_quadrant(t: Tables, p: Params) -> DataFrame:
    """Reach (users) against depth (events per user) of each feature.

    Average and exact median come from the histogram (feature, events per user).
    """
    histogram = (
        _feature_activity(t, p, QUADRANT)
        .groupBy("feature", "user_id")
        .agg(F.sum("events").alias("events"))
        .groupBy("feature", "events")
        .agg(F.count(F.lit(1)).alias("n"), F.count("user_id").alias("users"))
    )
    total = F.sum(F.col("events") * F.col("n"))
    return (
        histogram.groupBy("feature")
        .agg(
            F.sum("users").alias("unique_users"),
            total.alias("total_events"),
            mean(total, F.sum("n")).alias("avg_events_per_user"),
            F.percentile("events", 0.5, F.col("n")).alias("median_events_per_user"),
        )
        .orderBy(F.desc("unique_users"), "feature")
    )


def feature_trend_weekly(t: Tables, p: Params) -> DataFrame:
    """Users and events per week and feature."""
    p.require_domain()
    return (
        _feature_activity(t, p, TREND, week_key(p))
        .groupBy("event_week", F.col("feature").alias("feature_area"))
        .agg(
            F.count_distinct("user_id").alias("unique_users"),
            F.sum("events").alias("total_events"),
        )
        .orderBy(F.desc("event_week"), F.desc("unique_users"), "feature_area")
    )


def _feature_activity(t: Tables, p: Params, taxonomy: Taxonomy, *keys: Column) -> DataFrame:
    """Activity by own page domain with a ``feature``; rows without one are dropped."""
    name = F.col("name")
    pages = in_domain(page_rows(t, p.start), p).withColumn("feature", taxonomy.page_label(name))
    tracks = track_rows(t, p, p.start).withColumn("feature", taxonomy.event_label(name))
    labelled = F.col("feature").isNotNull()
    return own_domain_activity(
        pages.filter(labelled),
        tracks.filter(labelled),
        domains_of(t, p.domain),
        [*keys, "feature"],
    )
