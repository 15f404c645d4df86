"""All reports by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..params import Params
from ..sources.tables import Tables
from . import active, adoption, engagement, health, profile, retention, review

Report = Callable[[Tables, Params], DataFrame]

REPORTS: dict[str, Report] = {
    report.__name__: report
    for report in (
        profile.discover_domains,
        profile.discover_events,
        profile.discover_pages,
        profile.profile_tracks,
        profile.profile_pages,
        profile.profile_users,
        profile.profile_overlap,
        profile.profile_domain_coverage,
        profile.profile_top_events,
        profile.profile_role_sessions,
        active.dau_by_domain,
        active.wau_by_domain,
        active.mau_by_domain,
        active.mau_dau_ratio,
        active.user_roster_by_domain,
        adoption.top_pages_by_domain,
        adoption.top_events_by_domain,
        adoption.connector_usage,
        adoption.feature_adoption_matrix,
        adoption.feature_engagement_quadrant,
        adoption.feature_trend_weekly,
        engagement.session_duration,
        engagement.session_duration_daily,
        engagement.actions_per_session,
        engagement.engagement_tiers,
        engagement.power_users,
        engagement.daily_engagement_matrix,
        engagement.avg_pageviews_per_user_daily,
        retention.monthly_retention_cohort,
        retention.activation_funnel,
        retention.churned_users,
        retention.reactivated_users,
        retention.daily_retention_session_to_pageview,
        retention.daily_retention_session_to_search,
        retention.daily_retention_session_to_session,
        retention.retention_rate_aggregate,
        retention.funnel_session_to_pageview,
        health.customer_health_scorecard,
        health.domain_summary_snapshot,
        health.license_utilization,
        health.role_distribution,
        review.qbr_deck_data,
        review.multi_customer_comparison,
        review.trending_alert,
    )
}

#: Reports that also run over all customers, with ``domain=None``.
ALL_CUSTOMERS = (
    "dau_by_domain",
    "wau_by_domain",
    "mau_by_domain",
    "mau_dau_ratio",
    "top_pages_by_domain",
    "top_events_by_domain",
    "connector_usage",
    "feature_engagement_quadrant",
    "monthly_retention_cohort",
    "license_utilization",
    "role_distribution",
)
