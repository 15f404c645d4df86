"""Active users and adoption."""

from __future__ import annotations

from .base import DOMAIN, NOW, START, half_up, mean, pct, ratio
from .rules import labelled

_MINE = f"own = {DOMAIN}"
_ANY = "(src = 'page' OR own IS NOT NULL)"  # events of users without a domain never count


def _actives(key: str, column: str, measure: str, scope: str) -> str:
    return f"""
        SELECT own AS domain, {key} AS {column}, count(DISTINCT user_id) AS {measure}
        FROM act WHERE ts >= {START} AND {scope} GROUP BY ALL
    """


def _mau(scope: str) -> str:
    change = pct("mau - prev", "prev")
    return f"""
        WITH m AS ({_actives('lm', 'event_month', 'mau', scope)}),
        c AS (SELECT *, lag(mau) OVER (PARTITION BY domain ORDER BY event_month) AS prev FROM m)
        SELECT domain, event_month, mau, prev AS prev_month_mau, mau - prev AS mau_delta,
               {change} AS mau_change_pct
        FROM c
    """


def _stickiness(scope: str) -> str:
    avg6 = half_up("total::HUGEINT * 1000000", "days")
    return f"""
        WITH d AS (SELECT own, lm, ld, count(DISTINCT user_id) AS dau
                   FROM act WHERE ts >= {START} AND {scope} GROUP BY ALL),
        m AS (SELECT own, lm, count(DISTINCT user_id) AS mau
              FROM act WHERE ts >= {START} AND {scope} GROUP BY ALL),
        j AS (SELECT m.own, m.lm, m.mau, sum(d.dau) AS total, count(*) AS days
              FROM m JOIN d ON d.own = m.own AND d.lm = m.lm GROUP BY ALL),
        a AS (SELECT *, {avg6} AS avg6, total / days / nullif(mau, 0) AS share FROM j)
        SELECT own AS domain, lm AS event_month, mau,
               {ratio('avg6', '1000000', 1)} AS avg_dau,
               {ratio('avg6', 'mau * 1000000', 3, 1, 12)} AS stickiness_ratio,
               CASE WHEN share >= 0.3::DOUBLE THEN 'Strong'
                    WHEN share >= 0.1::DOUBLE THEN 'Moderate'
                    ELSE 'Episodic' END AS engagement_level
        FROM a
    """


def _top_pages(scope: str) -> str:
    return f"""
        WITH g AS (SELECT own AS domain, name, tab, count(*) AS n, count(DISTINCT user_id) AS u
                   FROM (SELECT *, domain AS own, 'page' AS src FROM pv)
                   WHERE ts >= {START} AND name IS NOT NULL AND own IS NOT NULL AND {scope}
                   GROUP BY ALL)
        SELECT domain, name AS page_name, tab, n AS page_views, u AS unique_users,
               {ratio('n', 'u', 1, 1, 6)} AS views_per_user
        FROM g ORDER BY n DESC, domain, name, tab NULLS LAST LIMIT 50
    """


def _top_events(scope: str) -> str:
    return f"""
        WITH g AS (SELECT own AS domain, name, count(*) AS n, count(DISTINCT user_id) AS u
                   FROM act WHERE src = 'track' AND ts >= {START} AND {scope} GROUP BY ALL)
        SELECT domain, name AS event_text, n AS event_count, u AS unique_users,
               {ratio('n', 'u', 1, 1, 6)} AS events_per_user
        FROM g ORDER BY n DESC, domain, name LIMIT 50
    """


def _connectors(scope: str) -> str:
    return f"""
        SELECT domain, connector AS connector_name, asset_type, count(*) AS interactions,
               count(DISTINCT user_id) AS unique_users,
               count(DISTINCT asset) AS unique_assets_viewed
        FROM pv WHERE ts >= {START} AND connector IS NOT NULL AND domain IS NOT NULL AND {scope}
        GROUP BY ALL
    """


def _quadrant(scope: str) -> str:
    return f"""
        WITH {labelled('quadrant')},
        per_user AS (SELECT feature, user_id, count(*) AS n FROM lab
                     WHERE ts >= {START} AND feature IS NOT NULL AND {scope} GROUP BY ALL),
        f AS (SELECT feature, count(DISTINCT user_id) AS u, sum(n)::BIGINT AS total,
                     count(*) AS groups, median(n) AS med
              FROM per_user GROUP BY feature)
        SELECT feature, u AS unique_users, total AS total_events,
               {mean('total', 'groups')} AS avg_events_per_user,
               round(med, 1)::DOUBLE AS median_events_per_user
        FROM f
    """


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
_flag_columns = ", ".join(
    f"bool_or(feature = '{area}')::INT AS {flag}" for flag, area in _FLAGS.items()
)

_IDENTITY = """
    ident AS (SELECT id, email, username, role, max(license_type) AS license_type,
                     max(job_role) AS job_role, min(created_at) AS user_created_at
              FROM snap WHERE email IS NOT NULL GROUP BY id, email, username, role)
"""

SQL = {
    "dau_by_domain": _actives("ld", "event_date", "dau", _MINE),
    "dau_by_domain_all": _actives("ld", "event_date", "dau", _ANY),
    "wau_by_domain": _actives("lw", "event_week", "wau", _MINE),
    "wau_by_domain_all": _actives("lw", "event_week", "wau", _ANY),
    "mau_by_domain": _mau(_MINE),
    "mau_by_domain_all": _mau(_ANY),
    "mau_dau_ratio": _stickiness(_MINE),
    "mau_dau_ratio_all": _stickiness(_ANY),
    "user_roster_by_domain": f"""
        WITH {_IDENTITY},
        u AS (SELECT user_id, count(*) AS n, count(DISTINCT ld) AS days, min(lts) AS first_lts,
                     max(lts) AS last_lts
              FROM act WHERE ts >= {START} AND {_MINE} GROUP BY user_id)
        SELECT user_id, email, username, role, license_type, job_role, user_created_at,
               n AS total_events, days AS active_days, first_lts AS first_activity,
               last_lts AS last_activity,
               date_diff('day', last_lts, {NOW})::INT AS days_since_last_activity,
               CASE WHEN last_lts >= {NOW} - INTERVAL 30 DAY THEN 'Active'
                    WHEN last_lts >= {NOW} - INTERVAL 90 DAY THEN 'Inactive'
                    ELSE 'Churned' END AS status
        FROM u LEFT JOIN ident ON id = user_id
    """,
    "top_pages_by_domain": _top_pages(_MINE),
    "top_pages_by_domain_all": _top_pages(_ANY),
    "top_events_by_domain": _top_events(_MINE),
    "top_events_by_domain_all": _top_events(_ANY),
    "connector_usage": _connectors(f"domain = {DOMAIN}"),
    "connector_usage_all": _connectors("true"),
    "feature_adoption_matrix": f"""
        WITH {labelled('matrix')}, {_IDENTITY}
        SELECT own AS domain, lm AS activity_month, user_id, email, username, role,
               {_flag_columns}
        FROM lab LEFT JOIN ident ON id = user_id
        WHERE ts >= {START} AND feature IS NOT NULL AND {_MINE}
        GROUP BY own, lm, user_id, email, username, role
    """,
    "feature_engagement_quadrant": _quadrant(_MINE),
    "feature_engagement_quadrant_all": _quadrant(_ANY),
    "feature_trend_weekly": f"""
        WITH {labelled('trend')}
        SELECT lw AS event_week, feature AS feature_area, count(DISTINCT user_id) AS unique_users,
               count(*) AS total_events
        FROM lab WHERE ts >= {START} AND feature IS NOT NULL AND {_MINE} GROUP BY ALL
    """,
}

