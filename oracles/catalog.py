"""Profiles, catalogs, building blocks and the semantic model."""

from __future__ import annotations

from .base import DOMAIN, NOW, START

_RECENT = f"ts >= {NOW} - INTERVAL 3 MONTH"


def _events(more: str) -> str:
    return f"""
        SELECT name AS event_text, count(*) AS total_occurrences,
               count(DISTINCT user_id) AS unique_users, count(DISTINCT home) AS domains_using,
               min(ts)::DATE AS first_seen, max(ts)::DATE AS last_seen
        FROM act WHERE src = 'track' AND home IS NOT NULL AND {_RECENT} {more} GROUP BY name
    """


SQL = {
    "discover_domains": f"""
        SELECT domain, count(DISTINCT user_id) AS total_users, count(*) AS total_pageviews,
               min(ts)::DATE AS first_activity, max(ts)::DATE AS last_activity
        FROM pv WHERE domain IS NOT NULL AND {_RECENT} GROUP BY domain
    """,
    "discover_events": _events(""),
    "discover_pages": f"""
        SELECT name AS page_name, count(*) AS total_views,
               count(DISTINCT user_id) AS unique_users, count(DISTINCT domain) AS domains_using,
               min(ts)::DATE AS first_seen, max(ts)::DATE AS last_seen
        FROM pv WHERE name IS NOT NULL AND {_RECENT} GROUP BY name
    """,
    "profile_tracks": """
        SELECT 'TRACKS' AS table_name, count(*) AS total_rows,
               count(DISTINCT user_id) AS distinct_users, min(ts) AS earliest_event,
               max(ts) AS latest_event, count(DISTINCT ts::DATE) AS days_with_data,
               count(amplitude) AS has_amplitude_session_id,
               count(DISTINCT name) AS distinct_event_types
        FROM tr
    """,
    "profile_pages": """
        SELECT 'PAGES' AS table_name, count(*) AS total_rows,
               count(DISTINCT user_id) AS distinct_users, min(ts) AS earliest_event,
               max(ts) AS latest_event, count(DISTINCT ts::DATE) AS days_with_data,
               count(domain) AS has_domain, count(email) AS has_email,
               count(session_uuid) AS has_session_uuid,
               count(amplitude) AS has_amplitude_session_id,
               count(DISTINCT name) AS distinct_page_names
        FROM pv
    """,
    "profile_users": """
        SELECT 'USERS' AS table_name, count(*) AS total_rows,
               count(DISTINCT id) AS distinct_users, min(received_at) AS earliest_received,
               max(received_at) AS latest_received, count(email) AS has_email,
               count(role) AS has_role, count(session_uuid) AS has_session_uuid,
               count(domain) AS has_domain, count(job_role) AS has_job_role,
               count(license_type) AS has_license_type, count(created_at) AS has_created_at
        FROM snap
    """,
    "profile_overlap": """
        SELECT count(DISTINCT user_id) AS pages_users,
               count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT id FROM snap))
                   AS pages_matched_to_users,
               count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT id FROM snap))
                   AS pages_unmatched
        FROM pv
    """,
    "profile_domain_coverage": """
        SELECT domain, count(DISTINCT user_id) AS distinct_users, count(*) AS total_events,
               min(ts) AS earliest, max(ts) AS latest
        FROM pv WHERE domain IS NOT NULL GROUP BY domain
    """,
    "profile_top_events": """
        SELECT name AS event_text, count(*) AS cnt, count(DISTINCT user_id) AS unique_users
        FROM kept GROUP BY name ORDER BY cnt DESC, name LIMIT 30
    """,
    "profile_role_sessions": """
        SELECT received_at::DATE AS day, role, count(DISTINCT session_uuid) AS unique_sessions,
               count(DISTINCT id) AS unique_users
        FROM snap WHERE session_uuid IS NOT NULL GROUP BY ALL
        ORDER BY day DESC NULLS FIRST, role ASC NULLS LAST LIMIT 30
    """,
    "user_domains": "SELECT user_id, domain FROM home",
    "activity_events": f"""
        SELECT user_id, lts AS event_ts, ld AS event_date, lw AS event_week, lm AS event_month,
               src AS source, name AS activity_name, own AS domain
        FROM act WHERE ts >= {START}
    """,
    "user_meta": """
        SELECT id, email, username, domain, role, max(license_type) AS license_type,
               max(job_role) AS job_role, max(personas) AS personas, max(plan) AS plan,
               max(account) AS salesforce_account_id, min(created_at) AS user_created_at,
               min(tenant_created_at) AS tenant_created_at,
               max(received_at) AS last_identified_at, max(session_uuid) AS last_session_uuid
        FROM snap WHERE email IS NOT NULL GROUP BY id, email, username, domain, role
    """,
    "model_pages": """
        SELECT p.domain, o.role AS users_role, count(*) AS event_count
        FROM pv p LEFT JOIN one o ON o.id = p.user_id GROUP BY ALL
    """,
    "model_tracks": """
        SELECT t.name AS event_text, o.license_type AS users_license_type,
               count(*) AS event_count
        FROM tr t LEFT JOIN one o ON o.id = t.user_id GROUP BY ALL
    """,
    "model_users": "SELECT role, plan, count(*) AS user_count FROM snap GROUP BY ALL",
    "model_pages_of_admins": """
        SELECT p.domain, p.name, count(*) AS event_count
        FROM pv p JOIN one o ON o.id = p.user_id WHERE o.role = 'admin' GROUP BY ALL
    """,
    "model_tracks_where": """
        SELECT o.role AS users_role, o.job_role AS users_job_role, count(*) AS event_count
        FROM tr t LEFT JOIN one o ON o.id = t.user_id
        WHERE t.name LIKE 'discovery%' GROUP BY ALL
    """,
    "model_tracks_of_march": """
        SELECT name AS event_text, count(*) AS event_count FROM tr
        WHERE ts >= TIMESTAMP '2024-03-01' AND ts < TIMESTAMP '2024-04-01' GROUP BY ALL
    """,
    "model_tracks_dates": """
        SELECT NULL::DATE AS date_derived, NULL::TIMESTAMP AS received_at, count(*) AS event_count
        FROM tr
    """,
    "model_users_dates": """
        SELECT created_at, tenant_created_at, count(*) AS user_count FROM snap GROUP BY ALL
    """,
    "model_pages_total": "SELECT count(*) AS event_count FROM pv",
    "model_pages_dimensions": "SELECT DISTINCT tab, asset_type AS type_name FROM pv",
    "user_domains_incremental": "SELECT user_id, domain FROM home",
    "discover_events_term": _events("AND contains(lower(name), 'discovery')"),
    "discover_events_domain": _events(f"AND home = {DOMAIN}"),
}
