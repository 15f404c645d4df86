"""Customer health and account review."""

from __future__ import annotations

from .base import (
    DOMAIN,
    LAST_MONTH,
    NOW,
    START,
    THIS_MONTH,
    TODAY,
    half_up,
    pct,
    ratio,
)
from .rules import labelled

_UNIT = 10**7

# Users per domain and month, features of this month, all by the user's domain.
_MONTHS = f"""
    mine AS (SELECT user_id, home AS domain, ld, lm FROM act
             WHERE home IS NOT NULL AND ts >= {START}),
    mau AS (SELECT domain, lm, count(DISTINCT user_id) AS n, count(DISTINCT (user_id, ld)) AS ud
            FROM mine GROUP BY ALL),
    sizes AS (SELECT domain, count(*) AS members FROM home GROUP BY domain)
"""

_FEATURES = f"""
    {labelled('breadth')},
    breadth AS (SELECT home AS domain, count(DISTINCT feature) AS areas FROM lab
                WHERE src = 'page' AND home IS NOT NULL AND ts >= {THIS_MONTH} GROUP BY home)
"""


def _use_by(attribute: str, since: str, scope: str, user_scope: str, inactive: bool) -> str:
    share, label = ("utilization_pct", "license_type") if inactive else ("active_pct", attribute)
    extra = "total_users - active_users AS inactive_users," if inactive else ""
    return f"""
        WITH g AS (
            SELECT h.domain, o.role, o.{attribute}, count(*) AS total_users,
                   count(*) FILTER (WHERE EXISTS (
                       FROM act a WHERE a.user_id = h.user_id AND {scope} AND a.ts >= {since}))
                       AS active_users
            FROM home h LEFT JOIN one o ON o.id = h.user_id WHERE {user_scope} GROUP BY ALL)
        SELECT domain, role, {label}, total_users, active_users, {extra}
               {pct('active_users', 'total_users')} AS {share}
        FROM g
    """


_MONTH_AGO = f"{NOW} - INTERVAL 1 MONTH"
_THIRTY_DAYS = f"{NOW} - INTERVAL 30 DAY"
_OWN, _HOME = f"a.own = {DOMAIN}", f"h.domain = {DOMAIN}"

_SCORE = half_up(
    f"25 * least({half_up('curr * 1000000', 'members')}, 1000000) * 10"
    f" + trend2 * {25 * _UNIT // 2} + {half_up(f'areas * {25 * _UNIT}', '6')}"
    f" + {half_up(f'kept * {25 * _UNIT}', 'nullif(gone_or_kept, 1)')}",
    str(_UNIT),
)

SQL = {
    "customer_health_scorecard": f"""
        WITH {_MONTHS}, {_FEATURES},
        wide AS (
            SELECT domain, max(n) FILTER (WHERE lm = {THIS_MONTH}) AS curr0,
                   max(ud) FILTER (WHERE lm = {THIS_MONTH}) AS ud,
                   max(n) FILTER (WHERE lm = {LAST_MONTH}) AS prev0,
                   sum(n) AS total, count(*) AS months
            FROM mau WHERE lm >= DATE '2024-01-01' GROUP BY domain),
        prior AS (SELECT DISTINCT user_id, domain FROM mine WHERE lm = {LAST_MONTH}),
        loyal AS (SELECT p.domain, count(*) AS gone_or_kept,
                        count(*) FILTER (WHERE p.user_id IN
                            (SELECT user_id FROM mine WHERE lm = {THIS_MONTH})) AS kept
                 FROM prior p GROUP BY p.domain),
        j AS (
            SELECT w.domain, z.members, coalesce(curr0, 0) AS curr, coalesce(prev0, 0) AS prev,
                   curr0, ud, total, months, coalesce(areas, 0) AS areas,
                   coalesce(kept, 0) AS kept, gone_or_kept,
                   CASE WHEN prev0 IS NULL THEN 1 WHEN curr0 >= prev0 THEN 2
                        WHEN curr0 * 10 >= prev0 * 8 THEN 1 ELSE 0 END AS trend2
            FROM wide w JOIN sizes z USING (domain) LEFT JOIN breadth USING (domain)
            LEFT JOIN loyal USING (domain)),
        scored AS (SELECT *, ({_SCORE})::DOUBLE AS score FROM j)
        SELECT domain, members AS total_user_count, curr AS current_mau, prev AS prev_mau,
               {ratio('total', 'months', 0, 1, 6)} AS avg_mau_3m,
               {pct('curr', 'members')} AS license_util_pct,
               {ratio('ud', 'curr0 * 29', 3, 1, 6)} AS stickiness, areas AS features_used,
               {pct('kept', 'gone_or_kept')} AS retention_pct, score AS health_score,
               CASE WHEN score >= 70 THEN 'Healthy' WHEN score >= 40 THEN 'At Risk'
                    ELSE 'Critical' END AS health_status
        FROM scored
    """,
    "domain_summary_snapshot": f"""
        WITH a AS (SELECT * FROM act WHERE ts >= {START} AND name IS NOT NULL),
        g AS (SELECT h.domain, count(DISTINCT h.user_id) AS total_users,
                     count(DISTINCT a.user_id) FILTER (WHERE a.lm = {THIS_MONTH}) AS now_n,
                     count(DISTINCT a.user_id) FILTER (WHERE a.lm = {LAST_MONTH}) AS prev_n,
                     max(a.lts) AS last_activity
              FROM home h LEFT JOIN a ON a.user_id = h.user_id GROUP BY h.domain)
        SELECT domain, total_users, now_n AS active_this_month, prev_n AS active_last_month,
               now_n - prev_n AS mau_delta, {pct('now_n - prev_n', 'prev_n')} AS mau_change_pct,
               {pct('now_n', 'total_users')} AS license_util_pct, last_activity,
               ({TODAY} - last_activity::DATE)::INT AS days_since_last_activity
        FROM g
    """,
    "license_utilization": _use_by("license_type", _MONTH_AGO, _OWN, _HOME, True),
    "license_utilization_all": _use_by("license_type", _MONTH_AGO, "true", "true", True),
    "role_distribution": _use_by("job_role", _THIRTY_DAYS, _OWN, _HOME, False),
    "role_distribution_all": _use_by("job_role", _THIRTY_DAYS, "true", "true", False),
    "qbr_deck_data": f"""
        WITH a AS (SELECT * FROM act WHERE name IS NOT NULL AND own = {DOMAIN}
                   AND ts >= {NOW} - INTERVAL 6 MONTH),
        months AS (SELECT lm, count(DISTINCT user_id) AS n FROM a GROUP BY lm),
        pages_top AS (SELECT name, count(DISTINCT user_id) AS n FROM a WHERE src = 'page'
                      GROUP BY name ORDER BY n DESC, name LIMIT 10),
        users_top AS (SELECT o.email, o.role, count(*) AS n
                      FROM a LEFT JOIN one o ON o.id = a.user_id GROUP BY ALL
                      ORDER BY n DESC, email NULLS LAST, role NULLS LAST LIMIT 10),
        fresh AS (SELECT date_trunc('month', o.created_at)::DATE AS m, count(*) AS n
                  FROM home h JOIN one o ON o.id = h.user_id
                  WHERE h.domain = {DOMAIN} AND o.created_at >= {NOW} - INTERVAL 6 MONTH
                  GROUP BY ALL)
        SELECT '1_MAU_TREND' AS section, strftime(lm, '%Y-%m-%d') AS period,
               n::VARCHAR AS metric_value, 'monthly_active_users' AS metric_name FROM months
        UNION ALL SELECT '2_TOP_FEATURES', name, n::VARCHAR, 'unique_users' FROM pages_top
        UNION ALL SELECT '3_TOP_USERS', email, n::VARCHAR, role FROM users_top
        UNION ALL SELECT '4_NEW_USERS', strftime(m, '%Y-%m-%d'), n::VARCHAR, 'new_users'
        FROM fresh
    """,
    "multi_customer_comparison": f"""
        WITH {_MONTHS}, {_FEATURES},
        j AS (
            SELECT z.domain, z.members, coalesce(c.n, 0) AS curr, coalesce(p.n, 0) AS prev,
                   coalesce(c.ud, 0) AS ud, coalesce(c.n, 1) * 30 AS possible,
                   coalesce(b.areas, 0) AS areas
            FROM sizes z LEFT JOIN mau c ON c.domain = z.domain AND c.lm = {THIS_MONTH}
            LEFT JOIN mau p ON p.domain = z.domain AND p.lm = {LAST_MONTH}
            LEFT JOIN breadth b ON b.domain = z.domain)
        SELECT domain, members AS total_users, curr AS current_mau, prev AS prev_mau,
               curr - prev AS mau_delta, {pct('curr', 'members')} AS license_util_pct,
               {ratio('ud', 'possible', 3)} AS stickiness, areas AS feature_breadth
        FROM j
    """,
    "trending_alert": f"""
        WITH {_MONTHS},
        c AS (SELECT c.domain, c.n AS curr, c.ud, p.n AS prev, c.n * 30 AS possible
              FROM mau c LEFT JOIN mau p ON p.domain = c.domain AND p.lm = {LAST_MONTH}
              WHERE c.lm = {THIS_MONTH}),
        fresh AS (SELECT DISTINCT h.domain FROM home h JOIN one o ON o.id = h.user_id
                  WHERE o.created_at >= {NOW} - INTERVAL 30 DAY)
        SELECT domain, 'MAU_DROP_20PCT' AS alert_type,
               format('MAU dropped from {{}} to {{}} ({{:.1f}}%)', prev, curr,
                      {pct('curr - prev', 'prev')}) AS detail
        FROM c WHERE curr * 10 < prev * 8
        UNION ALL
        SELECT domain, 'ZERO_NEW_USERS', 'No new users created in the last 30 days'
        FROM sizes WHERE domain NOT IN (SELECT domain FROM fresh)
        UNION ALL
        SELECT domain, 'LOW_STICKINESS', 'DAU/MAU ratio: ' || regexp_replace(
               format('{{:.3f}}', {ratio('ud', 'possible', 3)}), '\\.?0+$', '')
        FROM c WHERE ud * 20 < possible
    """,
}
