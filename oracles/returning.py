"""Cohorts, activation, churn, reactivation, day-N retention, funnel."""

from __future__ import annotations

from .base import DAYS, DOMAIN, END, LAST_MONTH, NOW, START, THIS_MONTH, TODAY, pct

_MINE = f"own = {DOMAIN}"


def _cohorts(scope: str) -> str:
    return f"""
        WITH um AS (SELECT DISTINCT user_id, lm FROM act
                    WHERE ts >= {START} AND home IS NOT NULL AND {scope}),
        firsts AS (SELECT user_id, min(lm) AS born FROM um GROUP BY user_id),
        sizes AS (SELECT born, count(DISTINCT user_id) AS size FROM firsts GROUP BY born),
        cells AS (SELECT f.born, date_diff('month', f.born, um.lm) AS age,
                         count(DISTINCT um.user_id) AS n
                  FROM firsts f JOIN um USING (user_id) GROUP BY ALL)
        SELECT born AS cohort_month, size AS cohort_size, age::INT AS months_since_start,
               n AS active_users, {pct('n', 'size')} AS retention_pct
        FROM cells JOIN sizes USING (born)
    """


def _day_n(signal: str) -> str:
    return f"""
        WITH days AS (SELECT DISTINCT user_id, ld FROM act WHERE ts >= {START} AND {_MINE}),
        back AS (SELECT DISTINCT user_id, ld FROM act
                 WHERE ts >= {START} AND {_MINE} AND {signal}),
        sizes AS (SELECT ld, count(DISTINCT user_id) AS size FROM days GROUP BY ld),
        cells AS (SELECT d.ld, o.n::INT AS day_n, count(DISTINCT b.user_id) AS kept
                  FROM days d CROSS JOIN range(0, {DAYS}) AS o(n)
                  LEFT JOIN back b ON b.user_id = d.user_id AND b.ld = d.ld + o.n::INT
                  GROUP BY ALL)
        SELECT ld AS cohort_date, size AS cohort_size, day_n, kept AS retained_users,
               {pct('kept', 'size')} AS retention_pct
        FROM cells JOIN sizes USING (ld) WHERE ld <= {TODAY} - {DAYS}
    """


_within = ", ".join(
    f"count(*) FILTER (WHERE delay <= {d}) AS activated_{d}d" for d in (1, 7, 14, 30)
)

SQL = {
    "monthly_retention_cohort": _cohorts(_MINE),
    "monthly_retention_cohort_all": _cohorts("true"),
    "activation_funnel": f"""
        WITH firsts AS (SELECT user_id, min(lts) AS first_lts FROM act WHERE {_MINE}
                        GROUP BY user_id),
        fresh AS (SELECT o.created_at, date_diff('day', o.created_at, f.first_lts) AS delay
                  FROM home h JOIN one o ON o.id = h.user_id
                  LEFT JOIN firsts f ON f.user_id = h.user_id
                  WHERE h.domain = {DOMAIN} AND o.created_at >= {START}),
        g AS (SELECT date_trunc('month', created_at)::DATE AS creation_month,
                     count(*) AS total_new_users, {_within},
                     count(*) FILTER (WHERE delay IS NULL) AS never_activated
              FROM fresh GROUP BY ALL)
        SELECT *, {pct('activated_1d', 'total_new_users')} AS pct_1d,
               {pct('activated_7d', 'total_new_users')} AS pct_7d,
               {pct('activated_30d', 'total_new_users')} AS pct_30d
        FROM g
    """,
    "churned_users": f"""
        WITH recent AS (SELECT user_id, lm FROM act
                        WHERE {_MINE} AND ts >= {NOW} - INTERVAL 3 MONTH),
        gone AS (SELECT user_id FROM recent WHERE lm = {LAST_MONTH}
                 EXCEPT SELECT user_id FROM recent WHERE lm = {THIS_MONTH})
        SELECT g.user_id, o.email, o.username, o.role, o.job_role,
               {LAST_MONTH} AS last_active_month
        FROM gone g LEFT JOIN one o ON o.id = g.user_id
    """,
    "reactivated_users": f"""
        WITH days AS (SELECT DISTINCT user_id, ld FROM act WHERE ts >= {START} AND {_MINE}),
        steps AS (SELECT *, lag(ld) OVER (PARTITION BY user_id ORDER BY ld) AS before FROM days)
        SELECT s.user_id, o.email, o.username, o.role, before AS last_active_before_gap,
               ld AS reactivation_date, (ld - before)::INT AS gap_days
        FROM steps s LEFT JOIN one o ON o.id = s.user_id WHERE ld - before >= 30
    """,
    "daily_retention_session_to_pageview": _day_n("src = 'page'"),
    "daily_retention_session_to_search": _day_n(
        "src = 'track' AND name IN "
        "('discovery_search_results', 'atlan_ai_conversation_prompt_submitted')"
    ),
    "daily_retention_session_to_session": _day_n("true"),
    "retention_rate_aggregate": f"""
        WITH firsts AS (SELECT user_id, min(ld) AS d0 FROM act
                        WHERE ts >= {START} AND {_MINE} GROUP BY user_id),
        viewed AS (SELECT DISTINCT f.user_id
                   FROM firsts f JOIN act a ON a.user_id = f.user_id AND a.src = 'page'
                        AND a.ld BETWEEN f.d0 AND f.d0 + 7
                   WHERE a.ts >= {START} AND a.{_MINE}),
        g AS (SELECT date_trunc('week', f.d0)::DATE AS cohort_week,
                     count(DISTINCT f.user_id) AS users_with_activity,
                     count(DISTINCT v.user_id) AS users_with_pageview_7d
              FROM firsts f LEFT JOIN viewed v USING (user_id)
              WHERE f.d0 <= {TODAY} - 7 GROUP BY ALL)
        SELECT *, {pct('users_with_pageview_7d', 'users_with_activity')} AS retention_rate_pct
        FROM g
    """,
    "funnel_session_to_pageview": f"""
        WITH span AS (SELECT * FROM act WHERE ts >= {START} AND ts < {END} AND {_MINE}),
        gov AS (SELECT DISTINCT t.user_id FROM tr t JOIN home h USING (user_id)
                WHERE t.ts >= {START} AND t.ts < {END} AND h.domain = {DOMAIN}
                  AND (t.name LIKE 'governance_%' OR t.name LIKE 'gtc_tree_create_%'
                       OR t.name LIKE 'asset_update_%')),
        people AS (SELECT s.user_id, count(*) FILTER (WHERE s.src = 'page') AS views,
                          bool_or(g.user_id IS NOT NULL) AS governed
                   FROM span s LEFT JOIN gov g ON g.user_id = s.user_id GROUP BY s.user_id),
        steps(step_name, step_order, need) AS (
            VALUES ('Step 1: Active User', 1, 0), ('Step 2: Pageview', 2, 1),
                   ('Step 3: 2+ Pageviews', 3, 2)),
        counted AS (
            SELECT step_name, step_order, count(user_id) AS n,
                   CASE WHEN need > 0 THEN count(user_id) FILTER (WHERE governed) END AS w,
                   CASE WHEN need > 0 THEN count(user_id) FILTER (WHERE NOT governed) END AS wo
            FROM steps LEFT JOIN people ON views >= need GROUP BY step_name, step_order, need),
        chained AS (SELECT *, first_value(n) OVER (ORDER BY step_order) AS n1,
                           lag(n) OVER (ORDER BY step_order) AS n0 FROM counted)
        SELECT step_name, step_order, n AS total_users, w AS with_governance,
               wo AS without_governance, {pct('n', 'n1')} AS conversion_from_step1_pct,
               {pct('n', 'n0')} AS conversion_from_prev_pct
        FROM chained
    """,
}
