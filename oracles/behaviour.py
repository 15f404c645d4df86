"""Sessions, tiers, power users, daily distribution."""

from __future__ import annotations

from .base import DOMAIN, START, mean, pct, ratio
from .rules import labelled

_HOME = f"home = {DOMAIN}"


def _sessions(rows: str) -> str:
    """CTE ``s``: sessions numbered per user from single events of ``rows`` (user_id, ts)."""
    return f"""
ev AS ({rows}),
gaps AS (
    SELECT user_id, ts, epoch_us(ts) // 1000000
           - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) // 1000000 AS gap
    FROM ev
),
numbered AS (
    SELECT user_id, ts, sum((gap IS NULL OR gap > 1800)::INT)
           OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session_id
    FROM gaps
),
s AS (
    SELECT user_id, session_id, count(*) AS n, min(ts) AS t0, max(ts) AS t1,
           min(ts) + INTERVAL 330 MINUTE AS l0, max(ts) + INTERVAL 330 MINUTE AS l1,
           epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS seconds,
           date_diff('minute', min(ts), max(ts)) AS minutes
    FROM numbered GROUP BY user_id, session_id
)"""


_MY_SESSIONS = _sessions(f"SELECT user_id, ts FROM act WHERE ts >= {START} AND {_HOME}")

SQL = {
    "derived_sessions": f"""
        WITH {_sessions(f"SELECT user_id, ts FROM act WHERE ts >= {START}")}
        SELECT user_id, session_id, l0::DATE AS session_date, l0 AS session_start,
               l1 AS session_end, n AS event_count, seconds AS duration_seconds
        FROM s
    """,
    "session_duration": f"""
        WITH {_MY_SESSIONS},
        g AS (SELECT date_trunc('month', l0)::DATE AS session_month, count(*) AS c,
                     count(DISTINCT user_id) AS u, sum(minutes)::BIGINT AS total,
                     median(minutes) AS med, sum(n)::BIGINT AS events, max(minutes) AS longest
              FROM s WHERE n > 1 AND minutes BETWEEN 1 AND 479 GROUP BY ALL)
        SELECT {DOMAIN} AS domain, session_month, c AS total_sessions, u AS unique_users,
               {mean('total', 'c')} AS avg_session_minutes, med AS median_session_minutes,
               {mean('events', 'c')} AS avg_events_per_session, longest AS max_session_minutes
        FROM g
    """,
    "session_duration_daily": f"""
        WITH {_MY_SESSIONS},
        g AS (SELECT l0::DATE AS session_date, count(*) AS c, count(DISTINCT user_id) AS u,
                     sum(seconds)::BIGINT AS total, median(seconds) AS med,
                     sum(n)::BIGINT AS events, max(seconds) AS longest
              FROM s WHERE n > 1 AND seconds BETWEEN 1 AND 28799 GROUP BY ALL)
        SELECT session_date, c AS total_sessions, u AS unique_users,
               {mean('total', 'c')} AS avg_duration_seconds, med AS median_duration_seconds,
               {mean('events', 'c')} AS avg_events_per_session, longest AS max_duration_seconds
        FROM g
    """,
    "actions_per_session": f"""
        WITH {_MY_SESSIONS},
        g AS (SELECT date_trunc('month', l0)::DATE AS event_month, count(*) AS c,
                     sum(n)::BIGINT AS events, median(n) AS med, quantile_cont(n, 0.9) AS p90
              FROM s GROUP BY ALL)
        SELECT {DOMAIN} AS domain, event_month, c AS total_sessions,
               {mean('events', 'c')} AS avg_actions_per_session,
               med AS median_actions_per_session, round(p90, 1) AS p90_actions
        FROM g
    """,
    "engagement_tiers": f"""
        WITH mine AS (SELECT user_id, lm FROM act WHERE ts >= {START} AND {_HOME}),
        grid AS (SELECT h.user_id, m.lm FROM home h, (SELECT DISTINCT lm FROM mine) m
                 WHERE h.domain = {DOMAIN}),
        counted AS (SELECT g.lm, g.user_id, count(x.user_id) AS n
                    FROM grid g LEFT JOIN mine x ON x.user_id = g.user_id AND x.lm = g.lm
                    GROUP BY ALL),
        placed_users AS (
            SELECT lm, n, percent_rank() OVER (PARTITION BY lm ORDER BY n) AS pr,
                   median(n) FILTER (WHERE n > 0) OVER (PARTITION BY lm) AS med
            FROM counted),
        tiered AS (SELECT lm, CASE WHEN n = 0 THEN 'Dormant' WHEN pr >= 0.9::DOUBLE THEN 'Power'
                                   WHEN n >= med THEN 'Heavy' ELSE 'Light' END AS tier
                   FROM placed_users),
        sums AS (SELECT lm, tier, count(*) AS c FROM tiered GROUP BY ALL),
        shares AS (SELECT *, sum(c) OVER (PARTITION BY lm) AS total FROM sums)
        SELECT lm AS event_month, tier, c AS user_count, {pct('c', 'total')} AS pct_of_users
        FROM shares
    """,
    "power_users": f"""
        WITH {labelled('breadth')},
        u AS (SELECT user_id, count(*) AS n, count(DISTINCT ld) AS days,
                     count(DISTINCT feature) AS areas
              FROM lab WHERE ts >= {START} AND {_HOME} AND name IS NOT NULL GROUP BY user_id),
        scored AS (
            SELECT *, 40e0 * days / nullif(max(days) OVER (), 0)
                    + 30e0 * areas / nullif(max(areas) OVER (), 0)
                    + 30e0 * ln(1 + n) / nullif(max(ln(1 + n)) OVER (), 0) AS score
            FROM u)
        SELECT s.user_id, x.email, x.username, max(x.role) AS role, max(x.job_role) AS job_role,
               s.n AS total_events, s.days AS active_days, s.areas AS feature_breadth,
               floor(s.score * 10e0 + 0.5e0) / 10e0 AS power_score
        FROM scored s LEFT JOIN snap x ON x.id = s.user_id
        GROUP BY s.user_id, x.email, x.username, s.n, s.days, s.areas, s.score
        ORDER BY power_score DESC NULLS FIRST, s.user_id, x.email NULLS LAST,
                 x.username NULLS LAST
        LIMIT 25
    """,
    "daily_engagement_matrix": f"""
        WITH {_MY_SESSIONS},
        daily AS (SELECT a.user_id, a.ld, count(*) AS n FROM act a
                  WHERE a.ts >= {START} AND {_HOME} GROUP BY ALL),
        seen AS (SELECT DISTINCT user_id, (ts + INTERVAL 330 MINUTE)::DATE AS ld FROM numbered),
        banded AS (
            SELECT d.ld, d.user_id, s.user_id AS in_session,
                   CASE WHEN n >= 20 THEN '20+' WHEN n >= 10 THEN '10-19' WHEN n >= 5 THEN '5-9'
                        ELSE '1-4' END || ' events' AS bucket
            FROM daily d LEFT JOIN seen s USING (user_id, ld))
        SELECT ld AS event_date, bucket, count(DISTINCT user_id) AS user_count,
               count(DISTINCT in_session) AS user_count_active_audience
        FROM banded GROUP BY ALL
    """,
    "avg_pageviews_per_user_daily": f"""
        WITH d AS (SELECT ld, count(DISTINCT user_id) AS u, count(*) AS n FROM act
                   WHERE src = 'page' AND ts >= {START} AND own = {DOMAIN} GROUP BY ld)
        SELECT ld AS event_date, u AS active_users, n AS total_pageviews,
               {ratio('n', 'u', 2)} AS avg_pageviews_per_user
        FROM d
    """,
}
