"""Inputs derived from the generated tables, and snippets shared by the statements."""

from __future__ import annotations

# Parameters of the registered queries.
START = "TIMESTAMP '2024-01-01 00:00:00'"
END = "TIMESTAMP '2024-05-01 00:00:00'"
NOW = "TIMESTAMP '2024-04-30 12:00:00'"
TODAY = "DATE '2024-04-30'"
THIS_MONTH = "DATE '2024-04-01'"
LAST_MONTH = "DATE '2024-03-01'"
DOMAIN = "'household.example.com'"
DAYS = 14

# Event names that carry no user intent.
NOISE = """
    'atlan_analaytics_aggregateinfo_fetch', 'api_error_emit', 'api_evaluator_cancelled',
    'api_evaluator_succeeded', 'Experiment Started', '$experiment_started',
    'web_vital_metric_inp_track', 'web_vital_metric_ttfb_track',
    'performance_metric_user_timing_discovery_search',
    'performance_metric_user_timing_app_bootstrap', 'web_vital_metric_fcp_track',
    'web_vital_metric_lcp_track'
"""

_INPUTS = f"""
seeds AS (
    SELECT e.event_id, e.user_id AS uk, e.user_id::VARCHAR AS user_id, e.event_type,
           c.c_mktsegment AS seg, json_extract(e.props, '$.k')::INT AS k,
           epoch_us(e.ts) // 86400000000 AS dn, epoch_us(e.ts) % 86400000000 AS us,
           (e.user_id + day(e.ts)) % 4 AS slot
    FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
),
moved AS (
    SELECT *, least(CASE uk % 5 WHEN 0 THEN CASE WHEN slot < 2 THEN 0 ELSE 3 END
                                WHEN 1 THEN slot % 3 WHEN 2 THEN 0
                                WHEN 3 THEN 1 + slot % 3 ELSE slot END,
                    CASE WHEN seg = 'FURNITURE' AND uk % 2 = 0 THEN 2 ELSE 9 END) AS shift
    FROM seeds
),
placed AS (
    SELECT *, seg = 'MACHINERY' AND shift = 3 AS packed,
           CASE WHEN seg = 'MACHINERY' AND shift = 3 THEN 19736
                WHEN uk % 7 = 0 THEN 19723 + (dn - 19723) // 5 * 5 ELSE dn END AS d
    FROM moved
),
timed AS (
    SELECT *, make_timestamp((((d + 30 * shift) * 86400
           + CASE WHEN packed THEN 36000 ELSE 63000 END) * 1000000 + us // 12)::BIGINT) AS ts,
           CASE WHEN k % 10 = 0 THEN 'a' || event_id END AS amplitude
    FROM placed
),
pv AS (
    SELECT user_id, ts,
           CASE WHEN k % 25 = 24 OR uk % 50 = 49 THEN NULL WHEN k = 0 THEN {DOMAIN}
                ELSE lower(seg) || '.example.com' END AS domain,
           (['discovery', 'home', 'asset_profile', 'overview', 'glossary', 'term', 'saved_query',
             'insights', 'monitor', 'reverse-metadata-sidebar', 'users', 'workflows-home',
             'marketplace', 'inbox', 'unmapped_page', NULL])[k % 16 + 1] AS name,
           ([NULL, 'overview', 'columns'])[k % 3 + 1] AS tab,
           ([NULL, 'warehouse', 'bi', 'transform'])[k % 4 + 1] AS connector,
           CASE WHEN k % 2 = 0 THEN 'Table' ELSE 'Column' END AS asset_type,
           'g' || (event_id % 50) AS asset,
           CASE WHEN k % 20 = 0 THEN 'u' || user_id || '@mail.example' END AS email,
           CASE WHEN k % 30 = 0 THEN 's' || event_id END AS session_uuid, amplitude
    FROM timed WHERE event_type IN ('view', 'purchase')
),
tr AS (
    SELECT user_id, ts,
           CASE WHEN event_type = 'error'
                THEN (['api_error_emit', 'workflow_run_finished', 'web_vital_metric_lcp_track',
                       NULL])[k % 4 + 1]
                ELSE (['discovery_search_results', 'atlan_ai_conversation_prompt_submitted',
                       'insights_query_run', 'governance_term_updated', 'gtc_tree_create_term',
                       'lineage_expanded', 'chrome_reverse_opened', 'discovery_metadata_edit',
                       'main_navigation_button_clicked', 'products_home_opened'])[k % 10 + 1]
           END AS name,
           amplitude
    FROM timed WHERE event_type NOT IN ('view', 'purchase')
),
snap AS (
    SELECT CASE WHEN c_custkey % 3 = 0 THEN 'anon-' ELSE '' END || c_custkey AS id,
           CASE c_custkey % 10 WHEN 9 THEN NULL
                WHEN 5 THEN 'u' || c_custkey || '.' || n || '@mail.example'
                ELSE 'u' || c_custkey || '@mail.example' END AS email,
           'user' || c_custkey AS username, lower(c_mktsegment) || '.example.com' AS domain,
           (['admin', 'member', 'guest', NULL])[c_nationkey % 4 + 1] AS role,
           CASE WHEN c_custkey % 3 = 1 THEN 'full' ELSE 'viewer' END AS license_type,
           (['engineer', 'analyst', 'steward', NULL])[c_custkey % 4 + 1] AS job_role,
           CASE WHEN n = 1 THEN 'default' END AS personas, 'standard' AS plan,
           'acct' || c_nationkey AS account,
           CASE WHEN c_custkey % 5 <> 0 THEN 's' || c_custkey || '-' || n END AS session_uuid,
           TIMESTAMP '2024-01-01' + to_days((n + CASE WHEN c_mktsegment = 'FURNITURE'
               THEN c_custkey % 20 ELSE 7 * c_custkey % 118 END)::INT) AS created_at,
           TIMESTAMP '2023-01-01' AS tenant_created_at,
           TIMESTAMP '2024-04-01' + to_days((c_custkey % 28 + n)::INT) AS received_at
    FROM customer, range(0, 2) AS r(n) WHERE n <= c_custkey % 2
),
home AS (SELECT user_id, max(domain) AS domain FROM pv WHERE domain IS NOT NULL GROUP BY 1),
kept AS (SELECT * FROM tr WHERE name NOT IN ({NOISE}) AND name NOT LIKE 'workflow_%'),
-- Page views and kept events with both candidate domains and local calendar values.
act AS (
    SELECT u.*, lts::DATE AS ld, date_trunc('week', lts)::DATE AS lw,
           date_trunc('month', lts)::DATE AS lm
    FROM (
        SELECT 'page' AS src, p.user_id, p.ts, p.name, p.domain AS own, h.domain AS home,
               p.ts + INTERVAL 330 MINUTE AS lts
        FROM pv p LEFT JOIN home h USING (user_id)
        UNION ALL
        SELECT 'track', k.user_id, k.ts, k.name, h.domain, h.domain,
               k.ts + INTERVAL 330 MINUTE
        FROM kept k LEFT JOIN home h USING (user_id)
    ) u
),
one AS (
    SELECT id, max(email) AS email, max(username) AS username, max(role) AS role,
           max(job_role) AS job_role, max(license_type) AS license_type,
           min(created_at) AS created_at
    FROM snap GROUP BY id
)
"""


def with_inputs(body: str, workflows: bool = False, minutes: int = 330) -> str:
    """A full statement: inputs, then the body, which may open with its own CTEs.

    ``workflows`` lets workflow events count; ``minutes`` is the offset of local time from UTC.
    """
    inputs = _INPUTS.replace("INTERVAL 330 MINUTE", f"to_minutes({minutes})")
    if workflows:
        inputs = inputs.replace("AND name NOT LIKE 'workflow_%'", "")
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {inputs},\n{body[5:]}"
    return f"WITH {inputs}\n{body}"


def half_up(num: str, den: str) -> str:
    """num / den to the nearest integer, halves away from zero, NULL for a zero den."""
    d = f"NULLIF(({den})::HUGEINT, 0)"
    return f"(sign({num}) * ((2 * abs(({num})::HUGEINT) + {d}) // (2 * {d})))"


def ratio(num: str, den: str, scale: int, factor: int = 1, division: int | None = None) -> str:
    """factor * num / den at ``scale`` places, first kept at ``division`` places if given."""
    places = scale if division is None else division
    value = half_up(f"({num})::HUGEINT * {factor * 10**places}", den)
    if division is not None:
        value = half_up(value, str(10 ** (division - scale)))
    return f"({value})::BIGINT / 1e{scale}"


def pct(num: str, den: str) -> str:
    return ratio(num, den, 1, 100, 7)


def mean(total: str, n: str) -> str:
    return ratio(total, n, 1, 1, 6)
