"""Feature areas as ordered rules (label, names or patterns), restated here."""

from __future__ import annotations

# --- Fixed values: names, patterns and labels, in the order in which rules apply. ----------
PAGES = {
    "matrix": (
        ("Discovery", ("discovery",)),
        ("Chrome Extension", ("reverse-metadata-sidebar",)),
        ("Insights/SQL", ("saved_query", "insights")),
        ("Governance", ("glossary", "term", "category", "classifications", "custom_metadata")),
        ("Asset Profile", ("asset_profile", "overview")),
        (
            "Admin",
            (
                "users",
                "personas",
                "config",
                "sso",
                "api-access",
                "api_keys",
                "policyManager",
                "manage",
            ),
        ),
        ("Workflows", ("workflows-home", "workflows-profile", "runs", "playbook")),
        ("Data Quality", ("monitor",)),
        ("Home", ("home",)),
        ("Marketplace", ("marketplace",)),
        ("Notifications", ("inbox",)),
        ("Usage Analytics", ("usage",)),
    ),
    "quadrant": (
        ("Discovery/Search", ("discovery",)),
        ("Chrome Extension", ("reverse-metadata-sidebar",)),
        ("Insights/SQL", ("saved_query", "insights")),
        ("Governance", ("glossary", "term", "category", "classifications", "custom_metadata")),
        ("Asset Profile", ("asset_profile", "overview")),
        ("Data Quality", ("monitor",)),
        ("Workflows", ("workflows-home", "workflows-profile", "runs", "playbook")),
        ("Home", ("home",)),
    ),
    "trend": (
        ("Discovery", ("discovery",)),
        ("Chrome Extension", ("reverse-metadata-sidebar",)),
        ("Insights/SQL", ("saved_query", "insights")),
        ("Governance", ("glossary", "term", "category", "classifications", "custom_metadata")),
        ("Asset Profile", ("asset_profile", "overview")),
        ("Data Quality", ("monitor",)),
        ("Home", ("home",)),
    ),
    "breadth": (
        ("Discovery", ("discovery",)),
        ("Insights", ("saved_query", "insights")),
        ("Governance", ("glossary", "term", "category")),
        ("Asset Profile", ("asset_profile", "overview")),
        ("Chrome Extension", ("reverse-metadata-sidebar",)),
        ("Data Quality", ("monitor",)),
    ),
}

EVENTS = {
    "matrix": (
        ("Discovery", ("discovery_%",)),
        ("Chrome Extension", ("chrome_%",)),
        ("Insights/SQL", ("insights_%",)),
        ("Governance", ("governance_%", "gtc_tree_%")),
        ("AI Copilot", ("atlan_ai_%",)),
        ("Lineage", ("lineage_%",)),
        ("Data Products", ("products_home_%",)),
    ),
    "quadrant": (
        ("Discovery/Search", ("discovery_search%",)),
        ("Chrome Extension", ("chrome_%",)),
        ("Insights/SQL", ("insights_%",)),
        ("Governance", ("governance_%", "gtc_tree_%")),
        ("AI Copilot", ("atlan_ai_%",)),
        ("Lineage", ("lineage_%",)),
        ("Metadata Curation", ("discovery_metadata_%",)),
        ("Navigation", ("main_navigation_button_clicked",)),
    ),
    "trend": (
        ("Discovery", ("discovery_%",)),
        ("Chrome Extension", ("chrome_%",)),
        ("Insights/SQL", ("insights_%",)),
        ("Governance", ("governance_%", "gtc_tree_%")),
        ("AI Copilot", ("atlan_ai_%",)),
        ("Lineage", ("lineage_%",)),
    ),
    "breadth": (
        ("Discovery", ("discovery_%",)),
        ("Insights", ("insights_%",)),
        ("Governance", ("governance_%",)),
        ("AI Copilot", ("atlan_ai_%",)),
        ("Lineage", ("lineage_%",)),
        ("Chrome Extension", ("chrome_%",)),
    ),
}
# --- End of fixed values. ------------------------------------------------------------------


def _first_match(source: str, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> list[str]:
    """CASE branches: the first rule one of whose names or patterns fits decides."""
    return [
        f"WHEN src = '{source}' AND ("
        + " OR ".join(f"name LIKE '{n}'" if n.endswith("%") else f"name = '{n}'" for n in names)
        + f") THEN '{label}'"
        for label, names in rules
    ]


def labelled(kind: str) -> str:
    """CTE ``lab``: activity with its ``feature``, NULL if no rule fits."""
    branches = " ".join(_first_match("page", PAGES[kind]) + _first_match("track", EVENTS[kind]))
    return f"lab AS (SELECT *, CASE {branches} END AS feature FROM act)"
