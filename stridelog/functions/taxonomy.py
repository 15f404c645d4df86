"""Feature areas: ordered rules that map page and event names to a label."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import like_prefix


@dataclass(frozen=True)
class Rule:
    label: str
    names: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()

    def matches(self, col: Column) -> Column:
        tests = [like_prefix(col, pattern) for pattern in self.patterns]
        if self.names:
            tests.append(col.isin(*self.names))
        return reduce(or_, tests)


@dataclass(frozen=True)
class Taxonomy:
    pages: tuple[Rule, ...]
    events: tuple[Rule, ...] = ()

    def page_label(self, name: Column, codes: dict[str, int] | None = None) -> Column:
        return classify(name, self.pages, codes)

    def event_label(self, event: Column, codes: dict[str, int] | None = None) -> Column:
        return classify(event, self.events, codes)

    def bits(self) -> dict[str, int]:
        """A bit of its own for every label."""
        labels = dict.fromkeys(rule.label for rule in (*self.pages, *self.events))
        return {label: 1 << i for i, label in enumerate(labels)}


def classify(
    col: Column, rules: tuple[Rule, ...], codes: dict[str, int] | None = None
) -> Column:
    """Label of the first matching rule, or the label's code; NULL if none matches."""
    result = F
    for rule in rules:
        value = rule.label if codes is None else codes[rule.label]
        result = result.when(rule.matches(col), value)
    return result


# --- Fixed values: names, patterns and labels must stay exactly as they are. ---------------
# The five sets differ on purpose; each belongs to the reports named above it.

# Monthly feature matrix.
MATRIX = Taxonomy(
    pages=(
        Rule("Discovery", names=("discovery",)),
        Rule("Chrome Extension", names=("reverse-metadata-sidebar",)),
        Rule("Insights/SQL", names=("saved_query", "insights")),
        Rule(
            "Governance",
            names=("glossary", "term", "category", "classifications", "custom_metadata"),
        ),
        Rule("Asset Profile", names=("asset_profile", "overview")),
        Rule(
            "Admin",
            names=(
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
        Rule("Workflows", names=("workflows-home", "workflows-profile", "runs", "playbook")),
        Rule("Data Quality", names=("monitor",)),
        Rule("Home", names=("home",)),
        Rule("Marketplace", names=("marketplace",)),
        Rule("Notifications", names=("inbox",)),
        Rule("Usage Analytics", names=("usage",)),
    ),
    events=(
        Rule("Discovery", patterns=("discovery_%",)),
        Rule("Chrome Extension", patterns=("chrome_%",)),
        Rule("Insights/SQL", patterns=("insights_%",)),
        Rule("Governance", patterns=("governance_%", "gtc_tree_%")),
        Rule("AI Copilot", patterns=("atlan_ai_%",)),
        Rule("Lineage", patterns=("lineage_%",)),
        Rule("Data Products", patterns=("products_home_%",)),
    ),
)

# Reach/depth quadrant.
QUADRANT = Taxonomy(
    pages=(
        Rule("Discovery/Search", names=("discovery",)),
        Rule("Chrome Extension", names=("reverse-metadata-sidebar",)),
        Rule("Insights/SQL", names=("saved_query", "insights")),
        Rule(
            "Governance",
            names=("glossary", "term", "category", "classifications", "custom_metadata"),
        ),
        Rule("Asset Profile", names=("asset_profile", "overview")),
        Rule("Data Quality", names=("monitor",)),
        Rule("Workflows", names=("workflows-home", "workflows-profile", "runs", "playbook")),
        Rule("Home", names=("home",)),
    ),
    events=(
        Rule("Discovery/Search", patterns=("discovery_search%",)),
        Rule("Chrome Extension", patterns=("chrome_%",)),
        Rule("Insights/SQL", patterns=("insights_%",)),
        Rule("Governance", patterns=("governance_%", "gtc_tree_%")),
        Rule("AI Copilot", patterns=("atlan_ai_%",)),
        Rule("Lineage", patterns=("lineage_%",)),
        Rule("Metadata Curation", patterns=("discovery_metadata_%",)),
        Rule("Navigation", names=("main_navigation_button_clicked",)),
    ),
)

# Weekly feature trend.
TREND = Taxonomy(
    pages=(
        Rule("Discovery", names=("discovery",)),
        Rule("Chrome Extension", names=("reverse-metadata-sidebar",)),
        Rule("Insights/SQL", names=("saved_query", "insights")),
        Rule(
            "Governance",
            names=("glossary", "term", "category", "classifications", "custom_metadata"),
        ),
        Rule("Asset Profile", names=("asset_profile", "overview")),
        Rule("Data Quality", names=("monitor",)),
        Rule("Home", names=("home",)),
    ),
    events=(
        Rule("Discovery", patterns=("discovery_%",)),
        Rule("Chrome Extension", patterns=("chrome_%",)),
        Rule("Insights/SQL", patterns=("insights_%",)),
        Rule("Governance", patterns=("governance_%", "gtc_tree_%")),
        Rule("AI Copilot", patterns=("atlan_ai_%",)),
        Rule("Lineage", patterns=("lineage_%",)),
    ),
)

# Power users.
BREADTH = Taxonomy(
    pages=(
        Rule("Discovery", names=("discovery",)),
        Rule("Insights", names=("saved_query", "insights")),
        Rule("Governance", names=("glossary", "term", "category")),
        Rule("Asset Profile", names=("asset_profile", "overview")),
        Rule("Chrome Extension", names=("reverse-metadata-sidebar",)),
        Rule("Data Quality", names=("monitor",)),
    ),
    events=(
        Rule("Discovery", patterns=("discovery_%",)),
        Rule("Insights", patterns=("insights_%",)),
        Rule("Governance", patterns=("governance_%",)),
        Rule("AI Copilot", patterns=("atlan_ai_%",)),
        Rule("Lineage", patterns=("lineage_%",)),
        Rule("Chrome Extension", patterns=("chrome_%",)),
    ),
)

# Customer health and comparison: pages only, six labels.
HEALTH = Taxonomy(pages=BREADTH.pages)

# Actions that count as governance work in the funnel.
GOVERNANCE_ACTIONS = Rule(
    "Governance action", patterns=("governance_%", "gtc_tree_create_%", "asset_update_%")
)

# Return signal of the search retention report.
SEARCH_EVENTS = ("discovery_search_results", "atlan_ai_conversation_prompt_submitted")
# --- End of fixed values. ------------------------------------------------------------------
