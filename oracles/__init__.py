"""DuckDB SQL with the results the registered queries must have.

The statements take the literal route where the Spark code takes a shorter one: sessions from
a lag over single events, day-N retention on the full grid, tiers from ``percent_rank`` over
all users. They share no code with the package.
"""

from __future__ import annotations

from . import accounts, behaviour, catalog, returning, usage
from .base import with_inputs


#: Registered variants of a report whose statement differs in inputs only.
_WORKFLOWS = ("top_events_by_domain", "mau_by_domain", "derived_sessions")
_MAINTAINED = ("mau_by_domain", "customer_health_scorecard")
#: Reports over events by day.
_DAYS = ("mau_by_domain", "session_duration", "churned_users", "model_tracks_of_march")
#: Reports from the stored state; the statements know no state.
_STORED = (
    "user_domains",
    "derived_sessions",
    "customer_health_scorecard",
    "multi_customer_comparison",
) + tuple(
    f"{name}{suffix}"
    for name in ("dau_by_domain", "wau_by_domain", "mau_by_domain", "mau_dau_ratio")
    for suffix in ("", "_all")
)


def all_sql() -> dict[str, str]:
    parts = (catalog.SQL, usage.SQL, behaviour.SQL, returning.SQL, accounts.SQL)
    bodies = {name: body for part in parts for name, body in part.items()}
    return {
        **{name: with_inputs(body) for name, body in bodies.items()},
        **{f"{name}_workflows": with_inputs(bodies[name], workflows=True) for name in _WORKFLOWS},
        **{f"{name}_maintained": with_inputs(bodies[name]) for name in _MAINTAINED},
        **{_stored_name(name): with_inputs(bodies[name]) for name in _STORED},
        **{f"{name}_days": with_inputs(bodies[name]) for name in _DAYS},
        "mau_by_domain_stored_workflows": with_inputs(bodies["mau_by_domain"], workflows=True),
        "mau_by_domain_panama": with_inputs(bodies["mau_by_domain"], minutes=-300),
    }


def _stored_name(name: str) -> str:
    return name[:-4] + "_stored_all" if name.endswith("_all") else f"{name}_stored"
