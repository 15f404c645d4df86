"""Registered queries: SQL counterparts, invariants, shape of the plans."""

import re
from dataclasses import replace
from datetime import timedelta

import duckdb
import pytest

import __spark_entry__ as registry
from stridelog.plans.catalog import REPORTS
from stridelog.sources.fixtures import fixture

from .conftest import SF_DIR, dicts

# Queries on training text, if they are there, have tests of their own.
OWN = lambda name: not re.match(r"op\d+_|pipeline$", name)
QUERIES = {n: q for n, q in registry.queries().items() if OWN(n)}
SQL = {n: q for n, q in registry.oracle_sql().items() if OWN(n)}
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}
TABLES = "customer events"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')"
        )
    yield connection
    connection.close()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(REPORTS) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(SQL[name])
    columns = sorted(df.columns)
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    expected = [dict(zip([d[0] for d in result.description], r)) for r in result.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in dicts(df)), key=key)
    assert got
    assert got == sorted((tuple(r[c] for c in columns) for r in expected), key=key)


@pytest.fixture(scope="module")
def result(spark):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = dicts(QUERIES[name](spark, SF_DIR))
        return cache[name]

    return get


def test_a_day_has_no_more_users_than_its_week_and_month(result):
    weeks = {r["event_week"]: r["wau"] for r in result("wau_by_domain")}
    months = {r["event_month"]: r["mau"] for r in result("mau_by_domain")}
    for row in result("dau_by_domain"):
        day = row["event_date"]
        assert row["dau"] <= weeks[day - timedelta(days=day.weekday())]
        assert row["dau"] <= months[day.replace(day=1)]


def test_session_events_add_up(result):
    assert sum(r["event_count"] for r in result("derived_sessions")) == len(
        result("activity_events")
    )


def test_tiers_cover_everyone(result):
    months = {r["event_month"] for r in result("engagement_tiers")}
    for month in months:
        part = [r for r in result("engagement_tiers") if r["event_month"] == month]
        assert abs(sum(r["pct_of_users"] for r in part) - 100) < 0.3
    assert len({sum(r["user_count"] for r in result("engagement_tiers") if r["event_month"] == m)
                for m in months}) == 1


def test_retention_is_a_share(result):
    for name in ("pageview", "search", "session"):
        cells = result(f"daily_retention_session_to_{name}")
        assert all(0 <= r["retention_pct"] <= 100 for r in cells)
    first = [r for r in result("daily_retention_session_to_session") if r["day_n"] == 0]
    assert first and all(r["retention_pct"] == 100 for r in first)


def test_funnel_narrows_and_splits(result):
    steps = sorted(result("funnel_session_to_pageview"), key=lambda r: r["step_order"])
    totals = [r["total_users"] for r in steps]
    assert totals == sorted(totals, reverse=True)
    for step in steps[1:]:
        assert step["with_governance"] + step["without_governance"] == step["total_users"]


def _plan(spark, name, broadcast=False):
    """Physical plan without adaptive execution, by default as if no side were small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if broadcast else "-1")
    tables = fixture(spark, SF_DIR)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        params = registry.PARAMS
        return REPORTS[name](tables, params)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", REPORTS)
def test_plans_scale(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    assert "Python" not in plan
    # Cross joins only with the one-row aggregates of these reports.
    nested = plan.count("BroadcastNestedLoopJoin")
    one_row = ("engagement_tiers", "power_users", "profile_tracks", "profile_pages")
    assert nested <= (2 if name in one_row else 0)
    # A single partition only ever receives the partial results of a global aggregate.
    for before in re.findall(r"Exchange SinglePartition.*\n(.*)", plan):
        assert "partial_" in before or "HashAggregate(keys=[]" in before
    # Each input is read once, the lookup aside, and never with every column.
    assert plan.count("FileScan") <= (5 if name in ("qbr_deck_data", "engagement_tiers") else 4)
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan):
        assert schema.count(":") <= 12


@pytest.mark.parametrize("name", ["mau_by_domain", "session_duration", "churned_users"])
def test_filters_reach_the_scan(spark, name):
    plan = _plan(spark, name)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(timestamp", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(domain,household", plan)


def test_no_row_is_sorted_before_it_is_collapsed(spark):
    """Below each sort-based aggregate lies a hash aggregate over the same rows."""
    plan = _plan(spark, "user_roster_by_domain")
    partial = plan.split("SortAggregate(")[-1]
    assert "HashAggregate(" in partial.split("FileScan")[0]


@pytest.mark.parametrize("name", ["discover_pages", "profile_tracks", "profile_pages"])
def test_distinct_counts_repeat_no_row(spark, name):
    plan = _plan(spark, name)
    assert "Expand" not in plan and plan.count("FileScan") == 1


def test_only_new_users_are_rolled_up(spark):
    """The funnel's filter by key lies below the roll-up of events, and is of fixed size."""
    plan = _plan(spark, "activation_funnel")
    (above, below) = plan.split("partial_min(ts")
    assert "BroadcastHashJoin [__word" in below and "BroadcastHashJoin" not in above
    assert "bit_or(" in below.split("BroadcastExchange")[1]


def test_retention_work_does_not_grow_with_its_days(spark):
    """No counter per day: the plan is the same for two weeks and for a year."""
    size = {}
    for days in (14, 365):
        p = replace(registry.PARAMS, retention_days=days)
        report = REPORTS["daily_retention_session_to_pageview"](fixture(spark, SF_DIR), p)
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        size[days] = len(re.sub(r"#\d+|\d+", "", plan))
    assert abs(size[14] - size[365]) < 50
