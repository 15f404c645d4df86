"""Hand-made cases per report; expected rows follow from the definitions, not from a run."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from fractions import Fraction
from statistics import median

import pytest

from stridelog.plans import active, adoption, engagement, health, profile, retention, review
from stridelog.plans.catalog import ALL_CUSTOMERS, REPORTS

from .conftest import dicts, page, params, rows, track, ts, user

A, B = "a.example", "b.example"


def local(moment: datetime) -> date:
    return (moment + timedelta(minutes=330)).date()


# --- all reports ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", REPORTS)
def test_no_input_gives_no_rows_or_zeros(make, name):
    got = dicts(REPORTS[name](make(), params()))
    if name == "funnel_session_to_pageview":
        assert [(r["step_order"], r["total_users"]) for r in got] == [(1, 0), (2, 0), (3, 0)]
        assert all(r["conversion_from_step1_pct"] is None for r in got)
    elif name in ("profile_tracks", "profile_pages", "profile_users", "profile_overlap"):
        assert len(got) == 1
        assert all(v in (0, None, "TRACKS", "PAGES", "USERS") for v in got[0].values())
    else:
        assert got == []


@pytest.mark.parametrize(
    "name",
    sorted(
        set(REPORTS)
        - set(ALL_CUSTOMERS)
        - {n for n in REPORTS if n.startswith(("profile_", "discover_"))}
        - {
            "customer_health_scorecard",
            "domain_summary_snapshot",
            "multi_customer_comparison",
            "trending_alert",
        }
    ),
)
def test_single_customer_reports_need_a_domain(make, name):
    with pytest.raises(ValueError):
        REPORTS[name](make(), params(domain=None))


# --- profile -------------------------------------------------------------------------------


def test_profiles_keep_noise_and_count_filled_columns(make):
    t = make(
        pages=[page("u", "2024-01-01", email="e"), page("u", "2024-01-03", None, None)],
        tracks=[track("u", "2024-01-01", "api_error_emit"), track("v", "2024-01-01", None)],
        users=[user("u"), user("u", None), user("w")],
    )
    (pages,) = dicts(profile.profile_pages(t, params()))
    assert (pages["total_rows"], pages["days_with_data"], pages["has_domain"]) == (2, 2, 1)
    assert (pages["has_email"], pages["distinct_page_names"]) == (1, 1)
    (tracks,) = dicts(profile.profile_tracks(t, params()))
    assert (tracks["total_rows"], tracks["distinct_event_types"]) == (2, 1)
    (users,) = dicts(profile.profile_users(t, params()))
    assert (users["total_rows"], users["distinct_users"], users["has_email"]) == (3, 2, 2)
    assert rows(profile.profile_overlap(t, params())) == [(1, 1, 0)]


def test_discover_uses_utc_days_and_three_months(make):
    t = make(
        pages=[
            page("u", "2024-01-30 11:59:59"),  # one second too old
            page("u", "2024-01-30 12:00:00"),
            page("v", "2024-02-01 23:00:00"),
        ],
        tracks=[
            track("u", "2024-02-03 20:00", "Search_Done"),
            track("v", "2024-02-04 20:00", "Search_Done"),
            track("nobody", "2024-02-04 20:00", "Search_Done"),
            track("u", "2024-02-04 20:00", "other"),
        ],
    )
    assert rows(profile.discover_domains(t, params())) == [
        (A, 2, 2, date(2024, 1, 30), date(2024, 2, 1))
    ]
    found = profile.discover_events(t, params(), term="search")
    assert rows(found) == [("Search_Done", 2, 2, 1, date(2024, 2, 3), date(2024, 2, 4))]
    assert rows(profile.discover_events(t, params(), domain=B)) == []


def test_role_sessions_put_missing_days_first(make):
    t = make(
        users=[
            user("u", received_at=None, session_uuid="s", role="r"),
            *[
                user(f"u{d}", received_at=ts(f"2024-01-{d:02}"), session_uuid=f"s{d}", role="r")
                for d in range(1, 32)
            ],
            user("x", received_at=ts("2024-02-01"), session_uuid=None),
        ]
    )
    days = [r[0] for r in rows(profile.profile_role_sessions(t, params()))]
    assert days == [None] + [date(2024, 1, d) for d in range(31, 2, -1)]


# --- active users --------------------------------------------------------------------------


@pytest.fixture
def two_domains(make):
    """u1 views in A and B (attributed to B), u2 has no domain, one view has no user."""
    return make(
        pages=[
            page("u1", "2024-02-01 08:00", A),
            page("u1", "2024-02-01 09:00", B),
            page("u2", "2024-02-01 08:00", None),
            page("u4", "2024-02-01 08:00", B),
            page(None, "2024-02-01 08:00", A),
        ],
        tracks=[track(u, "2024-02-02 08:00") for u in ("u1", "u2", "u3", "u4")],
    )


def test_page_views_count_for_their_own_domain(two_domains):
    first, second = date(2024, 2, 1), date(2024, 2, 2)
    assert rows(active.dau_by_domain(two_domains, params())) == [(A, first, 1)]
    assert rows(active.dau_by_domain(two_domains, params(domain=B))) == [
        (B, second, 2), (B, first, 2)
    ]
    assert rows(active.dau_by_domain(two_domains, params(domain=None))) == [
        (None, first, 1), (A, first, 1), (B, second, 2), (B, first, 2)
    ]
    assert rows(active.wau_by_domain(two_domains, params(domain=B))) == [(B, date(2024, 1, 29), 2)]


def test_mau_compares_with_the_previous_present_month(make):
    t = make(
        pages=[page(f"u{i}", "2024-01-15") for i in range(8)]
        + [page(f"u{i}", "2024-03-15") for i in range(5)]
    )
    assert rows(active.mau_by_domain(t, params())) == [
        (A, date(2024, 3, 1), 5, 8, -3, -37.5),
        (A, date(2024, 1, 1), 8, None, None, None),
    ]


@pytest.mark.parametrize(
    "groups, expected",
    [
        (["012", "345", "678", "901"], (10, 3.0, 0.3, "Strong")),
        (list("0123456789"), (10, 1.0, 0.1, "Moderate")),
        (list("0123456789x"), (11, 1.0, 0.091, "Episodic")),
    ],
)
def test_stickiness_levels_use_the_exact_ratio(make, groups, expected):
    views = [page(u, f"2024-02-{d:02}") for d, users in enumerate(groups, 1) for u in users]
    (got,) = rows(active.mau_dau_ratio(make(pages=views), params()))
    assert got == (A, date(2024, 2, 1), *expected)


def test_roster_status_and_identities(make):
    t = make(
        pages=[
            page("active", "2024-03-31 06:30"),  # local 12:00, exactly 30 days
            page("idle", "2024-03-31 06:29"),
            page("gone", "2024-01-31 06:29"),  # one minute over 90 days
        ],
        users=[user("active", "1@mail"), user("active", "2@mail"), user("idle", None)],
    )
    got = dicts(active.user_roster_by_domain(t, params()))
    assert [(r["user_id"], r["email"], r["status"]) for r in got] == [
        ("active", "1@mail", "Active"),
        ("active", "2@mail", "Active"),
        ("gone", None, "Churned"),
        ("idle", None, "Inactive"),
    ]
    assert [r["days_since_last_activity"] for r in got] == [30, 30, 90, 30]


# --- adoption ------------------------------------------------------------------------------


def test_top_pages_break_ties_by_name_and_keep_missing_tabs(make):
    t = make(pages=[page("u", "2024-02-01", name=f"p{i:02}") for i in range(60)])
    got = rows(adoption.top_pages_by_domain(t, params()))
    assert [r[1] for r in got] == [f"p{i:02}" for i in range(50)]
    assert got[0] == (A, "p00", None, 1, 1, 1.0)


def test_connector_usage(make):
    views = [("u", "g1"), ("u", "g1"), ("v", "g1"), ("v", None)]
    t = make(
        pages=[
            page(u, "2024-02-01", connector_name="c", type_name="T", asset_guid=g)
            for u, g in views
        ]
    )
    assert rows(adoption.connector_usage(t, params())) == [(A, "c", "T", 4, 2, 1)]


def test_matrix_keeps_users_without_flags_and_fans_out(make):
    t = make(
        pages=[
            page("home_only", "2024-02-01", name="home"),
            page("other_only", "2024-02-01", name="unmapped"),
            page("both", "2024-02-01", name="glossary"),
        ],
        tracks=[track("both", "2024-02-02", "lineage_x")],
        users=[user("both", "1@mail"), user("both", "2@mail")],
    )
    got = dicts(adoption.feature_adoption_matrix(t, params()))
    flags = [sorted(k for k, v in r.items() if k.startswith("used_") and v) for r in got]
    assert [(r["user_id"], r["email"], f) for r, f in zip(got, flags)] == [
        ("both", "1@mail", ["used_governance", "used_lineage"]),
        ("both", "2@mail", ["used_governance", "used_lineage"]),
        ("home_only", None, []),
    ]


def test_quadrant_median_and_average(make):
    counts = {"u1": 1, "u2": 2, "u3": 3, "u4": 5}
    t = make(pages=[page(u, "2024-02-01", name="home") for u, n in counts.items() for _ in range(n)])
    assert rows(adoption.feature_engagement_quadrant(t, params())) == [("Home", 4, 11, 2.8, 2.5)]


def test_weekly_trend_counts_users_once(make):
    t = make(
        pages=[page("u", "2024-02-05 08:00", name="discovery")],
        tracks=[track("u", "2024-02-06 08:00", "discovery_x"), track("u", "2024-02-12", "lineage_x")],
    )
    assert rows(adoption.feature_trend_weekly(t, params())) == [
        (date(2024, 2, 12), "Lineage", 1, 1),
        (date(2024, 2, 5), "Discovery", 1, 2),
    ]


# --- engagement ----------------------------------------------------------------------------


def test_session_durations(make):
    def burst(who, start, *seconds):
        begin = ts(start)
        return [page(who, (begin + timedelta(seconds=s)).isoformat()) for s in seconds]

    t = make(
        pages=burst("u", "2024-02-01 08:00:59", 0, 1)  # a minute boundary, one second
        + burst("u", "2024-02-01 10:00:00", 0, 600, 1500)
        + burst("v", "2024-02-01 10:00:00", 0, 30)  # no minute boundary
        + burst("v", "2024-02-02 10:00:00", 0)  # single event
        + burst("v", "2024-02-03 00:00:00", *range(0, 28801, 1800))  # eight hours
    )
    assert rows(engagement.session_duration(t, params())) == [
        (A, date(2024, 2, 1), 2, 1, 13.0, 13.0, 2.5, 25)
    ]
    assert rows(engagement.session_duration_daily(t, params())) == [
        (date(2024, 2, 1), 3, 2, 510.3, 30.0, 2.3, 1500)
    ]
    (month,) = rows(engagement.actions_per_session(t, params()))
    # sizes 2, 3, 2, 1, 17: p90 = 3 + 0.6 * 14
    assert month == (A, date(2024, 2, 1), 5, 5.0, 2.0, 11.4)


def test_sessions_use_the_users_domain(two_domains):
    got = rows(engagement.actions_per_session(two_domains, params(domain=B)))
    assert [r[2] for r in got] == [5]  # u1 twice and u4 on the first day, both on the second
    assert [r[2] for r in rows(engagement.actions_per_session(two_domains, params()))] == []


def _tiers(counts: dict, members: int) -> Counter:
    """Tier sizes of one month, ranking every user."""
    values = sorted(list(counts.values()) + [0] * (members - len(counts)))
    mid = median(v for v in values if v)
    out = Counter()
    for v in values:
        rank = Fraction(sum(x < v for x in values), members - 1) if members > 1 else 0
        tier = "Light" if v < mid else "Heavy"
        tier = "Power" if rank >= Fraction(9, 10) else tier
        out["Dormant" if v == 0 else tier] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tiers_equal_a_ranking_of_all_users(make, seed):
    rng = random.Random(seed)
    members = [None] + [f"u{i:02}" for i in range(30)]
    views = [page(u, "2023-06-01") for u in members]  # attributes everyone, before the start
    counts = defaultdict(Counter)
    for month in (1, 2):
        for u in rng.sample(members[1:], 20):
            counts[month][u] = rng.choice([1, 1, 2, 3, 8])
            views += [page(u, f"2024-0{month}-10")] * counts[month][u]
    got = defaultdict(Counter)
    for month, tier, n, share in rows(engagement.engagement_tiers(make(pages=views), params())):
        got[month.month][tier] = n
        assert share == float(round(Fraction(1000 * n, len(members)) + Fraction(1, 10**9)) / 10)
    assert got == {m: _tiers(c, len(members)) for m, c in counts.items()}


def test_a_lone_user_is_heavy(make):
    t = make(pages=[page("u", "2024-02-01")])
    assert rows(engagement.engagement_tiers(t, params())) == [(date(2024, 2, 1), "Heavy", 1, 100.0)]


def test_power_users_without_features_have_no_score(make):
    t = make(
        pages=[page(f"u{i:02}", "2024-02-01", name="unmapped") for i in range(30)],
        users=[user("u00", f"{n}@mail") for n in range(3)],
    )
    got = dicts(engagement.power_users(t, params()))
    assert [r["user_id"] for r in got] == ["u00"] * 3 + [f"u{i:02}" for i in range(1, 23)]
    assert [r["email"] for r in got[:4]] == ["0@mail", "1@mail", "2@mail", None]
    assert {r["power_score"] for r in got} == {None}


def test_power_score(make):
    t = make(
        pages=[page("best", f"2024-02-0{d}", name="discovery") for d in (1, 2, 3, 4)]
        + [page("next", "2024-02-01", name="monitor"), page("next", "2024-02-01", name=None)],
        tracks=[track("best", "2024-02-01", "lineage_x"), track("next", "2024-02-02", "misc")],
    )
    got = dicts(engagement.power_users(t, params()))
    assert [(r["user_id"], r["total_events"], r["active_days"], r["feature_breadth"]) for r in got] == [
        ("best", 5, 4, 2), ("next", 2, 2, 1)
    ]
    # 40 * 2/4 + 30 * 1/2 + 30 * ln 3 / ln 6 = 20 + 15 + 18.39...
    assert [r["power_score"] for r in got] == [100.0, 53.4]


def test_daily_bands(make):
    sizes = {"u1": 4, "u2": 5, "u3": 9, "u4": 10, "u5": 19, "u6": 20}
    t = make(pages=[page(u, "2024-02-01") for u, n in sizes.items() for _ in range(n)])
    day = date(2024, 2, 1)
    assert rows(engagement.daily_engagement_matrix(t, params())) == [
        (day, "1-4 events", 1, 1),
        (day, "10-19 events", 2, 2),
        (day, "20+ events", 1, 1),
        (day, "5-9 events", 2, 2),
    ]


def test_pageviews_per_user(make):
    t = make(pages=[page(u, "2024-02-01") for u in ("u", "u", "v", "w", None)])
    assert rows(engagement.avg_pageviews_per_user_daily(t, params())) == [
        (date(2024, 2, 1), 3, 5, 1.67)
    ]


# --- retention -----------------------------------------------------------------------------


def test_cohorts(make):
    t = make(
        pages=[
            page("u1", "2024-01-31 18:29"), page("u1", "2024-01-31 18:30"),  # January, February
            page("u2", "2024-01-10"), page("u2", "2024-03-10"),
            page("u3", "2024-02-10"),
            page(None, "2024-01-10"),
        ]
    )
    jan, feb = date(2024, 1, 1), date(2024, 2, 1)
    assert rows(retention.monthly_retention_cohort(t, params())) == [
        (jan, 2, 0, 2, 100.0), (jan, 2, 1, 1, 50.0), (jan, 2, 2, 1, 50.0), (feb, 1, 0, 1, 100.0)
    ]


def test_cohorts_of_all_customers_need_a_known_user(two_domains):
    got = rows(retention.monthly_retention_cohort(two_domains, params(domain=None)))
    assert got == [(date(2024, 2, 1), 2, 0, 2, 100.0)]


def test_activation_delays(make):
    t = make(
        pages=[
            page("early", "2024-01-20 08:00"),
            page("next_day", "2024-02-01 23:30"),  # local February 2
            page("week", "2024-02-09 08:00"),
            page("never", "2024-02-09", B),
            page("never", "2023-01-01", A),
        ],
        users=[
            user("early", created="2024-02-01"),
            user("next_day", created="2024-02-01 23:00"),
            user("week", created="2024-02-02 23:00"),
            user("week", created="2024-02-01 23:00"),
            user("old", created="2023-12-31"),
        ],
    )
    (got,) = rows(retention.activation_funnel(t, params()))
    assert got == (date(2024, 2, 1), 3, 2, 2, 3, 3, 0, 66.7, 66.7, 100.0)


def test_activation_counts_users_without_events_here(make):
    # Attributed to B, but its only event in B is noise-free nothing: the view is older.
    t = make(pages=[page("u", "2020-01-01", A)], users=[user("u", created="2024-02-01")])
    (got,) = dicts(retention.activation_funnel(t, params()))
    assert (got["activated_1d"], got["never_activated"]) == (1, 0)  # any date counts


def test_churn(make):
    t = make(
        pages=[
            page("lost", "2024-03-31 18:29"),  # last minute of local March
            page("kept", "2024-03-10"), page("kept", "2024-03-31 18:30"),
            page("new", "2024-04-10"),
            page("old", "2024-02-29 18:29"),  # last minute of local February
            page(None, "2024-03-10"), page(None, "2024-04-10"),
        ],
        tracks=[track("lost", "2024-04-10", "api_error_emit")],
        users=[user("lost", "1@mail", role="admin"), user("lost", "2@mail")],
    )
    march = date(2024, 3, 1)
    assert rows(retention.churned_users(t, params())) == [
        (None, None, None, None, None, march), ("lost", "2@mail", None, "admin", None, march)
    ]


def test_reactivation_needs_thirty_days(make):
    t = make(
        pages=[
            page("u", "2024-01-01"), page("u", "2024-01-31"), page("u", "2024-03-20"),
            page("v", "2024-01-01"), page("v", "2024-01-30"),
        ]
    )
    got = [(r["user_id"], r["reactivation_date"], r["gap_days"]) for r in
           dicts(retention.reactivated_users(t, params()))]
    assert got == [("u", date(2024, 3, 20), 49), ("u", date(2024, 1, 31), 30)]


def _searched(event):
    return event[0] == "track" and event[3] == "discovery_search_results"


@pytest.mark.parametrize(
    "report, signal",
    [
        (retention.daily_retention_session_to_pageview, lambda e: e[0] == "page"),
        (retention.daily_retention_session_to_search, _searched),
        (retention.daily_retention_session_to_session, lambda e: True),
    ],
)
@pytest.mark.parametrize("days", [3, 14])
def test_day_n_retention_equals_the_full_grid(make, report, signal, days):
    rng = random.Random(days)
    events = [
        (
            rng.choice(["page", "track"]),
            rng.choice(["u1", "u2", "u3", "u4", "hot", "hot", "hot"]),
            datetime(2024, 4, 1) + timedelta(hours=rng.randint(0, 24 * 28)),
            rng.choice(["discovery_search_results", "main_click"]),
        )
        for _ in range(150)
    ]
    t = make(
        pages=[page(u, "2024-01-01") for u in ("u1", "u2", "u3", "u4", "hot")]
        + [page(u, w.isoformat()) for s, u, w, _ in events if s == "page"]
        + [page(None, "2024-04-02 08:00"), page(None, "2024-04-03 08:00")],
        tracks=[track(u, w.isoformat(), e) for s, u, w, e in events if s == "track"],
    )
    p = params(retention_days=days, start=ts("2024-03-01"))
    active_days = {(u, local(w)) for _, u, w, _ in events}
    back = {(e[1], local(e[2])) for e in events if signal(e)}
    expected = {}
    for day in {d for _, d in active_days} | {date(2024, 4, 2), date(2024, 4, 3)}:
        if day > p.as_of.date() - timedelta(days=days):
            continue
        cohort = {u for u, d in active_days if d == day}
        for n in range(days):
            expected[day, n] = (
                len(cohort), sum((u, day + timedelta(days=n)) in back for u in cohort)
            )
    got = {(r["cohort_date"], r["day_n"]): r for r in dicts(report(t, p))}
    assert {k: (r["cohort_size"], r["retained_users"]) for k, r in got.items()} == expected
    if report is retention.daily_retention_session_to_session:
        assert all(r["retention_pct"] in (100.0, None) for (_, n), r in got.items() if n == 0)


def test_weekly_retention_spans_eight_dates(make):
    t = make(
        pages=[
            page("same", "2024-02-05"),
            page("last", "2024-02-12"),
            page("late", "2024-02-13"),
            page("track_only", "2023-01-01"),
            page("fresh", "2024-04-24"),  # window not complete
        ],
        tracks=[track(u, "2024-02-05") for u in ("last", "late", "track_only")],
    )
    assert rows(retention.retention_rate_aggregate(t, params())) == [
        (date(2024, 2, 5), 4, 2, 50.0)
    ]


def test_funnel_splits_by_governance(make):
    t = make(
        pages=[
            page("one", "2024-02-01"), page("two", "2024-02-01"), page("two", "2024-02-02"),
            page("track_only", "2023-12-01"), page("late", "2024-05-01 00:00:00"),
            page(None, "2024-02-01"), page(None, "2024-02-01"),
        ],
        tracks=[
            track("track_only", "2024-02-01", "governance_x"),
            track("two", "2024-02-01", "asset_update_x"),
            track("one", "2024-02-01", "gtc_tree_x"),  # not a creation
        ],
    )
    assert rows(retention.funnel_session_to_pageview(t, params())) == [
        ("Step 1: Active User", 1, 3, None, None, 100.0, None),
        ("Step 2: Pageview", 2, 2, 1, 1, 66.7, 66.7),
        ("Step 3: 2+ Pageviews", 3, 1, 1, 0, 33.3, 50.0),
    ]


# --- health and review ---------------------------------------------------------------------


def _months(domain, march, april, both, name="home"):
    """Views of ``march`` users in March and ``april`` in April, ``both`` of them shared."""
    return [page(f"{domain}{i}", "2024-03-10", domain, name) for i in range(march)] + [
        page(f"{domain}{i}", "2024-04-10", domain, name)
        for i in range(march - both, march - both + april)
    ]


@pytest.fixture
def accounts(make):
    return make(
        pages=_months("grow", 4, 5, 4, "discovery")
        + _months("lone", 1, 3, 1)
        + _months("fresh", 0, 2, 0)
        + _months("gone", 3, 0, 0)
        + _months("drop", 10, 7, 5)
        + [page("q", "2024-01-31 18:29", "quiet"), page("q2", "2023-01-01", "silent")]
    )


def test_scorecard_special_cases(accounts):
    got = {r["domain"]: r for r in dicts(health.customer_health_scorecard(accounts, params()))}
    assert set(got) == {"grow", "lone", "fresh", "gone", "drop", "quiet"}
    view = lambda d, *keys: tuple(got[d][k] for k in keys)
    main = ("current_mau", "prev_mau", "avg_mau_3m", "retention_pct", "health_score", "health_status")
    # 25 * 5/5 + 25 + 25 * 1/6 + 25 * 4/4 = 79.17
    assert view("grow", *main) == (5, 4, 5.0, 100.0, 79.0, "Healthy")
    # one user last month, or none: no score
    assert view("lone", *main) == (3, 1, 2.0, 100.0, None, "Critical")
    assert view("fresh", *main) == (2, 0, 2.0, None, None, "Critical")
    # nobody this month: no trend, no stickiness
    assert view("gone", *main) == (0, 3, 3.0, 0.0, 0.0, "Critical")
    assert view("gone", "stickiness", "license_util_pct") == (None, 0.0)
    # 25 * 7/12 + 0 + 0 + 25 * 5/10 = 27.08; 7 < 8, so the trend gives nothing
    assert view("drop", *main) == (7, 10, 9.0, 50.0, 27.0, "Critical")
    # five user-days over five users and the 29 days before the 30th
    assert view("grow", "stickiness", "features_used", "total_user_count") == (0.034, 1, 5)
    assert view("quiet", *main) == (0, 0, 1.0, None, None, "Critical")


def test_scorecard_keeps_division_places(make):
    # Share 6/18 at six places: 25 * 0.333333 = 8.333325. With 25 for the trend, 8.3333333 for
    # 2 of 6 features and 20.8333333 for 5 of 6 users kept, the sum is 62.4999916, not 62.5.
    views = [page(f"u{i}", "2024-03-10", A, "x") for i in range(6)]
    views += [page(u, "2024-04-10", A, "x") for u in ("u0", "u1", "u2", "u3", "u4", "n0")]
    views += [page("u0", "2024-04-10", A, n) for n in ("discovery", "monitor")]
    views += [page(f"n{i}", "2023-01-01", A) for i in range(12)]
    (got,) = dicts(health.customer_health_scorecard(make(pages=views), params()))
    assert (got["total_user_count"], got["current_mau"], got["prev_mau"]) == (18, 6, 6)
    assert (got["features_used"], got["retention_pct"], got["health_score"]) == (2, 83.3, 62.0)
    assert got["health_status"] == "At Risk"


def test_snapshot(accounts):
    got = {r["domain"]: r for r in dicts(health.domain_summary_snapshot(accounts, params()))}
    drop = got["drop"]
    assert (drop["active_this_month"], drop["active_last_month"], drop["mau_change_pct"]) == (
        7, 10, -30.0
    )
    assert (drop["license_util_pct"], drop["days_since_last_activity"]) == (58.3, 20)
    assert got["silent"]["last_activity"] is None and got["silent"]["total_users"] == 1
    assert got["fresh"]["mau_change_pct"] is None


def test_snapshot_ignores_unnamed_views(make):
    t = make(pages=[page("u", "2024-04-10", A, None)])
    (got,) = dicts(health.domain_summary_snapshot(t, params()))
    assert (got["total_users"], got["active_this_month"]) == (1, 0)


def test_licence_and_role_use_have_different_windows(make):
    t = make(
        pages=[
            page("month", "2024-03-30 12:00"),  # one month back exactly, 31 days
            page("days", "2024-03-31 12:00"),  # 30 days back exactly
            page("off", "2024-01-10"),
        ],
        users=[user(u, role="r", license_type="full", job_role="j") for u in ("month", "days")],
    )
    assert rows(health.license_utilization(t, params())) == [
        (A, "r", "full", 2, 2, 0, 100.0), (A, None, None, 1, 0, 1, 0.0)
    ]
    assert rows(health.role_distribution(t, params())) == [
        (A, "r", "j", 2, 1, 50.0), (A, None, None, 1, 0, 0.0)
    ]


def test_review_pack(make):
    t = make(
        pages=[page("u", "2024-02-10", name="home"), page("v", "2024-03-10", name="home")]
        + [page("w", "2024-03-10", name=None)],
        tracks=[track("v", "2024-03-10", "home"), track("w", "2024-03-10", "home")],
        users=[user("u", "u@mail", "2024-02-05", role="admin"), user("z", created="2024-02-05")],
    )
    assert rows(review.qbr_deck_data(t, params())) == [
        ("1_MAU_TREND", "2024-02-01", "1", "monthly_active_users"),
        ("1_MAU_TREND", "2024-03-01", "2", "monthly_active_users"),
        ("2_TOP_FEATURES", "home", "2", "unique_users"),
        ("3_TOP_USERS", "u@mail", "1", "admin"),
        ("3_TOP_USERS", None, "3", None),  # users without a snapshot together
        ("4_NEW_USERS", "2024-02-01", "1", "new_users"),
    ]


def test_comparison(accounts):
    got = {r["domain"]: r for r in dicts(review.multi_customer_comparison(accounts, params()))}
    assert set(got) == {"grow", "lone", "fresh", "gone", "drop", "quiet", "silent"}
    keys = ("total_users", "current_mau", "prev_mau", "mau_delta", "stickiness", "feature_breadth")
    assert tuple(got["grow"][k] for k in keys) == (5, 5, 4, 1, 0.033, 1)
    assert tuple(got["gone"][k] for k in keys) == (3, 0, 3, -3, 0.0, 0)
    assert tuple(got["silent"][k] for k in keys) == (1, 0, 0, 0, 0.0, 0)


def test_alerts(make):
    t = make(
        pages=_months("drop", 10, 7, 5)
        + _months("edge", 10, 8, 8)  # exactly a fifth
        + _months("gone", 3, 0, 0)
        + [page("s", f"2024-04-0{d}", "sticky") for d in (1, 2, 3)],
        users=[
            user("drop0", created="2024-03-31 12:00"),  # exactly 30 days
            user("edge0", created="2024-03-31 11:59"),
            user("s", created="2024-04-15"),
        ],
    )
    none = "No new users created in the last 30 days"
    assert rows(review.trending_alert(t, params())) == [
        ("drop", "LOW_STICKINESS", "DAU/MAU ratio: 0.033"),
        ("drop", "MAU_DROP_20PCT", "MAU dropped from 10 to 7 (-30.0%)"),
        ("edge", "LOW_STICKINESS", "DAU/MAU ratio: 0.033"),
        ("edge", "ZERO_NEW_USERS", none),
        ("gone", "ZERO_NEW_USERS", none),
    ]


def test_alert_ratio_is_printed_without_trailing_zeros(make):
    # 10 users, 12 user-days, 30 days: 12 / 300 = 0.04
    views = [page(f"u{i}", "2024-04-10") for i in range(10)]
    views += [page(f"u{i}", "2024-04-11") for i in range(2)]
    got = rows(review.trending_alert(make(pages=views), params()))
    assert got[0] == (A, "LOW_STICKINESS", "DAU/MAU ratio: 0.04")
