"""Building blocks: attribution, noise, activity, sessions, users, tables, layout, model."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stridelog.operators import activity, domains, sessions, users
from stridelog.operators.keyfilter import possible_keys
from stridelog.operators.skew import spread_lookup
from stridelog.plans import model
from stridelog.plans.catalog import REPORTS
from stridelog.sources import layout
from stridelog.sources.tables import Tables

from .conftest import dicts, page, params, rows, track, ts, user


@pytest.fixture
def several(make):
    """u1 in two domains, u2 without any, u3 with tracks only, u4 in b only, and no user."""
    return make(
        pages=[
            page("u1", "2024-02-01 08:00", "a.example"),
            page("u1", "2024-02-01 09:00", "b.example"),
            page("u2", "2024-02-01 08:00", None),
            page("u4", "2024-02-01 08:00", "b.example"),
            page(None, "2024-02-01 08:00", "a.example"),
        ],
        tracks=[track(u, "2024-02-02 08:00") for u in ("u1", "u2", "u3", "u4")],
    )


def test_user_domains_takes_the_greatest(several):
    assert sorted(rows(domains.user_domains(several.pages)), key=str) == [
        ("u1", "b.example"),
        ("u4", "b.example"),
        (None, "a.example"),
    ]


@pytest.mark.parametrize("domain", ["a.example", "b.example", "c.example"])
def test_user_domains_of_one_domain(several, domain):
    every = rows(domains.user_domains(several.pages))
    one = rows(domains.user_domains(several.pages, domain))
    assert sorted(one, key=str) == sorted([r for r in every if r[1] == domain], key=str)


def test_noise(make):
    names = [*activity.NOISE_EVENTS, "workflow", "workflow_", "workflowX1", "api_other", None]
    t = make(tracks=[track("u", "2024-02-01", n) for n in names])
    kept = {r[0] for r in rows(activity.drop_noise(t.tracks).select("event_text"))}
    assert kept == {"workflow", "api_other"}
    kept = {r[0] for r in rows(activity.drop_noise(t.tracks, True).select("event_text"))}
    assert kept == {"workflow", "workflow_", "workflowX1", "api_other"}
    assert len(activity.NOISE_EVENTS) == 12


def test_activity_events_keeps_unattributed_tracks(several):
    out = activity.activity_events(several, params())
    got = sorted(((r.user_id, r.source, r.domain) for r in out.collect()), key=str)
    assert got == sorted(
        [
            ("u1", "page", "a.example"),
            ("u1", "page", "b.example"),
            ("u2", "page", None),
            ("u4", "page", "b.example"),
            (None, "page", "a.example"),
            ("u1", "track", "b.example"),
            ("u2", "track", None),
            ("u3", "track", None),
            ("u4", "track", "b.example"),
        ],
        key=str,
    )


def test_activity_start_is_utc_and_days_are_local(make):
    t = make(
        pages=[
            page("u", "2023-12-31 23:59:59"),  # local 2024-01-01, but before the UTC start
            page("u", "2024-01-01 00:00:00"),
            page("u", "2024-01-01 18:30:00"),
        ]
    )
    out = activity.activity_events(t, params()).orderBy("event_ts")
    assert [(r.event_ts, r.event_date) for r in out.collect()] == [
        (ts("2024-01-01 05:30:00"), date(2024, 1, 1)),
        (ts("2024-01-02 00:00:00"), date(2024, 1, 2)),
    ]


def _stream(spark, events):
    return spark.createDataFrame(events, "user_id string, ts timestamp_ntz")


def _brute_sessions(events, gap=1800):
    """(user, ordinal, events, first, last) by walking each user's events in order."""
    out = []
    for who in {u for u, _ in events}:
        times = sorted(t for u, t in events if u == who)
        groups = [[times[0]]]
        for before, now in zip(times, times[1:]):
            whole = int((now.replace(microsecond=0) - before.replace(microsecond=0)).total_seconds())
            if whole > gap:
                groups.append([])
            groups[-1].append(now)
        out += [(who, i, len(g), g[0], g[-1]) for i, g in enumerate(groups, 1)]
    return sorted(out, key=str)


def _sessions(df, gap=1800):
    out = sessions.sessionize(sessions.bursts(df, gap), gap).select(
        "user_id", "session_id", "events", "first_ts", "last_ts"
    )
    return sorted(rows(out), key=str)


def test_session_gap_edges(spark):
    at = lambda s: ts("2024-01-01 10:00:00") + timedelta(seconds=s)
    events = [
        ("stay", at(0)), ("stay", at(1800)),
        ("split", at(0)), ("split", at(1801)),
        ("fraction", at(0.9)), ("fraction", at(1801.8)),  # 1800.9 s, 1801 boundaries
        ("floor", at(0.1)), ("floor", at(1800.95)),  # 1800.85 s, 1800 boundaries
        ("equal", at(5)), ("equal", at(5)), ("equal", at(5)),
        ("single", at(7)),
        (None, at(1)), (None, at(2)),
    ]
    got = _sessions(_stream(spark, events))
    assert got == _brute_sessions(events)
    count = {u: sum(1 for r in got if r[0] == u) for u, _ in events}
    assert count == {
        "stay": 1, "split": 2, "fraction": 2, "floor": 1, "equal": 1, "single": 1, None: 1
    }


@pytest.mark.parametrize("gap", [1800, 60, 7])
def test_sessions_equal_brute_force(spark, gap):
    rng = random.Random(gap)
    events = []
    for who in range(12):
        now = datetime(2024, 1, 1) + timedelta(seconds=rng.random() * 5000)
        for _ in range(rng.randint(1, 60)):
            events.append((f"u{who}", now))
            now += timedelta(seconds=rng.choice([0, 0.4, gap - 1, gap, gap + 0.5, gap + 1, 3 * gap]))
    assert _sessions(_stream(spark, events), gap) == _brute_sessions(events, gap)


def test_sessions_equal_session_window(spark):
    rng = random.Random(1)
    events = [
        (f"u{rng.randint(0, 5)}", datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 90_000)))
        for _ in range(400)
    ]
    df = _stream(spark, events)
    whole = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    windows = df.groupBy("user_id", F.session_window(whole, "30 minutes")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    expected = sorted(rows(windows.select("user_id", "events", "a", "b")), key=str)
    assert sorted([(u, n, a, b) for u, _, n, a, b in _sessions(df)], key=str) == expected


def test_derived_sessions_columns(spark):
    df = _stream(spark, [("u", ts("2024-01-01 18:29:00")), ("u", ts("2024-01-01 18:31:00"))])
    assert rows(sessions.derived_sessions(df, "Asia/Kolkata")) == [
        (
            "u", 1, date(2024, 1, 1), ts("2024-01-01 23:59:00"), ts("2024-01-02 00:01:00"), 2, 120
        )
    ]


def test_user_attributes(make):
    t = make(
        users=[
            user("two", "a@mail", role="admin", license_type="full", plan="p1"),
            user("two", "b@mail", "2024-02-01", role="admin"),
            user("roles", "r@mail", role="admin", job_role="x"),
            user("roles", "r@mail", "2023-06-01", role="guest", job_role="y"),
            user("same", "s@mail", "2024-03-01", license_type="full"),
            user("same", "s@mail", "2024-01-15", license_type="viewer"),
            user("hidden", None, role="admin"),
        ]
    )
    meta = users.user_meta(t.users)
    assert sorted(r.id for r in meta.collect()) == ["roles", "roles", "same", "two", "two"]
    latest = {r.id: r for r in users.user_latest(t.users, "email", "role", "job_role").collect()}
    assert (latest["two"].email, latest["roles"].role, latest["roles"].job_role) == (
        "b@mail", "guest", "y"
    )
    assert latest["hidden"].role == "admin"
    created = dict(rows(users.user_created(t.users)))
    assert created["roles"] == ts("2023-06-01") and created["same"] == ts("2024-01-15")
    ident = [r for r in users.identities(t.users).collect() if r.id == "same"]
    assert [(r.license_type, r.user_created_at) for r in ident] == [("viewer", ts("2024-01-15"))]


def test_tables_are_checked(make):
    t = make()
    with pytest.raises(ValueError, match="domain"):
        Tables(t.pages.drop("domain"), t.tracks, t.users)
    with pytest.raises(TypeError, match="timestamp"):
        Tables(t.pages.withColumn("timestamp", F.lit("x")), t.tracks, t.users)


def test_day_layout_prunes_and_keeps_results(spark, make, tmp_path):
    t = make(
        pages=[page(f"u{i}", f"2024-0{1 + i % 4}-0{1 + i % 7} 20:00") for i in range(40)],
        tracks=[track(f"u{i}", f"2024-0{1 + i % 4}-0{1 + i % 7} 21:00") for i in range(40)],
    )
    layout.write_events(t.pages, f"{tmp_path}/pages", ("domain", "user_id"))
    layout.write_events(t.tracks, f"{tmp_path}/tracks")
    t.users.write.parquet(f"{tmp_path}/users")
    layout.write_domains(domains.user_domains(t.pages), f"{tmp_path}/domains")
    stored = Tables.from_parquet(spark, str(tmp_path), day_column=layout.DAY_COLUMN)
    maintained = Tables(
        stored.pages, stored.tracks, stored.users, layout.DAY_COLUMN,
        spark.read.parquet(f"{tmp_path}/domains"),
    )
    p = params(start=ts("2024-03-01"))
    for name in ("mau_by_domain", "churned_users", "customer_health_scorecard"):
        expected = rows(REPORTS[name](t, p))
        assert expected
        assert rows(REPORTS[name](stored, p)) == expected
        assert rows(REPORTS[name](maintained, p)) == expected
    plan = stored.pages_between(p.start)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan


def test_model(make):
    t = make(
        pages=[page("u1", "2024-02-01"), page("u1", "2024-02-02"), page("u9", "2024-02-02", "b")],
        users=[user("u1", "a@mail", role="admin"), user("u1", "b@mail", role="guest")],
    )
    assert rows(model.query(t, "pages", ["domain"])) == [("a.example", 2), ("b", 1)]
    assert rows(model.query(t, "pages", ["users.role", "domain"])) == [
        ("guest", "a.example", 2), (None, "b", 1)
    ]
    assert rows(model.query(t, "pages", ["users.id"])) == [("u1", 2), (None, 1)]
    assert rows(model.query(t, "pages", [], where=F.col("domain") == "b")) == [(1,)]
    assert dicts(model.query(t, "users", ["id"])) == [{"id": "u1", "user_count": 2}]
    assert {k: len(v) for k, v in model.DIMENSIONS.items()} == {
        "pages": 54, "tracks": 11, "users": 16
    }
    for table, dims in (("pages", ["nope"]), ("users", ["users.role"]), ("none", [])):
        with pytest.raises(ValueError):
            model.query(t, table, dims)


def test_possible_keys_keep_every_key_and_few_others(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "k string, id bigint")
    )
    wanted = spark.createDataFrame([("5",), ("77",), (None,), ("absent",)], "k string")
    got = {r["k"] for r in possible_keys(rows, wanted, "k").collect()}
    assert {"5", "77"} <= got and len(got) < 10 and None not in got
    assert possible_keys(rows, wanted, "k").columns == ["k", "id"]
    assert possible_keys(rows, wanted.limit(0), "k").isEmpty()


@pytest.mark.parametrize("hot", ["u7", None])
def test_a_hot_user_is_spread_over_the_tasks(spark, hot):
    n = 12_000
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("u"), F.col("id") % 2000))
    rows = spark.range(n).select(key.alias("user_id"), "id")
    lookup = spark.range(0, 2000, 2).select(
        F.concat(F.lit("u"), "id").alias("user_id"), F.col("id").alias("home")
    ).unionByName(spark.createDataFrame([("u7", 7)], "user_id string, home bigint"))
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = spread_lookup(rows, lookup, "user_id", F.col("id"))
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    homes = {f"u{i}": i for i in range(0, 2000, 2)} | {"u7": 7}
    assert len(got) == n and all(r["home"] == homes.get(r["user_id"]) for r in got)
    sizes = sorted(len([r for r in got if r["task"] == task]) for task in range(16))
    assert sizes[-1] < 3 * sizes[8]


def test_activity_events_of_a_hot_user(make):
    tracks = [track("hot", f"2024-02-01 00:{i // 60:02}:{i % 60:02}") for i in range(900)]
    tracks += [track(f"u{i}", "2024-02-02 00:00") for i in range(50)] + [track(None, "2024-02-02")] * 60
    t = make(pages=[page("hot", "2024-01-02", "a.example"), page("u1", "2024-01-02", "b.example")], tracks=tracks)
    found = rows(activity.activity_events(t, params()).groupBy("user_id", "domain", "source").count())
    assert ("hot", "a.example", "track", 900) in found and (None, None, "track", 60) in found
    assert ("u1", "b.example", "track", 1) in found and ("u2", None, "track", 1) in found
