"""Generations are published whole; the stored state equals a rebuild after any way of loading."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as registry
from stridelog.operators import bitmaps
from stridelog.operators.domains import user_domains
from stridelog.plans import active, stored
from stridelog.sources import layout
from stridelog.sources.fixtures import fixture, fixture_state, fixture_tables
from stridelog.sources.generations import Conflict, Generation, Generations
from stridelog.sources.state import UsageState

from .conftest import SF_DIR, dicts, page, params, rows, track, ts

NUMBERS = {"n": T.StructType([T.StructField("n", T.LongType())])}
SORTED = lambda df: sorted(map(str, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Generations(spark, str(tmp_path / "store"), NUMBERS)


def load(store, *values, base=None):
    base = base or store.latest()
    name = store.new_load()
    store.write("n", name, store.spark.createDataFrame([(v,) for v in values], NUMBERS["n"]))
    return store.publish(base, {"n": [*base.loads.get("n", []), name]}, {})


def test_generations_are_read_whole(store):
    assert store.latest() == Generation() and rows(store.read("n", store.latest())) == []
    first = load(store, 1, 2)
    store.write("n", store.new_load(), store.spark.createDataFrame([(9,)], NUMBERS["n"]))  # died
    second = load(store, 3)
    assert sorted(rows(store.read("n", first))) == [(1,), (2,)]
    assert sorted(rows(store.read("n", second))) == [(1,), (2,), (3,)]
    assert store.latest() == second and second.number == 2


def test_of_two_loads_at_once_one_fails(store):
    base = load(store, 1)
    load(store, 2, base=base)
    with pytest.raises(Conflict):
        load(store, 3, base=base)
    assert sorted(rows(store.read("n", store.latest()))) == [(1,), (2,)]
    load(store, 3)
    assert sorted(rows(store.read("n", store.latest()))) == [(1,), (2,), (3,)]


def test_pruning_keeps_what_is_named(store):
    first = load(store, 1)
    name = store.new_load()
    store.write("n", name, store.spark.createDataFrame([(5,)], NUMBERS["n"]))
    store.publish(first, {"n": [name]}, {})  # replaces
    load(store, 6)
    removed = store.prune(keep=2)
    assert [r.rsplit("=")[-1] for r in removed] == first.loads["n"]
    assert sorted(rows(store.read("n", store.latest()))) == [(5,), (6,)]
    assert sorted(rows(store.read("n", store.get(2)))) == [(5,)]


# --- state


DAYS = (date(2024, 2, 10), date(2024, 2, 11), date(2024, 3, 15), date(2024, 12, 31))


@pytest.fixture(scope="module")
def tables(spark):
    return fixture(spark, SF_DIR)


REPORTS = ("dau_by_domain", "wau_by_domain", "mau_by_domain", "mau_dau_ratio")


def same_as_direct(s, t, p=registry.PARAMS, names=("dau_by_domain", "mau_by_domain")):
    assert SORTED(s.domains) == SORTED(user_domains(t.pages))
    for name in names:
        assert SORTED(getattr(stored, name)(s, p)) == SORTED(getattr(active, name)(t, p)), name


def test_load_by_load_equals_a_rebuild(spark, tables, tmp_path, monkeypatch):
    state = UsageState(spark, str(tmp_path / "state"))
    assert state.update(tables, DAYS[0]).number == 1
    publish = Generations.publish

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Generations, "publish", crash)
    with pytest.raises(RuntimeError):
        state.update(tables, DAYS[1])
    monkeypatch.setattr(Generations, "publish", publish)
    assert state.tables().through == DAYS[0]
    state.update(tables, DAYS[1])
    assert state.update(tables, DAYS[1]).number == 2  # a repeated day changes nothing
    assert state.update(tables, DAYS[0]).number == 2
    state.update(tables, DAYS[2])
    state.update(tables, DAYS[3])
    s = state.tables()
    same_as_direct(s, tables, registry.EVERY_CUSTOMER, REPORTS)
    same_as_direct(s, tables, replace(registry.PARAMS, start=datetime(2024, 2, 20)))
    direct = registry._OPERATORS["derived_sessions"](tables)
    assert SORTED(stored.derived_sessions(s)) == SORTED(direct)
    state.store.prune(keep=1)
    same_as_direct(state.tables(), tables, names=())


def test_a_load_reads_its_days_only(spark, tables, tmp_path):
    root = str(tmp_path / "days")
    layout.write_events(tables.pages, f"{root}/pages")
    layout.write_events(tables.tracks, f"{root}/tracks")
    tables.users.write.parquet(f"{root}/users")
    t = type(tables).from_parquet(spark, root, day_column=layout.DAY_COLUMN)
    state = UsageState(spark, str(tmp_path / "state"))
    state.update(t, date(2024, 3, 1))
    seen = []
    read = state._days

    def spy(pages, tracks):
        seen.append(pages._jdf.queryExecution().executedPlan().toString())
        return read(pages, tracks)

    state._days = spy
    state.update(t, date(2024, 12, 31))
    (filters,) = [line for line in seen[0].splitlines() if "PartitionFilters" in line]
    assert "event_day" in filters.split("PartitionFilters")[1].split("]")[0]
    same_as_direct(state.tables(), tables)


def build(make, **more):
    return make(
        pages=[
            page("1", "2024-01-01 10:00", "a.example"),
            page("1", "2024-01-01 23:50", "a.example"),
            page("1", "2024-01-02 00:10", "a.example"),
            page("1", "2024-01-02 00:45", "a.example"),
            page(None, "2024-01-01 10:00", "c.example"),
            page("2", "2024-01-01 10:00", None),
            {"user_id": "3", "timestamp": None, "domain": "c.example"},
        ]
        + more.get("pages", []),
        tracks=[
            track("1", "2024-01-01 12:00"),
            track("2", "2024-01-02 09:00"),
            track("3", "2024-01-02 09:00"),
            track(None, "2024-01-02 09:00"),
            track("4", "2024-01-02 09:00"),
            track("2", "2024-01-02 09:00", "workflow_x"),
        ],
    )


def test_state_of_awkward_rows(spark, make, tmp_path):
    t = build(make, pages=[page("2", "2024-01-03 09:00", "b.example"), page("1", "2024-01-03 09:00", "b.example")])
    state = UsageState(spark, str(tmp_path / "state"))
    for day in (1, 2, 3):
        state.update(t, date(2024, 1, day))
    # user 1 moved to b.example on the last day, with all its earlier tracked events
    for domain in (None, "a.example", "b.example", "c.example"):
        same_as_direct(state.tables(), t, params(domain=domain))
    counts = rows(stored.dau_by_domain(state.tables(), params(domain="c.example")))
    assert ("c.example", date(2024, 1, 1), 0) in counts  # a view without a user


def test_sessions_go_on_over_midnight(spark, make, tmp_path):
    t = build(make)
    state = UsageState(spark, str(tmp_path / "state"))
    state.update(t, date(2024, 1, 1))
    before = {(r["user_id"], r["session_id"]): r for r in dicts(state.tables().sessions)}
    assert before["1", 3]["events"] == 1
    state.update(t, date(2024, 1, 5))
    after = {(r["user_id"], r["session_id"]): r for r in dicts(state.tables().sessions)}
    assert after["1", 3]["events"] == 2 and after["1", 3]["last_ts"] == ts("2024-01-02 00:10")
    assert after["1", 4]["events"] == 1  # 35 minutes later
    assert after["1", 1] == before["1", 1]
    assert after[None, 2]["events"] == 1


def test_late_events_come_in_and_end_the_sessions(spark, make, tmp_path):
    state = UsageState(spark, str(tmp_path / "state"))
    state.update(build(make), date(2024, 1, 2))
    late = build(make, pages=[page("7", "2024-01-01 11:00", "d.example"), page("4", "2024-01-01 00:00", "d.example")])
    assert state.update(late, date(2024, 1, 2)).number == 1  # not asked for
    state.update(late, date(2024, 1, 2), again=[date(2024, 1, 1), date(2030, 1, 1)])
    same_as_direct(state.tables(), late, params(domain=None))
    state.update(late, date(2024, 1, 3))
    with pytest.raises(ValueError, match="late events"):
        stored.derived_sessions(state.tables())


def test_what_the_state_cannot_answer_is_an_error(spark, make, tmp_path):
    state = UsageState(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError, match="nothing is loaded"):
        state.tables()
    state.update(build(make), date(2024, 1, 2))
    s = state.tables()
    with pytest.raises(ValueError, match="midnight"):
        stored.dau_by_domain(s, params(start=datetime(2024, 1, 1, 5)))
    with pytest.raises(ValueError, match="kept for"):
        stored.dau_by_domain(s, params(tz="America/Panama"))
    with pytest.raises(ValueError, match="kept for"):
        UsageState(spark, str(tmp_path / "state"), "America/Panama").tables()


def test_users_keep_their_numbers(spark, tables, tmp_path):
    state = UsageState(spark, str(tmp_path / "state"))
    first = state.update(tables, date(2024, 1, 1))
    before = dict(rows(state.store.read("numbers", first)))
    last = state.update(tables, DAYS[3])
    after = dict(rows(state.store.read("numbers", last)))
    assert before.items() <= after.items() and len(after) > len(before)
    assert len(set(after.values())) == len(after)


def test_reports_scan_sets_only(spark, tables, tmp_path):
    state = UsageState(spark, str(tmp_path / "state"))
    state.update(tables, DAYS[3])
    plan = stored.mau_by_domain(state.tables(), registry.PARAMS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in text and "Cartesian" not in text and "Python" not in text
    assert set(plan.inputFiles()) <= {
        f for table in ("homes", "active") for f in state.store.read(table, state.store.latest()).inputFiles()
    }


def test_sets_unite_and_meet(spark):
    numbered = [("a", 1), ("a", 40_000), ("a", 1), ("b", 40_000), ("b", None), ("c", None)]
    sets = bitmaps.user_sets(spark.createDataFrame(numbered, "k string, number bigint"), "k")
    total = lambda s, *k: {r[:-1]: r[-1] for r in rows(s.groupBy(*k).agg(F.sum(bitmaps.size())))}
    assert total(sets, "k") == {("a",): 2, ("b",): 1, ("c",): 0}
    assert total(bitmaps.united(sets)) == {(): 2}
    other = sets.select(F.col("k").alias("j"), "bucket", "users")
    assert total(bitmaps.common(sets, other, "k", "j"), "k", "j") == {
        ("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 1,
    }


def test_sessions_day_by_day_equal_the_whole(spark):
    from stridelog.operators.sessions import bursts, continue_sessions, sessionize

    start = datetime(2024, 1, 1)
    stream = [(u, start + timedelta(seconds=(i * i * 37 + u * 911) % (5 * 86400))) for u in range(6) for i in range(90)]
    events = spark.createDataFrame(
        [(None if u == 5 else str(u), t) for u, t in stream], "user_id string, ts timestamp_ntz"
    )
    whole = SORTED(sessionize(bursts(events)))
    last = spark.createDataFrame([], "user_id string, session_id bigint, events bigint, first_ts timestamp_ntz, last_ts timestamp_ntz")
    over = []
    for day in range(5):
        of_day = events.filter(F.to_date("ts") == F.lit((start + timedelta(days=day)).date()))
        found = dicts(continue_sessions(last, bursts(of_day)))
        newest = {}
        for row in found:
            if row["session_id"] > newest.get(row["user_id"], {"session_id": 0})["session_id"]:
                newest[row["user_id"]] = row
        over += [r for r in found if r != newest[r["user_id"]]]
        last = spark.createDataFrame([tuple(r[c] for c in last.columns) for r in newest.values()], last.schema)
    merged = spark.createDataFrame([tuple(r[c] for c in last.columns) for r in over], last.schema).unionByName(last)
    assert SORTED(merged.select("user_id", "session_id", "events", "first_ts", "last_ts")) == whole


def derived_input(spark, folder, events):
    columns = "event_id bigint, ts timestamp, user_id bigint, event_type string, props string"
    spark.createDataFrame(events, columns).write.parquet(f"{folder}/events.parquet")
    customers = [(1, 0, "BUILDING"), (2, 1, "MACHINERY"), (3, 2, None)]
    columns = "c_custkey bigint, c_nationkey int, c_mktsegment string"
    spark.createDataFrame(customers, columns).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def loaded(monkeypatch):
    """Collects the tables that loads read."""
    seen, update = [], UsageState.update

    def spy(state, t, *args):
        seen.append(t)
        return update(state, t, *args)

    monkeypatch.setattr(UsageState, "update", spy)
    return seen


def test_the_input_of_the_loads_is_derived_once(spark, tmp_path, monkeypatch):
    at = datetime(2024, 1, 3, 8)
    events = [(i, at + timedelta(days=i % 9, hours=i), i % 5, "view" if i % 3 else "click", '{"k": %d}' % i) for i in range(60)]
    events += [(100, None, 1, "view", '{"k": 4}'), (101, at, None, "view", None), (102, at, 1, None, None), events[0]]
    sf_dir, seen = derived_input(spark, tmp_path / "sf", events), loaded(monkeypatch)
    s = fixture_state(spark, sf_dir)
    direct = fixture_tables(spark, sf_dir)
    assert len(seen) > 1
    for t in seen:
        assert t.day_column == layout.DAY_COLUMN
        for name in ("pages", "tracks"):
            by_day, rows_of = getattr(t, name), getattr(direct, name)
            assert not [f for f in by_day.inputFiles() if f.startswith(f"file://{sf_dir}")]
            assert SORTED(by_day.select(rows_of.columns)) == SORTED(rows_of)
    same_as_direct(s, direct, registry.EVERY_CUSTOMER, REPORTS)


def test_loads_take_an_input_without_events(spark, tmp_path):
    s = fixture_state(spark, derived_input(spark, tmp_path / "sf", []))
    assert rows(s.domains) == [] and rows(stored.dau_by_domain(s, registry.PARAMS)) == []


def test_no_load_broadcasts_users(spark, tables, tmp_path, monkeypatch):
    plans, write = {}, Generations.write

    def spy(store, table, load, frame, *by):
        plans[table] = frame._jdf.queryExecution().executedPlan().toString()
        write(store, table, load, frame, *by)

    monkeypatch.setattr(Generations, "write", spy)
    state = UsageState(spark, str(tmp_path / "state"))
    state.update(tables, DAYS[0])
    state.update(tables, DAYS[3])
    for table in ("numbers", "homes", "active", "areas"):
        assert "Join" in plans[table] and "BroadcastExchange" not in plans[table], table


def test_no_customers_are_broadcast_to_derive_the_input_of_loads(spark):
    t = fixture_tables(spark, SF_DIR, shuffled=True)
    for frame in (t.pages, t.tracks):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
