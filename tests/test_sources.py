"""The input layer must not lose rows; the lookup can be loaded and merged; the model's filters."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as registry
from stridelog import Tables
from stridelog.operators.domains import update_domains, user_domains
from stridelog.plans import model
from stridelog.plans.catalog import REPORTS
from stridelog.session import configure
from stridelog.sources import fixtures, layout
from stridelog.sources.fixtures import derived_fixture, fixture, fixture_tables, prepare_fixture

from .conftest import SF_DIR, dicts, ts

ORDERED = lambda df: sorted(map(str, df.collect()))


@pytest.fixture
def small(make):
    return make(
        pages=[
            {"user_id": "1", "timestamp": ts("2024-01-01 10:00"), "domain": "b.example", "name": "home"},
            {"user_id": "1", "timestamp": ts("2024-01-02 10:00"), "domain": "a.example", "name": "home"},
            {"user_id": "2", "timestamp": ts("2024-01-03 10:00"), "domain": None, "name": "home"},
        ],
        tracks=[
            {"user_id": "1", "timestamp": ts("2024-01-01 11:00"), "event_text": "x"},
            {"user_id": "9", "timestamp": ts("2024-01-01 11:00"), "event_text": "y"},
        ],
        users=[
            {"id": "1", "role": "admin", "created_at": ts("2024-01-01 00:00")},
            {"id": "1", "role": "guest", "created_at": ts("2023-01-01 00:00")},
            {"id": "2", "role": "member"},
        ],
    )


def stored(tables, path, **changed):
    for name in ("pages", "tracks", "users"):
        changed.get(name, getattr(tables, name)).write.parquet(f"{path}/{name}")
    return str(path)


def test_missing_column_is_an_error(spark, small, tmp_path):
    root = stored(small, tmp_path, pages=small.pages.withColumnRenamed("domain", "customer"))
    with pytest.raises(ValueError, match="missing columns.*domain"):
        Tables.from_parquet(spark, root)


@pytest.mark.parametrize("column", ["user_id", "created_at"])
def test_mistyped_column_is_an_error(spark, small, tmp_path, column):
    table = "tracks" if column == "user_id" else "users"
    wrong = getattr(small, table).withColumn(column, F.lit(1))
    with pytest.raises(TypeError, match=column):
        Tables.from_parquet(spark, stored(small, tmp_path, **{table: wrong}))


def test_empty_folder_is_an_error(spark, small, tmp_path):
    stored(small, tmp_path)
    (tmp_path / "other" / "pages").mkdir(parents=True)
    with pytest.raises(AnalysisException):
        Tables.from_parquet(spark, str(tmp_path / "other"))


def test_absent_model_columns_are_null(spark, small, tmp_path):
    root = stored(small, tmp_path, users=small.users.drop("first_name"))
    t = Tables.from_parquet(spark, root)
    assert dicts(model.query(t, "users", ["first_name"])) == [{"first_name": None, "user_count": 3}]


def test_loaders_take_the_lookup(spark, small, tmp_path):
    root = stored(small, tmp_path)
    layout.write_domains(user_domains(small.pages), f"{root}/domains")
    assert ORDERED(Tables.from_parquet(spark, root, domains=True).domains) == ORDERED(
        user_domains(small.pages)
    )
    assert Tables.from_parquet(spark, root).domains is None
    bad = user_domains(small.pages).withColumnRenamed("domain", "d")
    with pytest.raises(ValueError, match="domains"):
        replace(small, domains=bad)


def test_lookup_is_merged_from_new_days_only(spark):
    pages = fixture_tables(spark, SF_DIR).pages
    full = ORDERED(user_domains(pages))
    for day in ("2024-01-15", "2024-02-01", "2024-04-01"):
        new = F.col("timestamp") >= F.lit(datetime.fromisoformat(day)).cast("timestamp_ntz")
        merged = update_domains(user_domains(pages.filter(~new)), pages.filter(new))
        assert ORDERED(merged) == full
    assert ORDERED(update_domains(merged, pages.filter(new))) == full  # repeated days do no harm


def test_unfinished_write_is_never_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "_root", lambda spark, sf_dir: str(tmp_path / "root"))
    broken = derived_fixture(spark, SF_DIR)
    broken.pages.write.parquet(f"{tmp_path}/root/half/pages")
    for name in ("tracks", "users"):
        getattr(broken, name).limit(0).write.parquet(f"{tmp_path}/root/half/{name}")
    assert fixture(spark, SF_DIR).tracks.count() == broken.tracks.count()

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(fixtures, "_marker", fail)
        with pytest.raises(RuntimeError):
            prepare_fixture(spark, SF_DIR)
    assert fixture(spark, SF_DIR).users.count() == broken.users.count()
    prepare_fixture(spark, SF_DIR)
    published = fixture(spark, SF_DIR, domains=True)
    assert "root" in published.pages.inputFiles()[0]
    for name in ("pages", "tracks", "users", "domains"):
        assert getattr(published, name).count() == getattr(broken, name).count()
    prepare_fixture(spark, SF_DIR)  # already there
    assert len([p for p in (tmp_path / "root").iterdir() if p.is_dir()]) == 2


def test_events_without_a_customer_stay(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    strangers = events.withColumn("user_id", F.col("user_id") + 10**9)
    events.union(strangers).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{SF_DIR}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    t = fixture_tables(spark, str(tmp_path))
    assert t.pages.count() + t.tracks.count() == 2 * events.count()
    assert t.pages.filter("timestamp IS NULL").count() == 0


def test_session_settings_of_the_caller_stay(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        configure(spark)
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_model_filters_and_measures(small):
    q = model.query
    assert dicts(q(small, "pages", ["users.role"], where_user="role = 'guest'")) == [
        {"users_role": "guest", "event_count": 2}
    ]
    assert dicts(q(small, "tracks", [], where_user=F.col("role").isNull())) == [{"event_count": 1}]
    assert dicts(q(small, "tracks", [], where_user="role = 'nobody'")) == [{"event_count": 0}]
    assert dicts(q(small, "tracks", ["users.id"], where="event_text = 'y'")) == [
        {"users_id": None, "event_count": 1}
    ]
    assert dicts(q(small, "pages", ["name"], measures=[])) == [{"name": "home"}]
    for bad in (
        lambda: q(small, "pages", ["name"], measures=["user_count"]),
        lambda: q(small, "users", ["role"], where_user="role = 'x'"),
        lambda: q(small, "users", ["received_at"]),
    ):
        with pytest.raises(ValueError):
            bad()


def test_stickiness_counts_days_of_unknown_users_but_not_the_users(make):
    rows = [
        {"user_id": user, "timestamp": ts(f"2024-04-{day:02d} 10:00"), "domain": domain, "name": "home"}
        for user, day, domain in [
            ("1", 1, "a.example"), ("1", 1, "a.example"), ("1", 30, "a.example"),
            ("2", 2, "a.example"), (None, 3, "a.example"), (None, 4, None),
        ]
    ]
    t = make(pages=rows)
    everyone = replace(registry.EVERY_CUSTOMER, start=ts("2024-04-01"))
    got = dicts(REPORTS["mau_dau_ratio"](t, everyone))
    assert [(r["domain"], r["mau"], r["avg_dau"]) for r in got] == [("a.example", 2, 0.8)]


def test_connector_usage_with_null_types_and_users(make):
    rows = [
        {"user_id": u, "timestamp": ts("2024-04-01 10:00"), "domain": "a.example",
         "connector_name": "bi", "type_name": kind, "asset_guid": g}
        for u, kind, g in [("1", None, "x"), (None, None, "y"), ("2", "T", None), ("2", "T", "x")]
    ]
    got = dicts(REPORTS["connector_usage"](make(pages=rows), registry.EVERY_CUSTOMER))
    assert {
        (r["asset_type"], r["interactions"], r["unique_users"], r["unique_assets_viewed"]) for r in got
    } == {(None, 2, 1, 2), ("T", 2, 1, 1)}


def executed(spark, name, broadcast):
    """The final adaptive plan of a report that ran."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if broadcast else "-1")
    try:
        df = registry.queries()[name](spark, SF_DIR)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize(
    ("name", "scans"),
    [
        ("mau_dau_ratio", 3),
        ("mau_dau_ratio_all", 3),
        ("connector_usage", 2),
        ("qbr_deck_data", 4),
        ("user_meta", 1),
        ("mau_by_domain_maintained", 3),
        ("customer_health_scorecard_maintained", 5),
    ],
)
def test_final_plans(spark, name, scans, broadcast):
    plan = executed(spark, name, broadcast)
    assert "Expand" not in plan or name == "qbr_deck_data"
    assert plan.count("FileScan parquet") <= scans


def test_reports_prune_day_partitions(spark, tmp_path):
    t = fixture(spark, SF_DIR)
    for name in ("pages", "tracks"):
        layout.write_events(getattr(t, name), f"{tmp_path}/{name}")
    t.users.write.parquet(f"{tmp_path}/users")
    layout.write_domains(user_domains(t.pages), f"{tmp_path}/domains")
    days = Tables.from_parquet(spark, str(tmp_path), layout.DAY_COLUMN, domains=True)
    recent = replace(registry.PARAMS, start=datetime(2024, 4, 1))
    for name in ("dau_by_domain", "session_duration", "top_pages_by_domain"):
        report = REPORTS[name](days, recent)
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_day" in plan
        assert ORDERED(report) == ORDERED(REPORTS[name](t, recent))


def test_bounds_of_the_model_prune_days(spark, tmp_path):
    source = fixture_tables(spark, SF_DIR)
    for name in ("pages", "tracks"):
        layout.write_events(getattr(source, name), f"{tmp_path}/{name}")
    source.users.write.parquet(f"{tmp_path}/users")
    t = Tables.from_parquet(spark, str(tmp_path), day_column=layout.DAY_COLUMN)
    bounds = {"start": ts("2024-03-01 12:00"), "end": ts("2024-03-09")}
    found = model.query(t, "pages", ["domain", "users.role"], **bounds)
    plan = found._jdf.queryExecution().executedPlan().toString()
    (line,) = [x for x in plan.splitlines() if "event_day" in x and "PartitionFilters" in x]
    assert "2024-03-01" in line.split("PartitionFilters")[1].split("]")[0]
    where = (F.col("timestamp") >= F.lit(bounds["start"]).cast("timestamp_ntz")) & (
        F.col("timestamp") < F.lit(bounds["end"]).cast("timestamp_ntz")
    )
    assert ORDERED(found) == ORDERED(model.query(source, "pages", ["domain", "users.role"], where))
    with pytest.raises(ValueError, match="tables of events"):
        model.query(t, "users", ["role"], **bounds)


@pytest.fixture
def bucketed(spark, tmp_path):
    """The input as catalog tables bucketed by user, with the lookup."""
    source = fixture_tables(spark, SF_DIR)
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/db'")
    tables = {
        "pages": source.pages,
        "tracks": source.tracks,
        "domains": user_domains(source.pages),
    }
    for name, rows in tables.items():
        layout.save_bucketed(rows, f"bucketed.{name}", 8, f"{tmp_path}/{name}", by_day=name != "domains")
    source.users.write.option("path", f"{tmp_path}/users").saveAsTable("bucketed.users")
    yield Tables.from_catalog(spark, "bucketed", day_column=layout.DAY_COLUMN, domains=True)
    spark.sql("DROP DATABASE bucketed CASCADE")


def test_bucketed_tables_meet_without_a_shuffle(spark, bucketed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        report = REPORTS["mau_by_domain"](bucketed, registry.EVERY_CUSTOMER)
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # All that is indented more than the join lies below it.
    lines = plan.splitlines()
    (join,) = [i for i, line in enumerate(lines) if "SortMergeJoin [user_id" in line]
    depth = lines[join].index("SortMergeJoin")
    below = []
    for line in lines[join + 1 :]:
        if len(line) - len(line.lstrip(" :+-*()0123456789")) <= depth - 4:
            break
        below.append(line)
    text = "\n".join(below)
    assert text.count("FileScan") == 2 and "Exchange" not in text and "Bucketed: true" in text
    assert "PartitionFilters: [isnotnull(event_day" in text
    assert ORDERED(report) == ORDERED(
        REPORTS["mau_by_domain"](fixture_tables(spark, SF_DIR), registry.EVERY_CUSTOMER)
    )
