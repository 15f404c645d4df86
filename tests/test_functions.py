"""Rounding, date boundaries, local time, taxonomies, parameters."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelog.functions import taxonomy
from stridelog.functions.localtime import local_date, local_month, local_time, local_week
from stridelog.functions.numeric import (
    mean,
    minutes_between,
    months_between,
    pct,
    ratio,
    round_half_up,
    seconds_between,
)
from stridelog.functions.text import like_prefix

from .conftest import params, rows, ts


@pytest.mark.parametrize(
    "num, den, scale, factor, expected",
    [
        (201, 200, 2, 1, 1.01),  # 1.005
        (1, 20, 1, 1, 0.1),  # 0.05
        (-1, 20, 1, 1, -0.1),
        (1, 2000, 3, 1, 0.001),  # 0.0005
        (1, 3, 1, 100, 33.3),
        (2, 3, 1, 100, 66.7),
        (5, 2, 0, 1, 3.0),
        (7, 0, 1, 1, None),
        (0, 7, 1, 1, 0.0),
    ],
)
def test_ratio_rounds_halves_away_from_zero(spark, num, den, scale, factor, expected):
    df = spark.createDataFrame([(num, den)], "n bigint, d bigint")
    assert rows(df.select(ratio(F.col("n"), F.col("d"), scale, factor))) == [(expected,)]


def test_division_keeps_its_places_before_the_outer_rounding(spark):
    df = spark.createDataFrame([(449_999_996, 10**9)], "n bigint, d bigint")
    n, d = F.col("n"), F.col("d")
    assert rows(df.select(ratio(n, d, 1), ratio(n, d, 1, division=6))) == [(0.4, 0.5)]


def test_large_counts_do_not_overflow(spark):
    df = spark.createDataFrame([(9 * 10**15, 10**16)], "n bigint, d bigint")
    assert rows(df.select(pct(F.col("n"), F.col("d")), mean(F.col("n"), F.col("d")))) == [
        (90.0, 0.9)
    ]


def test_round_half_up(spark):
    df = spark.createDataFrame([(0.25,), (77.25,), (77.24,)], "x double")
    assert rows(df.select(round_half_up(F.col("x"), 1))) == [(0.3,), (77.3,), (77.2,)]


def test_differences_count_boundaries(spark):
    schema = "a timestamp_ntz, b timestamp_ntz"
    df = spark.createDataFrame(
        [
            (ts("2024-01-01 10:00:59"), ts("2024-01-01 10:01:00")),
            (ts("2024-01-01 23:00:00"), ts("2024-01-02 01:00:00")),
            (ts("2024-01-31 12:00:00"), ts("2024-02-01 00:00:00")),
            (ts("2024-01-01 10:00:00.900"), ts("2024-01-01 10:00:01.100")),
        ],
        schema,
    )
    a, b = F.col("a"), F.col("b")
    got = rows(
        df.select(
            seconds_between(a, b),
            minutes_between(a, b),
            months_between(F.to_date(a), F.to_date(b)),
        )
    )
    assert got == [(1, 1, 0), (7200, 120, 0), (43200, 720, 1), (1, 0, 0)]


def test_differences_ignore_the_session_time_zone(spark):
    df = spark.createDataFrame(
        [(ts("2024-03-10 01:30"), ts("2024-03-10 03:30"))], "a timestamp_ntz, b timestamp_ntz"
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # clocks change that night
    try:
        assert rows(df.select(seconds_between(F.col("a"), F.col("b")))) == [(7200,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_local_calendar(spark):
    df = spark.createDataFrame(
        [
            (ts("2024-03-31 18:29:59"),),  # Sunday 23:59:59 local
            (ts("2024-03-31 18:30:00"),),  # Monday 00:00 local, next month
            (ts("2024-02-29 18:30:00"),),
        ],
        "ts timestamp_ntz",
    )
    col, zone = F.col("ts"), "Asia/Kolkata"
    out = df.select(local_date(col, zone), local_week(col, zone), local_month(col, zone))
    assert [f.dataType for f in out.schema] == [T.DateType()] * 3
    assert rows(out) == [
        (date(2024, 3, 31), date(2024, 3, 25), date(2024, 3, 1)),
        (date(2024, 4, 1), date(2024, 4, 1), date(2024, 4, 1)),
        (date(2024, 3, 1), date(2024, 2, 26), date(2024, 3, 1)),
    ]


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York", "Asia/Kathmandu", "UTC"])
@pytest.mark.parametrize("session_zone", ["UTC", "Europe/Berlin"])
def test_local_time_equals_convert_timezone(spark, zone, session_zone):
    minutes = spark.range(0, 366 * 1440, 7).select(
        (
            F.lit("2024-01-01 00:00:00.123456").cast("timestamp_ntz")
            + F.expr("INTERVAL '1' MINUTE") * F.col("id")
        ).alias("ts")
    )
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        expected = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
        differs = local_time(F.col("ts"), zone) != expected
        assert minutes.filter(differs).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_like_prefix_equals_like(spark):
    names = ["gtc_tree_x", "gtc-tree-x", "gtc_tree_", "gtc_tree", "gtcXtreeXy", "xgtc_tree_x", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    same = F.col("s").like("gtc_tree_%").eqNullSafe(like_prefix(F.col("s"), "gtc_tree_%"))
    assert df.filter(~same).count() == 0


@pytest.mark.parametrize(
    "kind, name, expected",
    [
        (taxonomy.MATRIX, "classifications", "Governance"),
        (taxonomy.MATRIX, "manage", "Admin"),
        (taxonomy.MATRIX, "playbook", "Workflows"),
        (taxonomy.MATRIX, "usage", "Usage Analytics"),
        (taxonomy.MATRIX, "other", None),
        (taxonomy.QUADRANT, "playbook", "Workflows"),
        (taxonomy.QUADRANT, "marketplace", None),
        (taxonomy.TREND, "playbook", None),
        (taxonomy.TREND, "home", "Home"),
        (taxonomy.BREADTH, "insights", "Insights"),
        (taxonomy.BREADTH, "classifications", None),
        (taxonomy.HEALTH, "monitor", "Data Quality"),
    ],
)
def test_page_labels(spark, kind, name, expected):
    df = spark.createDataFrame([(name,)], "s string")
    assert rows(df.select(kind.page_label(F.col("s")))) == [(expected,)]


@pytest.mark.parametrize(
    "kind, event, expected",
    [
        (taxonomy.MATRIX, "discovery_metadata_edit", "Discovery"),
        (taxonomy.MATRIX, "discovery", None),
        (taxonomy.MATRIX, "products_home_opened", "Data Products"),
        (taxonomy.QUADRANT, "discovery_search", "Discovery/Search"),
        (taxonomy.QUADRANT, "discovery_metadata_edit", "Metadata Curation"),
        (taxonomy.QUADRANT, "discovery_filter_x", None),
        (taxonomy.QUADRANT, "main_navigation_button_clicked", "Navigation"),
        (taxonomy.TREND, "gtc_tree_create", "Governance"),
        (taxonomy.BREADTH, "gtc_tree_create", None),
        (taxonomy.BREADTH, "governance_x", "Governance"),
    ],
)
def test_event_labels(spark, kind, event, expected):
    df = spark.createDataFrame([(event,)], "s string")
    assert rows(df.select(kind.event_label(F.col("s")))) == [(expected,)]


def test_parameters():
    p = params(as_of=ts("2024-03-31 12:00"))
    assert p.months_ago(1) == datetime(2024, 2, 29, 12)
    assert p.months_ago(4) == datetime(2023, 11, 30, 12)
    assert p.days_ago(30) == datetime(2024, 3, 1, 12)
    assert [p.month(n) for n in (-3, 0, 10)] == [
        date(2023, 12, 1),
        date(2024, 3, 1),
        date(2025, 1, 1),
    ]
    assert p.month_start_utc() == datetime(2024, 2, 29, 18, 30)
    assert p.days_in_month == 31
    with pytest.raises(ValueError):
        params(domain=None).require_domain()
