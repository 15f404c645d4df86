from __future__ import annotations

import os
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stridelog import Params, Tables  # noqa: E402
from stridelog.session import configure  # noqa: E402
from stridelog.sources import schemas  # noqa: E402
from stridelog.sources.fixtures import prepare_fixture  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    prepare_fixture(configure(session), SF_DIR)
    yield session
    session.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _frame(spark, schema, rows):
    return spark.createDataFrame(
        [tuple(row.get(field.name) for field in schema) for row in rows], schema
    )


@pytest.fixture
def make(spark):
    """Tables from lists of dicts; columns left out are NULL."""

    def build(pages=(), tracks=(), users=(), **options) -> Tables:
        return Tables(
            _frame(spark, schemas.PAGES, pages),
            _frame(spark, schemas.TRACKS, tracks),
            _frame(spark, schemas.USERS, users),
            **options,
        )

    return build


def page(user, when, domain="a.example", name="home", **more):
    return {"user_id": user, "timestamp": ts(when), "domain": domain, "name": name, **more}


def track(user, when, event="main_click", **more):
    return {"user_id": user, "timestamp": ts(when), "event_text": event, **more}


def user(id, email="x@mail", created="2024-01-01", **more):
    return {"id": id, "email": email, "created_at": ts(created), **more}


def params(**more) -> Params:
    values = {
        "as_of": ts("2024-04-30 12:00"),
        "start": ts("2024-01-01"),
        "end": ts("2024-05-01"),
        "domain": "a.example",
    }
    return Params(**(values | more))


def rows(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]


def dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]
