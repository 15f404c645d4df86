"""Named dimensions and measures over the three tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.users import user_latest
from ..sources.schemas import PAGES_COLUMNS, TRACKS_COLUMNS, USERS_COLUMNS
from ..sources.tables import Tables

# Snapshot columns outside the model. Fixed values.
_NOT_DIMENSIONS = ("received_at", "session_uuid")

_USER_DIMENSIONS = tuple(c for c in USERS_COLUMNS if c not in _NOT_DIMENSIONS)

DIMENSIONS = {
    "pages": PAGES_COLUMNS,
    "tracks": TRACKS_COLUMNS,
    "users": _USER_DIMENSIONS,
}

# Measures by table; each counts rows.
MEASURES = {"pages": ("event_count",), "tracks": ("event_count",), "users": ("user_count",)}


def query(
    t: Tables,
    table: str,
    dimensions: Sequence[str],
    where: Column | str | None = None,
    measures: Sequence[str] | None = None,
    where_user: Column | str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """``measures`` of the rows of ``table`` by ``dimensions``.

    ``pages`` and ``tracks`` can also be grouped by attributes of their user, written
    ``users.role`` and returned as ``users_role``. The users table repeats ids, so the join takes
    one row per user (the greatest value of each attribute) and events are counted per user
    before it. ``where`` filters on columns of the table itself, before anything is counted;
    ``where_user`` on attributes of that one row per user, by their plain names; an event without
    a known user has none and meets only conditions that hold for NULL. ``start`` and ``end``
    bound the timestamps of events (half-open); unlike a condition on the timestamp in ``where``
    they also leave out the day partitions outside them, if the table has such. Without dimensions the
    result is one row, without measures the distinct dimensions. The default is all measures of
    the table.
    """
    if table not in DIMENSIONS:
        raise ValueError(f"unknown table {table!r}")
    own = [d for d in dimensions if not d.startswith("users.")]
    joined = [d.removeprefix("users.") for d in dimensions if d.startswith("users.")]
    unknown = [d for d in own if d not in DIMENSIONS[table]]
    unknown += [d for d in joined if table == "users" or d not in _USER_DIMENSIONS]
    if unknown:
        raise ValueError(f"unknown dimensions of {table}: {unknown}")
    if where_user is not None and table == "users":
        raise ValueError("where_user is for tables that join users")
    wanted = MEASURES[table] if measures is None else tuple(measures)
    if set(wanted) - set(MEASURES[table]):
        raise ValueError(f"unknown measures of {table}: {sorted(set(wanted) - set(MEASURES[table]))}")

    if table == "users" and (start is not None or end is not None):
        raise ValueError("start and end are for tables of events")
    between = {"pages": t.pages_between, "tracks": t.tracks_between}
    rows = between[table](start, end) if table in between else t.users
    if where is not None:
        rows = rows.filter(where)
    out = [d if d in own else f"users_{d.removeprefix('users.')}" for d in dimensions]
    if not joined and where_user is None:
        counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = _by_user(t, rows, own, joined, where_user).groupBy(*out).agg(F.sum("n").alias("n"))
        if not out:
            counted = counted.select(F.coalesce("n", F.lit(0)).alias("n"))
    order = [F.desc("n")] if wanted else []
    return counted.orderBy(*order, *out).select(*out, *[F.col("n").alias(m) for m in wanted])


def _by_user(
    t: Tables, rows: DataFrame, own: list[str], joined: list[str], where_user: Column | str | None
) -> DataFrame:
    """Rows counted (``n``) per user and own dimension, with the user's attributes."""
    per_user = rows.groupBy(
        F.col("user_id").alias("__user"), *[F.col(d).alias(f"own_{d}") for d in own]
    ).agg(F.count(F.lit(1)).alias("n"))
    attributes = [d for d in _USER_DIMENSIONS if d != "id"]
    if where_user is None:
        attributes = [d for d in joined if d != "id"]
    users = user_latest(t.users, *attributes) if attributes else t.users.select("id").distinct()
    matched = per_user.join(users, per_user["__user"] == users["id"], "left")
    if where_user is not None:
        matched = matched.filter(where_user)
    return matched.select(
        "n",
        *[F.col(f"own_{d}").alias(d) for d in own],
        *[F.col(d).alias(f"users_{d}") for d in joined],
    )
