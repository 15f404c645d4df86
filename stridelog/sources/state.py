"""What reports need of history, kept up to date load by load.

One load takes in whole UTC days and publishes, together:

``domains``   the attribution lookup, replaced by every load
``numbers``   a number for every user, never changed once given; a load adds its new users
``homes``     per domain, the set of users attributed to it, replaced by every load
``active``    per day and kind of event, the set of active users; a load adds its days
``areas``     per day and feature area of the health score, the set of users who viewed its pages
``sessions``  the sessions that are over; a load adds those that ended. The last session of every
              user may go on; these are replaced by every load

Tracked events have no domain of their own, and a user's domain may still change. So their sets
are kept without one and meet the sets of ``homes`` when a report is made. Users are numbered
domain by domain, so that a customer's users share few bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.localtime import local_date
from ..functions.taxonomy import HEALTH
from ..functions.text import like_prefix
from ..operators.activity import WORKFLOW_PATTERN, drop_noise
from ..operators.bitmaps import NUMBER, user_sets
from ..operators.domains import update_domains
from ..operators.sessions import bursts, continue_sessions
from .generations import Generation, Generations
from .schemas import DOMAINS
from .tables import Tables

PAGE, TRACK, WORKFLOW = "page", "track", "workflow"


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT, _LONG, _NTZ = T.StringType(), T.LongType(), T.TimestampNTZType()
_SET = {"bucket": _LONG, "users": T.BinaryType()}
SCHEMAS = {
    "domains": DOMAINS,
    "numbers": _struct(user_id=_TEXT, **{NUMBER: _LONG}),
    "homes": _struct(domain=_TEXT, **_SET),
    "active": _struct(
        kind=_TEXT, domain=_TEXT, event_date=T.DateType(), **_SET, utc_day=T.DateType()
    ),
    "areas": _struct(area=_TEXT, **_SET, utc_day=T.DateType()),
    "sessions": _struct(
        user_id=_TEXT,
        session_id=_LONG,
        events=_LONG,
        first_ts=_NTZ,
        last_ts=_NTZ,
        last=T.BooleanType(),
    ),
}


@dataclass(frozen=True)
class Stored:
    """The tables of one generation, read lazily, for reports over UTC days up to ``through``."""

    domains: DataFrame
    homes: DataFrame
    active: DataFrame
    areas: DataFrame
    sessions: DataFrame | None
    tz: str
    through: date


class UsageState:
    """The stored state below ``root``; local days are those of ``tz``."""

    def __init__(self, spark: SparkSession, root: str, tz: str = "Asia/Kolkata") -> None:
        self.store, self.tz = Generations(spark, root, SCHEMAS), tz

    def tables(self, generation: Generation | None = None) -> Stored:
        """The latest (or the given) generation. Without any load there is nothing to read."""
        base = generation or self.store.latest()
        if not base.number:
            raise ValueError("nothing is loaded yet")
        self._check(base)
        read = lambda table: self.store.read(table, base)
        sessions = None
        if "late_days" not in base.settings:
            over = read("sessions").filter(~F.col("last"))
            sessions = over.unionByName(self._last_sessions(base)).drop("last")
        through = date.fromisoformat(base.settings["through"])
        homes, active, areas = read("homes"), read("active"), read("areas")
        return Stored(read("domains"), homes, active, areas, sessions, self.tz, through)

    def update(self, t: Tables, through: date, again: Iterable[date] = ()) -> Generation:
        """Take in the UTC days that follow the last load, up to ``through``; publish the result.

        Only these days of ``t`` are read. Days that are in already are not taken twice: if there
        is no new one, nothing happens. Late events of such days come in if the days are named in
        ``again``; sets and lookup merge them exactly. Sessions cannot take back a gap that they
        have seen, so from then on the state has none, until it is built anew. Page views without
        a timestamp count for the lookup only, as they do in a rebuild.

        A load that fails publishes nothing and can be repeated; of two loads at one time the
        second to finish fails with ``Conflict``.
        """
        base = self.store.latest()
        self._check(base)
        mark = base.settings.get("through")
        mark = None if mark is None else date.fromisoformat(mark)
        late = sorted({day for day in again if mark is not None and day <= mark})
        spans = [(day, day) for day in late]
        new_days = mark is None or through > mark
        if new_days:
            spans.append((None if mark is None else mark + timedelta(days=1), through))
        if not spans:
            return base
        load = self.store.new_load()
        pages = _between(t.pages_between, spans)
        tracks = _between(t.tracks_between, spans)
        undated = t.pages.filter(F.col("timestamp").isNull())
        if t.day_column is not None:
            undated = undated.filter(F.col(t.day_column).isNull())

        loads = {table: list(base.loads.get(table, [])) for table in SCHEMAS}
        lookup = update_domains(
            self.store.read("domains", base), _viewed(pages).unionByName(_viewed(undated))
        )
        domains = _large(self._replaced(loads, "domains", load, lookup))
        seen = pages.select("user_id").unionByName(tracks.select("user_id"))
        seen = seen.unionByName(undated.select("user_id"))
        numbers = _large(
            self._added(loads, "numbers", load, self._new_users(base, seen, domains))
        )
        homes = domains.join(numbers, "user_id", "left")
        self._replaced(loads, "homes", load, user_sets(homes, "domain"))
        days = user_sets(
            self._days(pages, tracks).join(numbers, "user_id", "left"),
            *("kind", "domain", "utc_day", "event_date"),
        ).hint("rebalance", F.col("utc_day"))
        self._added(loads, "active", load, days, "utc_day")
        areas = user_sets(_areas(pages).join(numbers, "user_id"), "area", "utc_day")
        self._added(loads, "areas", load, areas.hint("rebalance", F.col("utc_day")), "utc_day")
        settings = {**base.settings, "tz": self.tz}
        if late:
            settings["late_days"] = ",".join(map(str, late))
        if new_days:
            settings["through"] = through.isoformat()
            if "late_days" not in settings:
                self._added(loads, "sessions", load, self._sessions(base, pages, tracks), "last")
        return self.store.publish(base, loads, settings)

    def _check(self, base: Generation) -> None:
        if base.settings.get("tz", self.tz) != self.tz:
            raise ValueError(f"the state is kept for {base.settings['tz']}, not for {self.tz}")

    def _replaced(self, loads: dict, table: str, load: str, rows: DataFrame) -> DataFrame:
        loads[table] = []
        return self._added(loads, table, load, rows)

    def _added(self, loads: dict, table: str, load: str, rows: DataFrame, *by: str) -> DataFrame:
        self.store.write(table, load, rows, *by)
        loads[table].append(load)
        return self.store.read(table, Generation(loads=loads))

    def _new_users(self, base: Generation, seen: DataFrame, domains: DataFrame) -> DataFrame:
        """Users without a number, numbered domain by domain above all numbers given so far."""
        known = _large(self.store.read("numbers", base))
        given = known.agg(F.coalesce(F.max(NUMBER), F.lit(-1))).first()[0]
        return (
            seen.distinct()
            .join(known, "user_id", "left_anti")
            .filter(F.col("user_id").isNotNull())
            .join(domains, "user_id", "left")
            .orderBy("domain", "user_id")
            .select("user_id", (F.monotonically_increasing_id() + given + 1).alias(NUMBER))
        )

    def _days(self, pages: DataFrame, tracks: DataFrame) -> DataFrame:
        """(user_id, kind, domain, utc_day, event_date), every combination once."""
        ts = F.col("timestamp")
        days = [F.to_date(ts).alias("utc_day"), local_date(ts, self.tz).alias("event_date")]
        workflow = like_prefix(F.col("event_text"), WORKFLOW_PATTERN)
        kind = F.when(workflow, WORKFLOW).otherwise(TRACK)
        kept = drop_noise(tracks, include_workflows=True).filter(F.col("user_id").isNotNull())
        events = kept.select(
            "user_id", kind.alias("kind"), F.lit(None).cast("string").alias("domain"), *days
        )
        views = pages.select("user_id", F.lit(PAGE).alias("kind"), "domain", *days)
        return views.unionByName(events).distinct()

    def _last_sessions(self, base: Generation) -> DataFrame:
        newest = replace(base, loads={"sessions": base.loads["sessions"][-1:]} if base.loads else {})
        return self.store.read("sessions", newest).filter("last")

    def _sessions(self, base: Generation, pages: DataFrame, tracks: DataFrame) -> DataFrame:
        """The last sessions so far, continued, and those after them."""
        stream = [
            rows.select("user_id", F.col("timestamp").alias("ts"))
            for rows in (pages, drop_noise(tracks))
        ]
        slots = bursts(stream[0].unionByName(stream[1]))
        last = F.col("session_id") == F.max("session_id").over(W.partitionBy("user_id"))
        return continue_sessions(self._last_sessions(base), slots).withColumn("last", last)


def _areas(pages: DataFrame) -> DataFrame:
    """(user_id, area, utc_day), every combination once; a page may belong to several areas."""
    name = F.col("name")
    of_page = F.array_compact(
        F.array(*[F.when(rule.matches(name), F.lit(rule.label)) for rule in HEALTH.pages])
    )
    return (
        pages.filter(name.isNotNull() & F.col("user_id").isNotNull())
        .select("user_id", F.explode(of_page).alias("area"), F.to_date("timestamp").alias("utc_day"))
        .distinct()
    )


def _large(users: DataFrame) -> DataFrame:
    """A table with a row per user: it grows with the input, so no join broadcasts it.

    Its files may be small enough for Spark to choose that, but every join of every load would
    send it through the driver.
    """
    return users.hint("merge")


def _viewed(pages: DataFrame) -> DataFrame:
    return pages.select("user_id", "domain")


def _between(rows_between, spans: list[tuple[date | None, date]]) -> DataFrame:
    """The rows of the given UTC days."""
    midnight = lambda day: datetime.combine(day, time())
    parts = [
        rows_between(None if first is None else midnight(first), midnight(last + timedelta(days=1)))
        for first, last in spans
    ]
    return reduce(DataFrame.unionByName, parts)
