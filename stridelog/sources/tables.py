"""The three input tables, checked once and read lazily."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import ntz
from . import schemas


@dataclass(frozen=True)
class Tables:
    """Page views, tracked events and user snapshots.

    ``day_column`` names a DATE partition column holding the UTC day of ``timestamp`` (see
    ``layout.write_events``); when set, time bounds also prune partitions.
    ``domains`` may hold a maintained (user_id, domain) table equal to
    ``operators.domains.user_domains(pages)`` (see ``operators.domains.update_domains``); reports
    then skip that full-history scan.

    A column that the reports need must be there, and every known column must have its type;
    columns that only the semantic model knows are NULL where a table lacks them.
    """

    pages: DataFrame
    tracks: DataFrame
    users: DataFrame
    day_column: str | None = None
    domains: DataFrame | None = None

    def __post_init__(self) -> None:
        for name in ("pages", "tracks", "users"):
            checked = _checked(name, getattr(self, name), getattr(schemas, name.upper()))
            object.__setattr__(self, name, checked)
        if self.domains is not None:
            object.__setattr__(self, "domains", _checked("domains", self.domains, schemas.DOMAINS))

    @classmethod
    def from_parquet(
        cls,
        spark: SparkSession,
        root: str,
        day_column: str | None = None,
        domains: bool = False,
    ) -> Tables:
        """Read ``{root}/pages``, ``{root}/tracks``, ``{root}/users``, and ``{root}/domains`` if asked.

        The schemas come from the files, so a missing, renamed or mistyped column is an error
        and never an empty report.
        """
        read = lambda name: spark.read.parquet(f"{root}/{name}")
        lookup = read("domains") if domains else None
        return cls(read("pages"), read("tracks"), read("users"), day_column, lookup)

    @classmethod
    def from_catalog(
        cls,
        spark: SparkSession,
        database: str,
        day_column: str | None = None,
        domains: bool = False,
    ) -> Tables:
        """Read the tables ``pages``, ``tracks``, ``users`` (and ``domains``) of a database."""
        read = lambda name: spark.table(f"{database}.{name}")
        lookup = read("domains") if domains else None
        return cls(read("pages"), read("tracks"), read("users"), day_column, lookup)

    def pages_between(self, start: datetime | None, end: datetime | None = None) -> DataFrame:
        return self._between(self.pages, start, end)

    def tracks_between(self, start: datetime | None, end: datetime | None = None) -> DataFrame:
        return self._between(self.tracks, start, end)

    def _between(
        self, rows: DataFrame, start: datetime | None, end: datetime | None
    ) -> DataFrame:
        if start is not None:
            rows = rows.filter(F.col("timestamp") >= ntz(start))
        if end is not None:
            rows = rows.filter(F.col("timestamp") < ntz(end))
        if self.day_column is not None:
            if start is not None:
                rows = rows.filter(F.col(self.day_column) >= F.lit(start.date()))
            if end is not None:
                rows = rows.filter(F.col(self.day_column) <= F.lit(end.date()))
        return rows


def _checked(name: str, frame: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with every column of ``schema``; ValueError or TypeError if it does not fit."""
    found = {field.name: field.dataType for field in frame.schema}
    missing = schemas.REQUIRED[name] - found.keys()
    if missing:
        raise ValueError(f"{name}: missing columns {sorted(missing)}")
    absent = {}
    for field in schema:
        if field.name not in found:
            absent[field.name] = F.lit(None).cast(field.dataType)
        elif found[field.name] != field.dataType:
            raise TypeError(
                f"{name}.{field.name}: expected {field.dataType.simpleString()}, "
                f"found {found[field.name].simpleString()}"
            )
    return frame.withColumns(absent) if absent else frame
