"""Typed parameters shared by every report."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo


@dataclass(frozen=True)
class Params:
    """Inputs of a report.

    All instants are naive wall-clock values. ``start`` and ``end`` bound the raw UTC
    timestamps (half-open); ``as_of`` is "now" and is never read from the system clock, so
    a report can be rerun for any past day with the same result. ``domain=None`` selects
    every customer, in the reports that allow it.
    """

    as_of: datetime
    start: datetime
    end: datetime | None = None
    domain: str | None = None
    months_back: int = 6
    retention_days: int = 14
    tz: str = "Asia/Kolkata"
    include_workflows: bool = False

    def require_domain(self) -> str:
        if self.domain is None:
            raise ValueError("this report needs a domain")
        return self.domain

    def days_ago(self, days: int) -> datetime:
        return self.as_of - timedelta(days=days)

    def months_ago(self, months: int) -> datetime:
        """``as_of`` moved back by whole months, the day clamped to the month's length."""
        first = self.month_start(-months)
        last_day = calendar.monthrange(first.year, first.month)[1]
        return self.as_of.replace(
            year=first.year, month=first.month, day=min(self.as_of.day, last_day)
        )

    def month_start(self, offset: int = 0) -> datetime:
        """Midnight of the first day of the month ``offset`` months from ``as_of``."""
        index = self.as_of.year * 12 + self.as_of.month - 1 + offset
        return datetime(index // 12, index % 12 + 1, 1)

    def month(self, offset: int = 0) -> date:
        return self.month_start(offset).date()

    def month_start_utc(self, offset: int = 0) -> datetime:
        """The UTC instant at which that month begins in the report's time zone.

        Lets a report filter raw timestamps by local month, which reaches the scan, instead
        of converting every row first.
        """
        local = self.month_start(offset).replace(tzinfo=ZoneInfo(self.tz))
        return local.astimezone(timezone.utc).replace(tzinfo=None)

    @property
    def days_in_month(self) -> int:
        return calendar.monthrange(self.as_of.year, self.as_of.month)[1]
