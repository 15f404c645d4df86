"""Exact rounding and date differences that count boundaries.

Ratios are rounded half away from zero in integer arithmetic and turned into DOUBLE last.
Rounding a DOUBLE instead gives engine-dependent answers near a half (1.005 to two places).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"

# Decimal places kept by the division itself before the outer rounding. The reports define
# their percentages in exact decimals: an integer divided by an integer keeps six places,
# and a numerator with one decimal place ("100.0 *") keeps seven.
INT_DIVISION = 6
PCT_DIVISION = 7


def half_up(num: Column, den: Column | int) -> Column:
    """num / den to the nearest BIGINT, halves away from zero; NULL if den is 0 or NULL."""
    num = num.cast(_WIDE)
    den = F.nullif(den.cast(_WIDE) if isinstance(den, Column) else _wide(den), _wide(0))
    magnitude = F.call_function("div", F.abs(num) * _wide(2) + den, den * _wide(2))
    return F.when(num < _wide(0), -magnitude).otherwise(magnitude)


def ratio(
    num: Column, den: Column, scale: int, factor: int = 1, division: int | None = None
) -> Column:
    """factor * num / den rounded to ``scale`` places, as DOUBLE; ``den`` must be >= 0."""
    if division is None:
        return half_up(num.cast(_WIDE) * _wide(factor * 10**scale), den) / F.lit(10.0**scale)
    kept = half_up(num.cast(_WIDE) * _wide(factor * 10**division), den)
    return half_up(kept, 10 ** (division - scale)) / F.lit(10.0**scale)


def pct(num: Column, den: Column) -> Column:
    """Percentage with one decimal place."""
    return ratio(num, den, scale=1, factor=100, division=PCT_DIVISION)


def mean(total: Column, n: Column, scale: int = 1) -> Column:
    """Average of integers given their sum and count, rounded to ``scale`` places."""
    return ratio(total, n, scale=scale, division=INT_DIVISION)


def round_half_up(value: Column, scale: int) -> Column:
    """Round a non-negative DOUBLE with plain IEEE steps, the same in any engine."""
    power = 10.0**scale
    return F.floor(value * F.lit(power) + F.lit(0.5)) / F.lit(power)


def seconds_between(earlier: Column, later: Column) -> Column:
    """Second boundaries crossed between two zone-free timestamps."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def minutes_between(earlier: Column, later: Column) -> Column:
    """Minute boundaries crossed: 10:00:59 to 10:01:00 is 1."""
    return _epoch_minute(later) - _epoch_minute(earlier)


def months_between(earlier: Column, later: Column) -> Column:
    """Month boundaries crossed: Jan 31 to Feb 1 is 1."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def ntz(value: datetime) -> Column:
    """Zone-free timestamp literal; folds to a constant, so filters on it reach the scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _epoch_minute(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / F.lit(60))


def _wide(value: int) -> Column:
    return F.lit(value).cast(_WIDE)
