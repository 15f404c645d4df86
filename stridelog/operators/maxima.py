"""Greatest text values per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extreme = Callable[[str], Column]


def greatest_text(
    rows: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    **also: tuple[str, Extreme],
) -> DataFrame:
    """Maximum of each text column per key, each taken independently.

    A maximum over strings has no hash aggregate in Spark: asked for directly, it sorts every
    input row. So equal rows are collapsed first, by hash and on the map side, and only the
    different ones are sorted. The count, always at least one, is there to keep the two steps
    apart: without it the optimizer sees that the maximum ignores duplicates and drops the
    first step.

    ``also`` are extremes to carry along: name = (column, ``F.min`` or ``F.max``) of a number or
    timestamp. They are taken in the first step and again, under their name, in the second.
    """
    different = (
        rows.groupBy(*keys, *columns)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            *[extreme(column).alias(name) for name, (column, extreme) in also.items()],
        )
        .filter(F.col("__n") >= 1)
    )
    again = [extreme(name).alias(name) for name, (_, extreme) in also.items()]
    return different.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns], *again)
