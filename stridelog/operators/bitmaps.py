"""Sets of users as bitmaps: exact distinct counts that can be merged.

A user has a number; the numbers of a bucket share a bitmap of 4 KB. A missing user has none: its
rows have a NULL bucket and an empty bitmap, which keeps the group and counts nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = "number"


def user_sets(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, bucket, users) from rows with the ``number`` of a user."""
    bucket = F.bitmap_bucket_number(NUMBER).alias("bucket")
    return rows.groupBy(*keys, bucket).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias("users")
    )


def united(sets: DataFrame, *keys: str) -> DataFrame:
    """The union of the sets of each group of ``keys``."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def common(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The intersections of all sets of ``left`` and ``right`` in a bucket; none that is empty.

    ``keys`` are the columns of both sides that name a set, all different.
    """
    pairs = left.join(right.withColumnRenamed("users", "others"), "bucket").select(
        *keys, "bucket", F.explode(F.array("users", "others")).alias("users")
    )
    both = pairs.groupBy(*keys, "bucket").agg(F.bitmap_and_agg("users").alias("users"))
    return both.filter(F.bitmap_count("users") > 0)


def size():
    """Users of a bitmap column named ``users``."""
    return F.bitmap_count("users")
