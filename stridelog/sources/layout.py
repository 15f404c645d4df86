"""Storage layout for the two event tables at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_COLUMN = "event_day"


def write_events(events: DataFrame, path: str, sort_by: tuple[str, ...] = ("user_id",)) -> None:
    """Write page views or tracked events partitioned by UTC day.

    The rebalance hint lets adaptive execution split a hot day over several tasks and pack
    quiet days together, so file sizes stay even. Sorting within a task (by domain and user
    for page views) gives tight row-group ranges, so domain filters skip most of a file.
    """
    (
        events.withColumn(DAY_COLUMN, F.to_date("timestamp"))
        .hint("rebalance", F.col(DAY_COLUMN))
        .sortWithinPartitions(DAY_COLUMN, *sort_by)
        .write.partitionBy(DAY_COLUMN)
        .parquet(path)
    )


def write_domains(domains: DataFrame, path: str) -> None:
    """Write the (user_id, domain) lookup so that reports need not rebuild it."""
    domains.write.parquet(path)


def save_bucketed(
    events: DataFrame, table: str, buckets: int, path: str | None = None, by_day: bool = False
) -> None:
    """Save page views, tracked events or the lookup as a catalog table bucketed by user.

    A user's rows all lie in one of ``buckets`` files (per day with ``by_day``). Tables with one
    number of buckets are rolled up by user and joined on the user without a shuffle: the roll-up
    of events, the lookup and their join read bucket by bucket. Rows are dealt to the buckets
    before they are written, so there is one file a bucket and not one a task and bucket; choose
    ``buckets`` so that one holds about a gigabyte. A heavy user's bucket stays large, so this
    suits tables without such users.
    """
    if by_day:
        events = events.withColumn(DAY_COLUMN, F.to_date("timestamp"))
    writer = events.repartition(buckets, "user_id").write.bucketBy(buckets, "user_id").sortBy("user_id")
    if by_day:
        writer = writer.partitionBy(DAY_COLUMN)
    if path is not None:
        writer = writer.option("path", path)
    writer.format("parquet").saveAsTable(table)
