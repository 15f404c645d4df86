"""Look-ups for rows of which one key may own a large share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it owns more than one in so many rows, so fewer than that can be heavy.
SHARE = 1000
#: Parts that the rows of heavy keys are dealt to.
SPREAD = 1024


def spread_lookup(rows: DataFrame, lookup: DataFrame, key: str, deal: Column) -> DataFrame:
    """``rows`` with the columns of ``lookup``, NULL where the key is not in it.

    ``lookup`` has at most one row per key; a NULL key is in none. Heavy keys are found by a count
    over the rows' keys alone. At most ``SHARE`` keys can be heavy, so their look-up rows are
    broadcast, and rows with such a key take their values from there. In the join with the rest
    of the look-up they have no partner; they are dealt out evenly by ``deal``, any expression
    that differs between rows of one key, as rows without a key are. So no task gets more than its
    share of the rows, with or without adaptive execution.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    total = counts.agg(F.sum("__rows").alias("__total"))
    heavy = counts.join(F.broadcast(total)).filter(F.col("__rows") * SHARE > F.col("__total"))
    values = [c for c in lookup.columns if c != key]
    found = heavy.filter(F.col(key).isNotNull()).select(key).join(lookup, key, "left")
    names = {c: f"__heavy_{c}" for c in values}
    found = found.withColumnsRenamed(names).withColumn("__heavy", F.lit(True))
    apart = F.col("__heavy").isNotNull() | F.col(key).isNull()
    # One key of both parts: a part that is constant on one side would not be dealt by.
    part = F.when(apart, F.pmod(F.xxhash64(deal), F.lit(SPREAD)) + 1).otherwise(F.lit(0))
    dealt = F.struct(part.alias("part"), F.when(~apart, F.col(key)).alias("key"))
    marked = rows.join(F.broadcast(found), key, "left").withColumn("__dealt", dealt)
    whole = F.struct(F.lit(0).cast("bigint").alias("part"), F.col(key).alias("key"))
    rest = lookup.withColumn("__dealt", whole).drop(key)
    return marked.join(rest, "__dealt", "left").select(
        *rows.columns, *[F.coalesce(names[c], c).alias(c) for c in values]
    )
