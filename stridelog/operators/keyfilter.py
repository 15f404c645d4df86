"""Leaving out rows whose key cannot match, before they are rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter. They travel as at most BITS / 64 rows of two numbers (1 MB), whatever the
#: number of keys; with more keys than bits the filter lets everything pass.
BITS = 1 << 22


def possible_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``keys``; NULL never is.

    A Bloom filter with one hash: every key that occurs sets a bit, and rows pass if theirs is
    set. Rows of other keys may pass, so an exact join must follow; this one only keeps the rest
    of the table out of the aggregate and the shuffle in front of it. No row is moved: the bits are
    broadcast, in 64-bit words, and their size is fixed.
    """
    hashed = F.xxhash64(column).bitwiseAND(F.lit(BITS - 1))
    word = F.shiftright(hashed, 6).alias("__word")
    bit = lambda: F.expr("shiftleft(1L, CAST(__hash & 63 AS INT))")
    words = (
        keys.filter(F.col(column).isNotNull())
        .select(word, hashed.alias("__hash"))
        .groupBy("__word")
        .agg(F.bit_or(bit()).alias("__bits"))
    )
    return (
        rows.filter(F.col(column).isNotNull())
        .withColumn("__hash", hashed)
        .withColumn("__word", F.shiftright("__hash", 6))
        .join(F.broadcast(words), "__word")
        .filter(F.col("__bits").bitwiseAND(bit()) != 0)
        .drop("__word", "__hash", "__bits")
    )
