"""Integer vectors: reading them from a table, exact products, and the best rows of each query."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Squared length that a vector of integers may have, so that every product fits 64 bits.
LONGEST = 2.0**62
#: Expected rows of a shard, and queries that meet it in one task. A task holds no more, at any
#: size of the table; the numbers of shards and of query parts follow the counts.
SHARD_ROWS = 8192
QUERY_ROWS = 4096
#: Below every product: what a query asks for before it has found anything.
LEAST = np.iinfo(np.int64).min
#: Sums of products stay exact in floating point below this.
EXACT = 2.0**53


def integer_vectors(
    table: DataFrame,
    scale: int,
    *columns: str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    longest: float = LONGEST,
) -> DataFrame:
    """(row, vec_id, *columns, vector): every component x as floor(scale * x), x as double.

    ``row`` numbers the rows, so that repeated and NULL ids stay apart; the result is staged.
    Vectors that are NULL, hold a NULL or non-finite component, or whose products would not fit
    64 bits (a component beyond 32 bits, or a squared length of ``longest``) are left out. Other
    columns of ``table`` are not read.
    """
    times = lambda x: F.lit(float(scale)) * x.cast("double")
    small = lambda x: F.coalesce(F.abs(times(x)) < 2.0**31 - 1, F.lit(False))
    squares = F.aggregate(
        "vector", F.lit(0.0), lambda total, x: total + F.pow(times(x), F.lit(2.0))
    )
    fits = F.when(F.forall("vector", small), squares < longest).otherwise(False)
    rows = table.select(
        F.col(id_col).cast("bigint").alias("vec_id"), *columns, F.col(vector_col).alias("vector")
    )
    whole = F.transform("vector", lambda x: F.floor(times(x)).cast("int"))
    return staged(
        rows.filter(F.col("vector").isNotNull() & fits).select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            *columns,
            whole.alias("vector"),
        ),
        "vectors",
    )


def dealt(rows: DataFrame, name: str, count: int, size: int) -> DataFrame:
    """``rows`` with a number (column ``name``) below ceil(count / size), even by hash of ``row``."""
    parts = max(1, math.ceil(count / size))
    return rows.withColumn(name, F.pmod(F.xxhash64("row", F.lit(name)), F.lit(parts)).cast("int"))


def spread(rows: DataFrame, name: str, count: int, size: int) -> DataFrame:
    """``rows`` repeated once for every number that ``dealt`` gives out."""
    parts = max(1, math.ceil(count / size))
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width`` columns; shorter ones count as filled up with 0."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # a table without rows
        return np.zeros((0, width), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(lists) * width:
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def ints(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy()


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices.

    By floating point where no sum can round, else in 64-bit integers, whose wrapped sums end
    right because the products themselves fit.
    """
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if most * left.shape[1] < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def tie_ranks(ids: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """Places in the order in which ties are broken: smaller id, NULL last, then row number."""
    missing = ids.is_null().to_numpy()
    order = np.lexsort((rows, ints(ids), missing))
    ranks = np.empty(len(rows), np.int64)
    ranks[order] = np.arange(len(rows))
    return ranks


class Best:
    """The ``k`` best (score, then tie rank) candidates of each of ``m`` queries.

    ``least`` is the score a candidate needs: the k-th best so far, or what was known before.
    """

    def __init__(self, k: int, floors: np.ndarray) -> None:
        self.k = k
        self.least = floors.copy()
        self.query = self.score = self.tie = self.place = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, tie: np.ndarray, place: np.ndarray) -> None:
        wanted = score >= self.least[query]
        if not wanted.any():
            return
        query = np.concatenate((self.query, query[wanted]))
        score = np.concatenate((self.score, score[wanted]))
        tie = np.concatenate((self.tie, tie[wanted]))
        place = np.concatenate((self.place, place[wanted]))
        order = np.lexsort((tie, -score, query))
        sorted_query = query[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        last = order[nth == self.k - 1]
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        kept = order[nth < self.k]
        self.query, self.score = query[kept], score[kept]
        self.tie, self.place = tie[kept], place[kept]


def best_per(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows (…, score, vec_id, row) ranked within ``keys``, only the first ``k``."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
