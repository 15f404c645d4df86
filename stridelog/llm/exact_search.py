"""Exact top-k search by inner product with KD-trees per shard.

Rows are dealt to shards by hash, so that equal vectors and clusters spread evenly. Each shard's
tree splits at the median of the widest dimension and keeps a tight box for every node. No row in
a box can have a greater product with a query than the sum of the better corner's terms; a
best-first traversal opens the node of greatest bound and ends when no bound reaches the k-th
score. Queries search the shard they lie in first; their k-th score there is the start for all
other shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .vectors import (
    LEAST,
    QUERY_ROWS,
    SHARD_ROWS,
    Best,
    best_per,
    dealt,
    integer_vectors,
    ints,
    matrix,
    products,
    spread,
    tie_ranks,
)

LEAF_ROWS = 256
FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
NOTHING = pa.schema([(c, pa.int64()) for c in ("query", "query_id", "row", "vec_id", "score")])
#: Rounding of a bound, as a share of the greatest sum it can be.
SLACK = 1e-12


class KDTree:
    """A tree over the rows of an integer matrix; nodes are numbered from the root, 0."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.points = points
        self.order = np.arange(len(points))
        lows, highs, spans, children = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            rows = points[self.order[start:stop]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            node = len(spans)
            lows.append(low)
            highs.append(high)
            spans.append((start, stop))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if stop - start > leaf_rows:
                axis = int((high - low).argmax())
                middle = (stop - start) // 2
                halves = np.argpartition(rows[:, axis], middle)
                self.order[start:stop] = self.order[start:stop][halves]
                todo.append((start, start + middle, node, 0))
                todo.append((start + middle, stop, node, 1))
        self.lows, self.highs = np.array(lows, np.float64), np.array(highs, np.float64)
        self.spans, self.children = spans, np.array(children)

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The greatest product that query i can have with a row in the box of node i."""
        corners = np.maximum(queries * self.highs[nodes], queries * self.lows[nodes])
        return corners.sum(axis=1) + SLACK * np.abs(corners).sum(axis=1)

    def search(
        self, queries: np.ndarray, own: np.ndarray, ties: np.ndarray, k: int, floors: np.ndarray
    ) -> Best:
        """The ``k`` best rows of each query that reach its floor; ``own`` (-1: none) is no match.

        All queries take one step of their own best-first traversal at a time, so that those
        which stand at the same leaf are scored together.
        """
        best = Best(k, floors)
        exact = queries.astype(np.float64)
        frontier = np.full((len(queries), len(self.spans)), -np.inf)
        everyone = np.arange(len(queries))
        frontier[:, 0] = self.bounds(exact, np.zeros(len(queries), int))
        active = everyone
        while len(active):
            node = frontier[active].argmax(axis=1)
            bound = frontier[active, node]
            going = (bound >= best.least[active]) & (bound > -np.inf)
            active, node = active[going], node[going]
            frontier[active, node] = -np.inf
            inner = self.children[node, 0] >= 0
            for side in (0, 1):
                child = self.children[node[inner], side]
                frontier[active[inner], child] = self.bounds(exact[active[inner]], child)
            self._score(queries, own, ties, active[~inner], node[~inner], best)
        return best

    def _score(self, queries, own, ties, active, node, best) -> None:
        if not len(active):
            return
        found = []
        order = np.argsort(node, kind="stable")
        active, node = active[order], node[order]
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        for here, stop in zip(starts, [*starts[1:], len(node)], strict=True):
            at = active[here:stop]
            rows = self.order[slice(*self.spans[node[here]])]
            scores = products(queries[at], self.points[rows])
            i, j = np.nonzero((scores >= best.least[at, None]) & (own[at, None] != rows))
            found.append((at[i], scores[i, j], ties[rows[j]], rows[j]))
        best.add(*(np.concatenate(part) for part in zip(*found, strict=True)))


def exact_search(
    table: DataFrame,
    is_query: Column,
    scale: int,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query, query_id, rank, vec_id, score): the ``k`` rows of greatest product with each query.

    ``is_query`` selects the queries among the rows, in terms of ``vec_id`` (NULL is none); every
    row but the query's own is a candidate, rows that repeat its id or vector too. Components
    become floor(scale * x); vectors ``integer_vectors`` cannot take have no part. Ties go to the
    smaller id, NULL after all others, then to any of the rows that share it. A query with fewer
    than ``k`` other rows gets them all; an empty table gives no rows. ``query`` numbers the query
    rows, which tells apart those with one id. Shorter vectors count as filled up with zeros.
    """
    rows = integer_vectors(table, scale, id_col=id_col, vector_col=vector_col)
    rows = rows.withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    n, asked, width = rows.agg(
        F.count(F.lit(1)), F.count_if("is_query"), F.coalesce(F.max(F.size("vector")), F.lit(0))
    ).first()
    points = dealt(rows, "shard", n, SHARD_ROWS)
    at_home = staged(
        points.groupBy("shard").applyInArrow(
            lambda group: _at_home(group, width, k),
            "query bigint, query_id bigint, shard int, least bigint, vector array<int>, "
            "found array<struct<row: bigint, vec_id: bigint, score: bigint>>",
        ),
        "at_home",
    )
    queries = at_home.select("query", "query_id", "least", "vector", F.col("shard").alias("home"))
    queries = dealt(queries.withColumn("row", F.col("query")), "part", asked, QUERY_ROWS)
    queries = spread(queries, "shard", n, SHARD_ROWS).filter(F.col("shard") != F.col("home"))
    points = spread(points.select("row", "vec_id", "vector", "shard"), "part", asked, QUERY_ROWS)
    abroad = (
        points.groupBy("shard", "part")
        .cogroup(queries.drop("row", "home").groupBy("shard", "part"))
        .applyInArrow(lambda left, right: _abroad(left, right, width, k), FOUND)
    )
    found = at_home.select("query", "query_id", F.inline("found")).unionByName(abroad)
    return best_per(found, ["query"], k).select("query", "query_id", "rank", "vec_id", "score")


def _matches(best: Best, points: pa.Table, queries: pa.Table) -> pa.Table:
    at = pa.array(best.place)
    return pa.table(
        {
            "query": queries["query"].take(pa.array(best.query)),
            "query_id": queries["query_id"].take(pa.array(best.query)),
            "row": points["row"].take(at),
            "vec_id": points["vec_id"].take(at),
            "score": pa.array(best.score, pa.int64()),
        }
    )


def _at_home(group: pa.Table, width: int, k: int) -> pa.Table:
    """The search of a shard's own queries: a row per query, with its matches and k-th score."""
    vectors, rows = matrix(group["vector"], width), ints(group["row"])
    own = np.flatnonzero(group["is_query"].to_numpy())
    floors = np.full(len(own), LEAST)
    best = KDTree(vectors).search(vectors[own], own, tie_ranks(group["vec_id"], rows), k, floors)
    named = {"row": "query", "vec_id": "query_id"}
    queries = group.take(pa.array(own))
    queries = queries.rename_columns([named.get(c, c) for c in group.column_names])
    matches = _matches(best, group, queries)
    starts = np.searchsorted(best.query, np.arange(len(own) + 1)).astype(np.int32)
    found = pa.StructArray.from_arrays(
        [matches[c].combine_chunks() for c in ("row", "vec_id", "score")], ["row", "vec_id", "score"]
    )
    columns = {c: queries[c] for c in ("query", "query_id", "shard")}
    columns |= {"least": pa.array(best.least), "vector": queries["vector"]}
    return pa.table(columns | {"found": pa.ListArray.from_arrays(starts, found)})


def _abroad(points: pa.Table, queries: pa.Table, width: int, k: int) -> pa.Table:
    """The search of other shards' queries, from the k-th score they bring along."""
    if not len(points) or not len(queries):
        return NOTHING.empty_table()
    tree = KDTree(matrix(points["vector"], width))
    ties = tie_ranks(points["vec_id"], ints(points["row"]))
    none = np.full(len(queries), -1)
    floors = queries["least"].to_numpy()
    best = tree.search(matrix(queries["vector"], width), none, ties, k, floors)
    return _matches(best, points, queries)


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every query row; queries are the ids divisible by 20."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = exact_search(table, F.col("vec_id") % 20 == 0, scale=64)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = {
    "op13_exact_search": """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score, c.r
  FROM whole q JOIN whole c ON q.r <> c.r
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, r) AS rank
  FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
}
