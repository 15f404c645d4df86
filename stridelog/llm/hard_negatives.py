"""Hard negatives, found by rotated one-bit codes and intervals that hold every product.

A vector o is rotated (signs flipped and Hadamard transform, three times) and split into its part
along its own sign vector c, of length 1, and the rest: o = a c + r. Stored are the bits of c, the
alignment a and the length of r. For an anchor q, <q, c> comes from bits too: q is rounded to a few
bits a component, so that the product is a weighted sum of popcounts of its bit planes with the
code, off by at most the stored rounding error. As r is orthogonal to c, <q, r> is at most the
length of r times that of q's part orthogonal to c (Cauchy-Schwarz). So every product lies in a
known interval; rows whose interval cannot matter are passed over, all others are scored in
integers.

Two sweeps over all rows: the first finds each anchor's positives, the second the negatives of
each (anchor, positive). Rows are dealt to shards by hash, whatever their label, so that a label
with most of the rows is no larger task than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .vectors import (
    LEAST,
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

#: Squared length of a vector, so that 100 times a product fits 64 bits.
LONGEST = 2.0**56
ANCHOR_ROWS = 1024
#: Rows that meet the thresholds of one task's anchors at a time.
CHUNK = 1024
#: Bits a component of a rotated anchor.
PLANES = 6
ROUNDS = 3
#: Rounding in the rotation and the interval, as a share of the product of the lengths.
SLACK = 1e-9

ENCODED = (
    "row bigint, vec_id bigint, label bigint, vector array<int>, "
    "code binary, align double, rest double"
)
POSITIVES = "anchor bigint, row bigint, vec_id bigint, score bigint"
NEGATIVES = "anchor bigint, nth int, row bigint, vec_id bigint, score bigint"


def _schema(*names: str) -> pa.Schema:
    kinds = {"nth": pa.int32()}
    return pa.schema([(name, kinds.get(name, pa.int64())) for name in names])


def rotated(vectors: np.ndarray) -> np.ndarray:
    """An orthogonal transform of the rows, the same on every machine.

    The width is filled up to a power of two, at least 8.
    """
    width = max(8, 1 << max(0, vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), width))
    out[:, : vectors.shape[1]] = vectors
    signs = np.random.Generator(np.random.PCG64(11)).integers(0, 2, (ROUNDS, width)) * 2 - 1
    for sign in signs:
        out *= sign
        half = 1
        while half < width:
            pairs = out.reshape(len(out), width // (2 * half), 2, half)
            out = np.stack(
                (pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2
            ).reshape(len(out), width)
            half *= 2
        out /= np.sqrt(width)
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate((packed, np.zeros((*packed.shape[:-1], short), np.uint8)), axis=-1)
    return np.ascontiguousarray(packed).view("<u8")


def encoded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, alignments and lengths of the rest of integer vectors."""
    turned = rotated(vectors)
    align = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum(0.0, squares - align**2))
    return words(turned >= 0), align, rest


class Anchors:
    """Anchors prepared for estimates: bit planes, their scale and rounding error, lengths."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        turned = rotated(vectors)
        self.width = turned.shape[1]
        self.length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        middle = (1 << PLANES - 1) - 1
        self.step = np.abs(turned).max(axis=1, initial=0.0) / middle
        self.step[self.step == 0] = 1.0
        whole = np.rint(turned / self.step[:, None])
        self.middle, self.total = middle, whole.sum(axis=1)
        self.off = np.abs(turned - whole * self.step[:, None]).sum(axis=1) / np.sqrt(self.width)
        raised = (whole + middle).astype(np.int64)
        self.planes = [words((raised >> bit) & 1 == 1) for bit in range(PLANES)]

    def intervals(
        self, code: np.ndarray, align: np.ndarray, rest: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the products of all anchors with all coded rows."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        raised = np.zeros((len(self.vectors), len(code)))
        for bit, plane in enumerate(self.planes):
            for word in range(code.shape[1]):
                both = np.bitwise_count(plane[:, None, word] & code[:, word])
                raised += both * float(1 << bit)
        signed = 2.0 * (raised - self.middle * ones) - self.total[:, None]
        along = signed * (self.step / np.sqrt(self.width))[:, None]
        across = np.maximum(0.0, np.abs(along) - self.off[:, None])
        across = np.sqrt(np.maximum(0.0, self.length[:, None] ** 2 - across**2))
        norms = np.sqrt(align**2 + rest**2)
        wide = align * self.off[:, None] + rest * across + SLACK * norms * self.length[:, None]
        return align * along - wide, align * along + wide


def _encode(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.table(batch)
        code, align, rest = encoded(matrix(table["vector"], width))
        columns = [table[c] for c in ("row", "vec_id", "label", "vector")]
        made = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(align), pa.array(rest)]
        names = ["row", "vec_id", "label", "vector", "code", "align", "rest"]
        yield from pa.table([*columns, *made], names).to_batches()


class _Rows:
    """The rows of a shard as arrays, in chunks."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.row = ints(table["row"])
        self.vectors = matrix(table["vector"], width)
        self.label = ints(table["label"])
        codes = table["code"].combine_chunks()
        self.code = np.frombuffer(b"".join(codes.to_pylist()), "<u8").reshape(len(self.row), -1)
        self.align, self.rest = table["align"].to_numpy(), table["rest"].to_numpy()
        self.ties = tie_ranks(table["vec_id"], self.row)

    def survivors(
        self, anchors: Anchors, wanted: Iterator
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of the pairs whose interval ``wanted`` lets pass, by chunks."""
        for start in range(0, len(self.row), CHUNK):
            part = slice(start, start + CHUNK)
            low, high = anchors.intervals(self.code[part], self.align[part], self.rest[part])
            passed = wanted(low, high, part)
            at, there = np.flatnonzero(passed.any(axis=1)), np.flatnonzero(passed.any(axis=0))
            scores = products(anchors.vectors[at], self.vectors[part][there])
            i, j = np.nonzero(passed[np.ix_(at, there)])
            yield at[i], start + there[j], scores[i, j]


def _taken(table: pa.Table, best: Best, first: dict[str, pa.Array]) -> pa.Table:
    place = pa.array(best.place)
    columns = {"row": table["row"].take(place), "vec_id": table["vec_id"].take(place)}
    return pa.table({**first, **columns, "score": pa.array(best.score, pa.int64())})


def _positives(points: pa.Table, asked: pa.Table, width: int, k: int) -> pa.Table:
    """The ``k`` best rows of an anchor's own label in one shard."""
    if not len(points) or not len(asked):
        return _schema("anchor", "row", "vec_id", "score").empty_table()
    rows, anchors = _Rows(points, width), Anchors(matrix(asked["vector"], width))
    own, label = ints(asked["row"]), ints(asked["label"])
    best = Best(k, np.full(len(own), LEAST))

    def wanted(low, high, part):
        same = label[:, None] == rows.label[part]
        return same & (own[:, None] != rows.row[part]) & (high >= best.least[:, None])

    for anchor, place, score in rows.survivors(anchors, wanted):
        best.add(anchor, score, rows.ties[place], place)
    return _taken(points, best, {"anchor": asked["row"].take(pa.array(best.query))})


def _negatives(points: pa.Table, asked: pa.Table, width: int, k: int, low_pct: int, high_pct: int):
    """The ``k`` best rows of other labels in one shard, for each positive of an anchor.

    Every (anchor, positive) is one query of ``best``, with the range its scores must lie in.
    """
    if not len(points) or not len(asked):
        return _schema("anchor", "nth", "row", "vec_id", "score").empty_table()
    rows, anchors = _Rows(points, width), Anchors(matrix(asked["vector"], width))
    own, label = ints(asked["row"]), ints(asked["label"])
    lists = asked["positives"].combine_chunks()
    starts = lists.offsets.to_numpy()
    counts = np.diff(starts)
    positive = lists.flatten().to_numpy()
    low_score = -(-(low_pct * positive) // 100)  # rounded up
    high_score = high_pct * positive // 100
    best = Best(k, low_score)

    def wanted(low, high, part):
        least = np.minimum.reduceat(best.least, starts[:-1])
        most = np.maximum.reduceat(high_score, starts[:-1])
        other = label[:, None] != rows.label[part]
        return other & (high >= least[:, None]) & (low <= most[:, None])

    for anchor, place, score in rows.survivors(anchors, wanted):
        for nth in range(int(counts.max())):
            has = counts[anchor] > nth
            query = starts[anchor[has]] + nth
            inside = score[has] <= high_score[query]
            found = place[has][inside]
            best.add(query[inside], score[has][inside], rows.ties[found], found)
    anchor = np.searchsorted(starts, best.query, side="right") - 1
    first = {
        "anchor": pa.array(own[anchor]),
        "nth": pa.array(best.query - starts[anchor], pa.int32()),
    }
    return _taken(points, best, first)


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    label: Column,
    scale: int,
    positives: int = 5,
    negatives: int = 10,
    low_pct: int = 30,
    high_pct: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor, anchor_id, positive, positive_id, positive_score, rank, negative_id, negative_score).

    Anchors are the rows for which ``is_anchor`` holds (NULL: does not); ``label`` is the label to
    go by. Both are in terms of the columns vec_id and label. An anchor's positives are its
    ``positives`` best other rows of its label, by inner product in integers floor(scale * x),
    ties by smaller id (NULL last, then any of the rows sharing it). The negatives of a positive
    with score s are the ``negatives`` best rows of other labels whose score is at least
    ``low_pct`` and at most ``high_pct`` percent of s; a negative s leaves none. Rows without a
    label and vectors that ``integer_vectors`` cannot take have no part. Anchors without positives
    and positives without negatives give no rows; so does an empty table. ``anchor`` and
    ``positive`` number rows of the table, which tells apart those with one id.
    """
    labelled = table.select(
        F.col(id_col).alias("vec_id"),
        F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).alias("vector"),
    ).withColumn("label", label)
    rows = integer_vectors(
        labelled.filter(F.col("label").isNotNull()),
        scale,
        "label",
        vector_col="vector",
        longest=LONGEST,
    )
    anchor = F.coalesce(is_anchor, F.lit(False))
    n, asked, width = rows.agg(
        F.count(F.lit(1)), F.count_if(anchor), F.coalesce(F.max(F.size("vector")), F.lit(0))
    ).first()
    coded = staged(rows.mapInArrow(lambda batches: _encode(batches, width), ENCODED), "codes")
    points = dealt(coded, "shard", n, SHARD_ROWS)
    points = spread(points, "part", asked, ANCHOR_ROWS).groupBy("shard", "part")
    anchors = dealt(rows.filter(anchor), "part", asked, ANCHOR_ROWS)

    found = points.cogroup(
        spread(anchors, "shard", n, SHARD_ROWS).groupBy("shard", "part")
    ).applyInArrow(lambda left, right: _positives(left, right, width, positives), POSITIVES)
    pairs = staged(
        best_per(found, ["anchor"], positives).select(
            "anchor",
            (F.col("rank") - 1).alias("nth"),
            F.col("row").alias("positive"),
            F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        "positives",
    )
    scores = pairs.groupBy(F.col("anchor").alias("row")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("nth", "positive_score"))),
            lambda pair: pair["positive_score"],
        ).alias("positives")
    )
    asking = anchors.join(scores, "row")
    found = points.cogroup(
        spread(asking, "shard", n, SHARD_ROWS).groupBy("shard", "part")
    ).applyInArrow(
        lambda left, right: _negatives(left, right, width, negatives, low_pct, high_pct), NEGATIVES
    )
    ranked = best_per(found, ["anchor", "nth"], negatives).select(
        "anchor",
        "nth",
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(pairs, ["anchor", "nth"]).join(named, "anchor").drop("nth")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; ids divisible by 7 have the next label of ten."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(table, F.col("vec_id") % 100 == 0, moved, scale=256)
    return found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


SQL = {
    "op11_hard_negatives": """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, o.r, o.vec_id, a.label = o.label AS same,
         CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM whole a JOIN whole o ON a.r <> o.r
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor, anchor_id, r AS positive, vec_id AS positive_id, score AS positive_score
  FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score,
         n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (
           PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r
         ) AS rank
  FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
  WHERE 100 * n.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id,
       positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
}
