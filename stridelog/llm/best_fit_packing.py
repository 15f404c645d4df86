"""Best-fit packing planned on the histogram of lengths, not on documents."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged, texts
from .vocabulary import encoder

#: Pieces of one length that get their ranks in one window.
RANKED_TOGETHER = 1000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = "length bigint, first_rank bigint, n bigint, first_sequence bigint, offset bigint"


def plan_best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots for ``histogram[length]`` pieces of each length in sequences of ``size`` tokens.

    Best-fit decreasing: longest pieces first, each into the fullest sequence that still has
    room. Sequences with equal room are handled as intervals of sequence numbers. A row
    (length, first_rank, n, first_sequence, offset) says that the pieces of that length with
    ranks from first_rank on go to n sequences from first_sequence on, at that offset.

    The number of rows depends on ``size`` alone: a length splits at most one interval and opens
    at most two, so there are at most 3 * size intervals, and each placement into an
    interval takes room that it has only once. For 4096 tokens a few thousand rows are usual.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0

    def add(room: int, first: int, n: int) -> None:
        if room > 0:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room = size
                first, n = opened, -(-left // (size // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                rows.append((length, rank + j * full, full, first, size - room + j * length))
            rank, left = rank + full * each, left - full * each
            add(room - each * length, first, full) if full else None
            first, n = first + full, n - full
            if n and left:  # the last sequence of this length gets what is left
                for j in range(left):
                    rows.append((length, rank + j, 1, first, size - room + j * length))
                add(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            if n:
                add(room, first, n)
    return rows


def best_fit_packing(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    size: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: its place in a sequence of at most ``size`` tokens.

    A document is the ids of its text followed by ``end_id``; a NULL or empty text is ``end_id``
    alone. Longer documents are cut into pieces of ``size`` tokens, the last one shorter. Rows
    with equal or NULL ids are documents of their own. No row is lost, an empty input gives an
    empty result, and other columns of ``docs`` are not read.

    Only lengths are counted for the plan: at most ``size`` counts reach the driver. Pieces get
    a rank within their length from buckets of about ``RANKED_TOGETHER`` and take their slot by
    joining on it; the plan is broadcast because its size depends on ``size`` alone.
    """
    spark = docs.sparkSession
    pieces = staged(
        texts(docs, id_col, text_col)
        .select("doc_id", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_pieces(vocabulary, end_id, size), PIECES)
        .withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_best_fit(counts, size), PLAN)
    widths = [(n, -(-c // RANKED_TOGETHER)) for n, c in counts.items()]
    widths = F.broadcast(spark.createDataFrame(widths, "length bigint, buckets bigint"))
    dealt = pieces.join(widths, "length").withColumn(
        "bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))
    )
    below = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = (
        dealt.withColumn("nth", F.row_number().over(within) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("nth"))
    )
    slot = F.broadcast(plan.withColumnRenamed("length", "slot_length"))
    behind = F.col("rank") - F.col("first_rank")
    return ranked.join(
        slot, (F.col("length") == F.col("slot_length")) & (behind >= 0) & (behind < F.col("n"))
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + behind).alias("sequence_id"), "offset",
    )


def _pieces(vocabulary: str, end_id: int, size: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
         ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(words.encode(text.as_py()), end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return cut


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return best_fit_packing(documents(spark, sf_dir), vocabulary, end_id=1, size=4096)
