"""Substring dedup by fixed windows of words, grouped under anchors.

A suffix is the text from one word on. Suffixes that can repeat are found first: every window of
``min_words`` words holds an anchor (the k-gram of words with the lowest hash in it), and equal
windows have equal anchors, so a window whose anchor occurs in one text only cannot repeat. The
suffixes of the other windows are grouped by their anchor: groups that fit a task's memory are
sorted and compared on the window's words, larger ones are split by the hash of the whole window
and aggregated. These windows stand in for suffix trees: what is removed depends on equal windows
alone, so common prefixes longer than a window are not computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, unused

MIN_WORDS = 13
ANCHOR_WORDS = 4
#: Suffixes of one group compared in a task (about 200 bytes each); larger groups are split by the
#: hash of the window.
GROUP_SUFFIXES = 1_000_000
#: Suffixes that one row carries, and that small groups are gathered to.
ROW_SUFFIXES, TOGETHER = 64, 100_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SUMMARY = "doc_id bigint, ord bigint, text_key binary, part bigint, n_words bigint, sha string"
ANCHORS = "ord bigint, part bigint, words_key bigint, anchor bigint, n bigint"
SEGMENTS = "anchor bigint, second bigint, ord bigint, part bigint, start int, words binary"
RUNS = "ord bigint, part bigint, start int, n int"
RESULT = "ord bigint, part bigint, n_removed bigint, kept_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbours."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = mixed(out * _MULTIPLIER + h[j : j + n])
    return out


def window_anchors(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-gram hashes, position of the anchor of each window of ``min_words`` words).

    The anchor is the leftmost of the k-grams with the lowest hash.
    """
    grams = rolled(h, ANCHOR_WORDS)
    width = min_words - ANCHOR_WORDS + 1
    if len(grams) < width:
        return grams, np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    return grams, views.argmin(axis=1) + np.arange(len(views))


def order_of(doc_id: Column) -> Column:
    """Rank of an id: itself; NULL comes last."""
    return F.coalesce(doc_id.cast("bigint"), F.lit((1 << 63) - 1))


def words_key(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, shas = [], [], []
        for text in batch.column(3):
            words = (text.as_py() or b"").split()
            joined = b" ".join(words)
            keys.append(xxhash.xxh3_128_digest(joined))
            counts.append(len(words))
            shas.append(hashlib.sha256(joined).hexdigest())
        columns = [
            batch.column(0), batch.column(1), pa.array(keys, pa.binary()), batch.column(2),
            pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
        ]
        names = ["doc_id", "ord", "text_key", "part", "n_words", "sha"]
        yield pa.RecordBatch.from_arrays(columns, names)


def _anchors(min_words: int):
    """Rows (ord, part, text) to one row per text and anchor, with the number of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, parts, keys, anchors, counts = [], [], [], [], []
            ids = (batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for rank, part, text in zip(*ids, batch.column(2), strict=True):
                words = text.as_py().split()
                if len(words) < min_words:
                    continue
                grams, at = window_anchors(word_hashes(words), min_words)
                found, n = np.unique(grams[at].view(np.int64), return_counts=True)
                anchors.append(found)
                counts.append(n)
                ranks.append(np.full(len(found), rank))
                parts.append(np.full(len(found), part))
                keys.append(np.full(len(found), words_key(words)))
            none = [np.zeros(0, np.int64)]
            columns = (ranks, parts, keys, anchors, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(none + c).astype(np.int64)) for c in columns],
                ["ord", "part", "words_key", "anchor", "n"],
            )

    return run


def _segments(min_words: int, long_prefix: bool):
    """Rows for the suffixes that may repeat.

    Neighbouring suffixes with one anchor make one row: its words, from which all of them are read.
    With ``long_prefix`` each suffix of a large group makes a row of its own, keyed by a 128-bit
    hash of its first ``min_words`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rank, part, text, wanted in zip(*batch.columns, strict=True):
                words = text.as_py().split()
                h = word_hashes(words)
                grams, at = window_anchors(h, min_words)
                chosen = np.flatnonzero(np.isin(grams[at].view(np.int64), wanted.values.to_numpy()))
                if not len(chosen):
                    continue
                rank, part = rank.as_py(), part.as_py()
                if long_prefix:
                    one = rolled(h, min_words).view(np.int64)
                    two = rolled(mixed(h + _MULTIPLIER), min_words).view(np.int64)
                    out += [(int(one[i]), int(two[i]), rank, part, int(i), None) for i in chosen]
                    continue
                of = grams[at[chosen]]
                new = np.diff(chosen, prepend=-2) != 1
                new[1:] |= of[1:] != of[:-1]
                begun = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                new |= (np.arange(len(new)) - begun) % ROW_SUFFIXES == 0
                first = chosen[new]
                last = np.append(chosen[np.flatnonzero(new)[1:] - 1], chosen[-1])
                anchors = grams[at[first]].view(np.int64)
                data = h.tobytes()
                out += [
                    (int(a), 0, rank, part, i, data[8 * i : 8 * (j + min_words)])
                    for a, i, j in zip(anchors, first.tolist(), last.tolist(), strict=True)
                ]
            yield _batch(out, _SEGMENT_SCHEMA)

    return run


_SEGMENT_SCHEMA = pa.schema(
    [("anchor", pa.int64()), ("second", pa.int64()), ("ord", pa.int64()), ("part", pa.int64()),
     ("start", pa.int32()), ("words", pa.binary())]
)
_RUN_SCHEMA = pa.schema(
    [("ord", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
)
_RESULT_SCHEMA = pa.schema(
    [("ord", pa.int64()), ("part", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def repeats_in_groups(
    ranks: np.ndarray, starts: np.ndarray, words: list[bytes], min_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset in it) of the suffixes whose first words start a smaller-ranked text too.

    Sorts all suffixes of the segments by their words. Two neighbours' common prefix of
    ``min_words`` words puts them below one internal node of the tree of that depth; a node's
    suffixes repeat the one of lowest rank.
    """
    sizes = np.array([len(w) // 8 - min_words + 1 for w in words])
    flat = np.frombuffer(b"".join(words), np.uint64)
    before = np.cumsum(sizes + min_words - 1) - (sizes + min_words - 1)
    segment = np.repeat(np.arange(len(words)), sizes)
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = before[segment] + offset
    columns = [flat[begin + j] for j in range(min_words)]
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for column in columns:
        column = column[order]
        same &= column[1:] == column[:-1]
    node = np.concatenate([[0], np.cumsum(~same)])
    rank = ranks[segment[order]]
    lowest = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate([[True], ~same])))
    found = order[rank > lowest[node]]
    return segment[found], offset[found]


def _trees(min_words: int):
    """Streams the sorted segments; groups are cut only where the prefix changes."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        _, ranks, parts, starts, words = zip(*rows, strict=True)
        segment, offset = repeats_in_groups(np.array(ranks), np.array(starts), list(words), min_words)
        order = np.lexsort((offset, segment))
        segment, offset = segment[order], offset[order]
        new = (np.diff(segment, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1)
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(segment)))
        return _batch(
            [
                (ranks[s], parts[s], starts[s] + o, n)
                for s, o, n in zip(
                    segment[first].tolist(), offset[first].tolist(), lengths.tolist(), strict=True
                )
            ],
            _RUN_SCHEMA,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        suffixes = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if suffixes >= TOGETHER and row[0] != held[-1][0]:
                    yield flush(held)
                    held, suffixes = [], 0
                held.append(row)
                suffixes += len(row[-1]) // 8 - min_words + 1
        if held:
            yield flush(held)

    return run


def without_runs(text: bytes, runs: list[dict], min_words: int) -> tuple[list[bytes], int]:
    """The words that no window of a run covers, and the number of the others."""
    words = text.split()
    change = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        change[run["start"]] += 1
        change[run["start"] + run["n"] + min_words - 1] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], int((~keep).sum())


def _remove(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = (batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for rank, part, text, runs in zip(*ids, batch.column(2), batch.column(3), strict=True):
                kept, removed = without_runs(text.as_py(), runs.as_py(), min_words)
                out.append((rank, part, removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield _batch(out, _RESULT_SCHEMA)

    return run


def _replace(columns: list[str], min_words: int):
    """Rows of all columns and the runs (NULL: none): text and n_chars of what is kept."""
    text_at = columns.index("text")
    chars_at = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(batch.columns[: len(columns)])
            texts = made[text_at].to_pylist()
            chars = None if chars_at is None else made[chars_at].to_pylist()
            for i, runs in enumerate(batch.columns[-1]):
                if runs.is_valid:
                    kept, _ = without_runs(texts[i].encode(), runs.as_py(), min_words)
                    texts[i] = b" ".join(kept).decode()
                    if chars is not None:
                        chars[i] = len(texts[i])
            made[text_at] = pa.array(texts, made[text_at].type)
            if chars is not None:
                made[chars_at] = pa.array(chars, made[chars_at].type)
            yield pa.RecordBatch.from_arrays(made, columns)

    return run


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows apart: the rank of the id, and a hash of the text for rows that share it."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return order_of(F.col("doc_id")), F.xxhash64(text)


def _search(docs: DataFrame, min_words: int, group_suffixes: int) -> tuple[DataFrame, DataFrame]:
    """(a row per input row with its counts, the runs of windows to remove per text).

    A text whose words all equal those of a row with a smaller id goes without a search.
    """
    rank, part = _keyed(docs)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        rank.alias("ord"),
        part.alias("part"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    light = staged(rows.mapInArrow(_summarise, SUMMARY), "summary")
    firsts = light.groupBy("text_key").agg(F.min("ord").alias("first"))
    whole_copy = (F.col("ord") > F.col("first")) & (F.col("n_words") >= min_words)
    light = light.join(firsts, "text_key").withColumn("copy", whole_copy)

    text_of = rows.select("ord", "part", "text")
    anchors = text_of.mapInArrow(_anchors(min_words), ANCHORS)
    shared = staged(
        anchors.groupBy("anchor")
        .agg(F.min("words_key").alias("low"), F.max("words_key").alias("high"), F.sum("n").alias("n"))
        .filter("low < high")
        .select("anchor", (F.col("n") > group_suffixes).alias("large")),
        "shared_anchors",
    )
    searched = light.filter((F.col("n_words") >= min_words) & ~F.col("copy")).select("ord", "part").distinct()

    def suffixes(large: bool) -> DataFrame:
        wanted = (
            anchors.select("ord", "part", "anchor")
            .join(shared.filter(F.col("large") == large), "anchor")
            .groupBy("ord", "part")
            .agg(F.collect_set("anchor").alias("wanted"))
            .join(searched, ["ord", "part"], "left_semi")
        )
        found = text_of.join(wanted, ["ord", "part"]).select("ord", "part", "text", "wanted")
        return found.mapInArrow(_segments(min_words, large), SEGMENTS)

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        suffixes(False)
        .select("anchor", "ord", "part", "start", "words")
        .repartition(partitions, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_trees(min_words), RUNS)
    )
    if not shared.filter("large").isEmpty():
        whole = staged(suffixes(True).drop("words"), "long_prefixes")
        lowest = whole.groupBy("anchor", "second").agg(F.min("ord").alias("lowest"))
        runs = runs.unionByName(
            whole.join(lowest, ["anchor", "second"])
            .filter(F.col("ord") > F.col("lowest"))
            .select("ord", "part", "start", F.lit(1).alias("n"))
        )
    per_text = runs.groupBy("ord", "part").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return light, per_text


def substring_dedup(
    docs: DataFrame, min_words: int = MIN_WORDS, group_suffixes: int = GROUP_SUFFIXES
) -> DataFrame:
    """One row per input row: words, removed words and digest of what is kept.

    A word goes if a window of ``min_words`` words that covers it also starts in a row with a
    smaller id, judged on the input. NULL and empty texts have no words. A NULL id ranks after
    all others; rows with one id never remove words from each other, and repeated rows get equal
    results. Texts are read whole; other columns of ``docs`` are not read.
    """
    light, per_text = _search(docs, min_words, group_suffixes)
    rank, part = _keyed(docs)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    changed = (
        docs.select(rank.alias("ord"), part.alias("part"), text.alias("text"))
        .join(per_text, ["ord", "part"])
        .select("ord", "part", "text", "runs")
        .mapInArrow(_remove(min_words), RESULT)
        .dropDuplicates(["ord", "part"])
    )
    result = light.join(changed, ["ord", "part"], "left")
    n_removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.col("n_removed"))
    kept = F.when(F.col("copy"), EMPTY_SHA).otherwise(F.col("kept_sha256"))
    return result.select(
        F.col("doc_id"),
        F.col("n_words"),
        F.coalesce(n_removed, F.lit(0)).alias("n_removed"),
        F.coalesce(kept, F.col("sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns; ``text`` (and ``n_chars``, if there) without repeated passages.

    Texts that lose nothing stay as they are, others become their kept words with single spaces.
    Columns may have any names.
    """
    light, per_text = _search(docs, min_words, GROUP_SUFFIXES)
    every = F.array(F.struct(F.lit(0).alias("start"), (F.col("n_words") - min_words + 1).cast("int").alias("n")))
    copies = light.filter("copy").select("ord", "part", every.alias("runs")).dropDuplicates(["ord", "part"])
    runs = per_text.unionByName(copies)
    names = dict(zip(runs.columns, unused(docs, *runs.columns), strict=True))
    rank, part = _keyed(docs)
    keyed = docs.withColumns({names["ord"]: rank, names["part"]: part})
    joined = keyed.join(runs.withColumnsRenamed(names), [names["ord"], names["part"]], "left")
    return joined.select(*docs.columns, names["runs"]).mapInArrow(
        _replace(docs.columns, min_words), docs.schema
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


SQL = {
    "op1_substring_dedup": rf"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ),
        places AS (
            SELECT doc_id, i, array_to_string(words[i:i + {MIN_WORDS - 1}], ' ') AS w
            FROM split, range(1, len(words) - {MIN_WORDS - 2}) AS r(i)
        ),
        later AS (
            SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY w) AS again FROM places
        ),
        gone AS (
            SELECT DISTINCT doc_id, i + j AS i FROM later, range(0, {MIN_WORDS}) AS r(j) WHERE again
        ),
        gone_of AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id),
        kept AS (
            SELECT s.doc_id, words, coalesce(len(places), 0) AS n,
                   list_filter(words, lambda w, i: NOT list_contains(coalesce(places, []), i)) AS rest
            FROM split s LEFT JOIN gone_of g ON s.doc_id = g.doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, n::BIGINT AS n_removed,
               sha256(array_to_string(rest, ' ')) AS kept_sha256
        FROM kept
    """
}
