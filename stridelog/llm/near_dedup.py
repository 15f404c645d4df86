"""Near duplicates by a chosen-path set similarity join.

Sets are words' shingles; equal sets are joined first. Documents then walk down a few random
trees: a node of a tree chooses two coordinates of the minwise signature, and a document goes to
the child named by its value at each of them, so similar documents meet often and others part
soon. Small nodes are compared exhaustively on sketches. In large nodes everything is compared
with a few leaders: what is much like one of them is linked and leaves the tree (whatever is
similar to it is linked to that leader as well), the rest branches on. A pair as similar as the threshold allows
meets in one tree with a probability of 0.94 at every depth. All trees read one signature, so the
number of trees follows from a target: the miss of a pair at the threshold, averaged over the
signatures it may have, in the deepest nodes (``missed``).

Links on sketches only make candidate groups. Inside each group the links are confirmed on full
sets, exactly and completely, and the confirmed links' components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, null_safe, staged
from .components import connected_components
from .substring_dedup import mixed, order_of, rolled, word_hashes

#: Percent of the union that the intersection must reach.
THRESHOLD = 80
SIGNATURE = 64
#: Members of a node that are compared exhaustively; larger ones branch on.
SMALL_NODE = 1024
#: Leaders of a large node: of a group of near copies few members are unlike all of them.
LEADERS = 16
DEEPEST = 12
#: Rows and columns of a block in which a node's sketches are compared.
BLOCK = 128
#: Largest share of pairs at the threshold that may meet in no leaf of any tree.
MISSED = 1 / 3000
#: Shares of equal sketch values: candidates (four standard errors below the threshold), and for
#: large nodes what is so much like a leader that all its partners are linked to the leader too
#: (partners are at most the threshold's distance farther away; links to a leader are few).
CANDIDATE, ABSORBED, LED = 0.6, 0.75, 0.4
#: Shingles of one candidate group that a task confirms at once.
GROUP_SHINGLES = 4_000_000
#: Members of a larger group that are compared with one copy of a leader's set.
MEMBERS_PER_COPY = 1000


def missed(trees: int, depth: int = DEEPEST, like: float = THRESHOLD / 100) -> float:
    """Share of the pairs with this similarity that meet in no node of ``depth`` of any tree.

    The mean over the number of equal coordinates, by which a pair's trees depend on each other.
    """
    share = 0.0
    for equal in range(SIGNATURE + 1):
        same = equal / SIGNATURE
        meets = 1.0
        for _ in range(depth):
            meets = 1 - (1 - same * meets) ** 2
        chance = comb(SIGNATURE, equal) * like**equal * (1 - like) ** (SIGNATURE - equal)
        share += chance * (1 - meets) ** trees
    return share


TREES = next(n for n in count(1) if missed(n) <= MISSED)

_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 4096

SETS = "doc_id bigint, ord bigint, set_key binary, part bigint, n_shingles bigint, signature binary"
PATHS = "path bigint, node bigint"
EDGES = "a bigint, b bigint"


def shingles(text: bytes | None, size: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words if there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolled(word_hashes(words), min(size, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum under each of ``SIGNATURE`` hash functions, 32 bits each."""
    lowest = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), _CHUNK):
        part = found[i : i + _CHUNK, None] * _FACTORS
        lowest = np.minimum(lowest, part.min(axis=0))
    return (mixed(lowest) >> np.uint64(32)).astype("<u4")


def roots() -> np.ndarray:
    return mixed(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def children(paths: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Two children of each row: (rows, 2) path hashes. The node alone chooses coordinates."""
    first = mixed(paths + np.uint64(1)) % np.uint64(SIGNATURE)
    step = np.uint64(1) + mixed(paths + np.uint64(2)) % np.uint64(SIGNATURE - 1)
    out = []
    for coordinate in (first, (first + step) % np.uint64(SIGNATURE)):
        value = np.take_along_axis(signatures, coordinate.astype(np.int64)[:, None], 1)[:, 0]
        key = paths * np.uint64(0xD6E8FEB86659FD93) + (coordinate << np.uint64(32)) + value
        out.append(mixed(mixed(key)))
    return np.stack(out, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SIGNATURE).astype(np.uint64)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names)


def _sets(size: int):
    names = ["doc_id", "ord", "set_key", "part", "n_shingles", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, sizes, signatures = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), size)
                data = found.tobytes()
                keys.append(xxhash.xxh3_128_digest(data))
                parts.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                sizes.append(len(found))
                signatures.append(signature(found).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()),
                 pa.array(parts, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(signatures, pa.binary())],
                names,
            )

    return run


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signatures, nodes = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for root in roots():
                paths = children(np.full(len(nodes), root), signatures)
                yield _batch(["path", "node"], paths.T.reshape(-1).view(np.int64), np.tile(nodes, 2))


def _beside_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, node, leaders, signature, their sketches): links to leaders, and the next level.

    A link has a NULL path; a child has a NULL leader. A member is linked to the first leader it is
    like; that this leader and another have members in common is said once per batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        own = _matrix(batch.column(3))
        sketch = own.astype(np.uint8)  # the first byte, as in the sketches
        order = np.argsort(paths, kind="stable")
        starts = np.flatnonzero(np.diff(paths[order], prepend=paths[order[0]] - 1))
        links: list[tuple[np.ndarray, np.ndarray]] = []
        onward = np.ones(len(nodes), bool)
        for here, stop in zip(starts, [*starts[1:], len(nodes)], strict=True):
            rows = order[here:stop]
            leaders = np.array(batch.column(2)[int(rows[0])].as_py())
            led_by = np.frombuffer(batch.column(4)[int(rows[0])].as_py(), np.uint8)
            led_by = led_by.reshape(len(leaders), SIGNATURE)
            like = np.stack([(sketch[rows] == one).mean(axis=1) for one in led_by], axis=1)
            leads = nodes[rows, None] == leaders
            linked = (like >= LED) & ~leads
            onward[rows] = (like < ABSORBED).all(axis=1) & ~leads.any(axis=1)
            some = linked.any(axis=1)
            first = linked.argmax(axis=1)
            links.append((leaders[first[some]], nodes[rows[some]]))
            forest = Forest(len(leaders))
            for x, y in {(int(first[i]), int(k)) for i, k in zip(*np.nonzero(linked))}:
                if forest.join(x, y):
                    links.append((leaders[[x]], leaders[[y]]))
        below = children(paths[onward].view(np.uint64), own[onward]).T.reshape(-1).view(np.int64)
        a, b = (np.concatenate(part) for part in zip(*links, strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(below)]),
                pa.array(np.concatenate([b, np.tile(nodes[onward], 2)])),
                pa.concat_arrays([pa.array(a), pa.nulls(len(below), pa.int64())]),
            ],
            ["path", "node", "leader"],
        )


class Forest:
    """Union-find over a few local nodes."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _exhaustive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares all pairs of each small node, and of a deepest one in blocks; sorted by path.

    Of a node's candidate links a spanning forest is enough: they only make groups.
    """

    def links(nodes: list[int], sketches: list[bytes]) -> list[tuple[int, int]]:
        matrix = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SIGNATURE)
        forest, out, needed = Forest(len(nodes)), [], CANDIDATE * SIGNATURE
        for i in range(0, len(nodes), BLOCK):
            block = matrix[i : i + BLOCK]
            for j in range(i, len(nodes), BLOCK):
                other = matrix[j : j + BLOCK]
                equal = np.zeros((len(block), len(other)), np.uint8)
                for x, y in zip(block.T, other.T, strict=True):
                    equal += x[:, None] == y
                for x, y in zip(*(at.tolist() for at in np.nonzero(equal >= needed)), strict=True):
                    if forest.join(i + x, j + y):
                        out.append((nodes[i + x], nodes[j + y]))
        return out

    def run() -> Iterator[list[tuple[int, int]]]:
        path, nodes, sketches = None, [], []
        for batch in batches:
            for p, node, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != path:
                    if len(nodes) > 1:
                        yield links(nodes, sketches)
                    path, nodes, sketches = p, [], []
                nodes.append(node)
                sketches.append(sketch)
        if len(nodes) > 1:
            yield links(nodes, sketches)

    held: list[tuple[int, int]] = []
    for found in run():
        held += found
        if len(held) >= 10_000:
            yield _batch(["a", "b"], *np.array(held).T)
            held = []
    if held:
        yield _batch(["a", "b"], *np.array(held).T)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join every two similar ``nodes`` (node, signature) in one group."""
    spark = nodes.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = nodes.withColumn("sketch", F.expr("unhex(regexp_replace(hex(signature), '(..)......', '$1'))"))
    sketch = sketch.select("node", "sketch")
    level = staged(nodes.select("node", "signature").mapInArrow(_first_level, PATHS), "level")
    small, links = [], []
    for depth in range(1, DEEPEST + 1):
        of = F.pmod(F.xxhash64("node"), F.lit(LEADERS))
        leaders = [F.min(F.when(of == i, F.col("node"))) for i in range(LEADERS)]
        counts = level.groupBy("path").agg(
            F.count("*").alias("n"), F.array_compact(F.array(*leaders)).alias("leaders")
        )
        is_small = F.lit(depth == DEEPEST) | (F.col("n") <= SMALL_NODE)
        few = counts.filter("n > 1").select("path", is_small.alias("small"))
        counted = level.join(few, "path")
        counted = staged(counted, "counted")
        small.append(counted.filter("small").select("path", "node"))
        large = counted.filter(~F.col("small")).select("path", "node")
        if depth == DEEPEST or large.isEmpty():
            break
        led_by = (
            counts.filter(F.col("n") > SMALL_NODE)
            .select("path", F.explode("leaders").alias("node"))
            .join(sketch, "node")
            .groupBy("path")
            .agg(F.array_sort(F.collect_list(F.struct("node", "sketch"))).alias("led_by"))
            .select(
                "path",
                F.col("led_by.node").alias("leaders"),
                F.unhex(F.array_join(F.transform("led_by.sketch", F.hex), "")).alias("sketches"),
            )
        )
        compared = staged(
            large.join(nodes.select("node", "signature"), "node")
            .join(led_by, "path")
            .select("path", "node", "leaders", "signature", "sketches")
            .mapInArrow(_beside_leaders, "path bigint, node bigint, leader bigint"),
            "compared",
        )
        links.append(compared.filter("leader IS NOT NULL").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        level = compared.filter("path IS NOT NULL").select("path", "node")
    leaves = small[0]
    for more in small[1:]:
        leaves = leaves.unionByName(more)
    found = (
        leaves.join(sketch, "node")
        .select("path", "node", "sketch")
        .repartition(width, "path")
        .sortWithinPartitions("path", "node")
        .mapInArrow(_exhaustive, EDGES)
    )
    for more in links:
        found = found.unionByName(more)
    return found


def similar_to(one: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of elements that each of the sets laid out in ``flat`` shares with ``one``."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def confirmed_links(nodes: list[int], sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links that join exactly those of the group that a chain of similar pairs connects.

    Each set is compared with all that are not connected to anything yet; a set that was reached
    has no more to find among those reached before it, so a group of copies is compared once.
    """
    left = list(range(len(nodes)))
    out: list[tuple[int, int]] = []
    while left:
        queue = [left.pop(0)]
        flat = None
        while queue and left:
            x = queue.pop()
            if flat is None:
                sizes = np.array([len(sets[y]) for y in left])
                flat = np.concatenate([sets[y] for y in left])
            shared = similar_to(sets[x], flat, sizes)
            near = 100 * shared >= threshold * (len(sets[x]) + sizes - shared)
            if near.any():
                reached = [y for y, hit in zip(left, near) if hit]
                out += [(nodes[x], nodes[y]) for y in reached]
                queue += reached
                left = [y for y, hit in zip(left, near) if not hit]
                flat = None
    return out


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, node, set), sorted by group and node; a repeated node counts once."""
        group, nodes, sets = None, [], []
        for batch in batches:
            for g, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if len(nodes) > 1 and (found := confirmed_links(nodes, sets, threshold)):
                        yield _batch(["a", "b"], *np.array(found).T)
                    group, nodes, sets = g, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(data, np.uint64))
        if len(nodes) > 1 and (found := confirmed_links(nodes, sets, threshold)):
            yield _batch(["a", "b"], *np.array(found).T)

    return run


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text, members): the full set for the member whose set the text has."""
        for batch in batches:
            out: list[tuple] = []
            for text, members in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = shingles(text.as_py(), size).tobytes()
                part = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                out += [(m["group"], m["node"], data) for m in members if m["part"] == part][:1]
            columns = zip(*out, strict=True) if out else [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["group", "node", "set"]
            )

    return run


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, node, set, leader, leader's set) to (group, node, leader, distance)."""
    for batch in batches:
        distance = []
        for data, led_by in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            one, two = np.frombuffer(data, np.uint64), np.frombuffer(led_by, np.uint64)
            shared = len(np.intersect1d(one, two, assume_unique=True))
            distance.append(1 - shared / (len(one) + len(two) - shared))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(distance, pa.float64())],
            ["group", "node", "leader", "distance"],
        )


def _shrink(members: DataFrame, threshold: int, group_shingles: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members (group, node, set) of groups that fit a task, and links found on the way there.

    In a group that is too large all members are compared with one leader. Distance is a metric:
    a member at distance d from the leader can only be similar to members at most d + r away (r:
    the distance of the threshold). So a member linked to the leader stays only if an unlinked
    one is that near; the leader itself is done. Ends because every round removes a leader of
    every group that is too large.
    """
    radius = 1 - threshold / 100
    links: list[DataFrame] = []
    while True:
        sizes = members.groupBy("group").agg(
            F.sum(F.length("set") / 8).alias("shingles"), F.min("node").alias("leader"), F.count("*").alias("n")
        )
        large = staged(sizes.filter(F.col("shingles") > group_shingles), "large_groups")
        if large.isEmpty():
            return members, links
        copies = F.ceil(F.col("n") / MEMBERS_PER_COPY).cast("int")
        large = large.withColumn("copies", copies)
        led = (
            members.join(large, "group").filter("node = leader")
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            .select("group", "copy", "leader", F.col("set").alias("led_by"))
        )
        compared = staged(
            members.join(large.select("group", "copies"), "group")
            .withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
            .join(led, ["group", "copy"])
            .select("group", "node", "set", "leader", "led_by")
            .mapInArrow(_distances, "group bigint, node bigint, leader bigint, distance double"),
            "distances",
        )
        near = F.col("distance") <= radius + 1e-9
        links.append(compared.filter(near & (F.col("node") != F.col("leader"))).select(
            F.col("leader").alias("a"), F.col("node").alias("b")))
        nearest = compared.filter(~near).groupBy("group").agg(F.min("distance").alias("nearest"))
        stays = compared.join(nearest, "group").filter(
            (F.col("node") != F.col("leader")) & (F.col("distance") >= F.col("nearest") - radius - 1e-9)
        )
        kept = members.join(stays.select("group", "node"), ["group", "node"], "left_semi")
        members = staged(
            members.join(large.select("group"), "group", "left_anti").unionByName(kept), "members"
        )


def near_components(
    docs: DataFrame,
    size: int = 2,
    threshold: int = THRESHOLD,
    group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """One row per input row: shingles, component, whether it is the row that stays.

    Texts are linked when 100 * intersection >= threshold * union of their sets of ``size``-word
    shingles (words in lower case, A-Z only); a text of fewer words has its whole sequence as one
    shingle, a NULL text or one without words none, and is linked with nothing. ``component_id``
    is the smallest id that a chain of links reaches. A NULL id is no id: it is never the
    smallest unless the whole component has none. Rows with equal sets, repeated rows among
    them, are one node of the search; rows repeated with the kept id are all ``kept``. An empty
    input gives an empty result; other columns of ``docs`` are not read.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        order_of(F.col("doc_id")).alias("ord"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    sets = staged(
        rows.mapInArrow(_sets(size), SETS).withColumn("row", F.monotonically_increasing_id()), "sets"
    )
    firsts = staged(
        sets.filter("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("node")), "firsts"
    )
    first_rows = firsts.select(F.col("node").alias("row"))
    nodes = staged(
        sets.join(first_rows, "row", "left_semi").select(
            F.col("row").alias("node"), "ord", "part", "n_shingles", "signature"
        ),
        "nodes",
    )
    groups = connected_components(candidate_links(nodes))
    members = (
        groups.withColumnRenamed("label", "group").join(nodes, "node")
        .groupBy("ord").agg(F.collect_list(F.struct("group", "node", "part")).alias("members"))
    )
    full = (
        rows.select("ord", "text").join(members, "ord").select("text", "members")
        .mapInArrow(_with_sets(size), "group bigint, node bigint, set binary")
    )
    full, links = _shrink(staged(full, "full_sets"), threshold, group_shingles)
    confirmed = (
        full.repartition(width, "group")
        .sortWithinPartitions("group", "node")
        .mapInArrow(_confirm(threshold), EDGES)
    )
    for more in links:
        confirmed = confirmed.unionByName(more)
    labels = connected_components(confirmed)
    of_set = firsts.join(labels, "node", "left").select(
        F.col("set_key").alias("key"), F.coalesce("label", "node").alias("component")
    )
    labelled = staged(
        sets.select("doc_id", "set_key", "n_shingles")
        .join(of_set, F.col("set_key") == F.col("key"), "left")
        .select("doc_id", "n_shingles", "component"),
        "labelled",
    )
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    smallest = smallest.filter("component IS NOT NULL")
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return labelled.join(smallest, "component", "left").select(
        "doc_id",
        "n_shingles",
        component_id.alias("component_id"),
        F.col("doc_id").eqNullSafe(component_id).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, with all its columns; rows without words all stay.

    Expects ids that tell documents apart: rows that share the kept id all stay.
    """
    kept = near_components(docs, size, threshold).filter("kept").select("doc_id").distinct()
    return null_safe(docs, kept, ["doc_id"], "left_semi")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))
