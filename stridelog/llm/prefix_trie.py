"""Prefix trie of conversations: double-array tries per prefix shard, merged at the top.

Turns become digests and every conversation the sequence of them; equal sequences are one row with
their number, smallest id and the hash of their ids. Sequences are grouped by their first turn; a
group with too many turns by its first 2, 4, 8, ... turns, until it fits or is one sequence. Groups
are dealt to shards. A shard numbers its turns densely, packs its trie into BASE and CHECK arrays
and walks every sequence through them. Nodes at or below the end of their group's prefix are
complete there. Those above it may go on in other shards: each shard sends what it has for them,
and Spark adds this up.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Turns of distinct sequences that a group may have, and that a shard is expected to have.
GROUP_TURNS = 20_000
SHARD_TURNS = 20_000
#: Member ids are first joined within ranges of so many values (as a power of two).
ID_BITS = 8
#: Free slots tried for a node with several children before the arrays are extended.
TRIES = 64
#: Copies of the shared upper nodes when they meet the many nodes below one of them.
SALTS = 16
HEX = 32
FREE = -1

SEQUENCES = "key string, turns string, sizes array<int>, n bigint, least bigint, ends string"
NODES = (
    "upper boolean, key string, parent string, ancestors array<string>, conv_id bigint, "
    "depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved bigint, size bigint, ends string"
)
OUTPUT = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- conversations


def conversation_turns(table: DataFrame) -> DataFrame:
    """(conv_id, turns, sizes): digests and text lengths in bytes, in order.

    Turns are ordered by ``turn`` (NULL first), those with one number by their digest; NULL roles
    and texts count as empty, repeated rows stay. Rows without a conv_id belong to none and are
    left out. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        digest.alias("digest"),
        F.octet_length(text).alias("size"),
    )
    return (
        table.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"))
        .filter(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select(
            "conv_id",
            F.col("turns.digest").alias("turns"),
            F.col("turns.size").alias("sizes"),
        )
    )


def with_shared_heads(convs: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations whose first h turns come from the first of their family.

    h is the CRC-32 of the decimal id modulo ``heads``. The first of a family is the conversation
    ``c - c % family``; if it has fewer turns all are taken, if it is absent none. The
    conversation's own turns follow after its first h.
    """
    id_ = F.col("conv_id")
    first = (
        convs.filter(id_ % family == 0)
        .select(
            id_.alias("first"),
            F.slice("turns", 1, heads - 1).alias("head"),
            F.slice("sizes", 1, heads - 1).alias("head_sizes"),
        )
    )
    h = (F.crc32(id_.cast("string")) % heads).cast("int")

    def rebuilt(head: str, own: str) -> Column:
        taken = F.slice(F.coalesce(F.col(head), F.array().cast(convs.schema[own].dataType)), 1, h)
        return F.concat(taken, F.slice(own, h + 1, F.size(own)))

    return convs.join(first, id_ - id_ % family == F.col("first"), "left").select(
        "conv_id",
        rebuilt("head", "turns").alias("turns"),
        rebuilt("head_sizes", "sizes").alias("sizes"),
    )


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence of turns, with number, smallest id and hash of its ids.

    The ids of one sequence are joined in ranges first; the ranges then run through the hash one
    after the other, so that no task holds all ids of a common conversation.
    """
    turns = F.array_join("turns", "")
    ranges = (
        convs.select("conv_id", turns.alias("turns"), "sizes")
        .groupBy(F.md5("turns").alias("key"), F.shiftright("conv_id", ID_BITS).alias("range"))
        .agg(
            F.first("turns").alias("turns"),
            F.first("sizes").alias("sizes"),
            F.count(F.lit(1)).alias("n"),
            F.min("conv_id").alias("least"),
            F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias(
                "ids"
            ),
        )
    )
    in_order = ranges.repartition("key").sortWithinPartitions("key", "range")
    return staged(in_order.mapInArrow(_joined, SEQUENCES), "sequences")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if now is not None and now["key"] == row["key"]:
                now["n"] += row["n"]
                digest.update(b",")
            else:
                if now is not None:
                    done.append({**now, "ends": digest.hexdigest()})
                now, digest = row, hashlib.sha256()
            digest.update(row["ids"].encode())
        yield from _table(done, SEQUENCES).to_batches()
    if now is not None:
        yield from _table([{**now, "ends": digest.hexdigest()}], SEQUENCES).to_batches()


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {
        "boolean": pa.bool_(),
        "string": pa.string(),
        "bigint": pa.int64(),
        "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()),
    }
    fields = [field.split() for field in schema.split(", ")]
    return pa.Table.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in fields]))


# --- groups and shards


def _prefix(depth: Column) -> Column:
    """Digest of the first ``depth`` turns, or of all if there are fewer."""
    return F.md5(F.substr("turns", F.lit(1), F.lit(HEX) * depth))


def grouped(sequences: DataFrame, group_turns: int) -> DataFrame:
    """``sequences`` with ``cut``, the length of the prefix that their group shares."""
    length = F.length("turns") / HEX
    cut, rest, depth = F.lit(1), sequences, 1
    found = sequences
    while True:
        name = f"heavy_{depth}"
        heavy = staged(
            rest.groupBy(_prefix(F.lit(depth)).alias(name))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("turns"))
            .filter((F.col("n") > 1) & (F.col("turns") > group_turns))
            .select(name),
            name,
        )
        if heavy.isEmpty():
            return found.withColumn("cut", cut)
        at = _prefix(F.lit(depth))
        rest = rest.join(heavy, at == F.col(name), "left_semi")
        found = found.join(heavy, at == F.col(name), "left")
        depth *= 2
        cut = F.when(F.col(name).isNotNull(), F.lit(depth)).otherwise(cut)


# --- one shard


class DoubleArray:
    """A trie over dense codes: the child of node s by code c is BASE[s] + c, if CHECK says s."""

    def __init__(self) -> None:
        self.base, self.check = array("q", [0]), array("q", [0])
        self._first_free = 1

    def place(self, parent: int, codes: list[int]) -> list[int]:
        """Slots for the children of ``parent``; ``codes`` ascend."""
        slot, tries = self._first_free, 0
        while not self._fits(slot - codes[0], codes):
            tries += len(codes) > 1
            slot = max(slot + 1, len(self.check)) if tries >= TRIES else slot + 1
        base = self.base[parent] = slot - codes[0]
        slots = [base + code for code in codes]
        missing = slots[-1] + 1 - len(self.check)
        if missing > 0:
            self.base.extend([0] * missing)
            self.check.extend([FREE] * missing)
        for child in slots:
            self.check[child] = parent
        while self._first_free < len(self.check) and self.check[self._first_free] != FREE:
            self._first_free += 1
        return slots

    def _fits(self, base: int, codes: list[int]) -> bool:
        check, end = self.check, len(self.check)
        return all(base + code >= end or check[base + code] == FREE for code in codes)

    def child(self, node: int, code: int) -> int:
        slot = self.base[node] + code
        if not 0 < slot < len(self.check) or self.check[slot] != node:
            raise KeyError(code)
        return slot


def packed(sequences: list[list[str]]) -> tuple[DoubleArray, dict[str, int], list[int]]:
    """The trie of ``sequences``, the dense code of every turn, and the nodes from the root down.

    Codes follow the order in which turns come up level by level, so siblings lie close together.
    """
    trie, codes, nodes = DoubleArray(), {}, []
    todo = deque([(0, range(len(sequences)), 0)])
    while todo:
        node, members, depth = todo.popleft()
        nodes.append(node)
        below: dict[int, list[int]] = {}
        for member in members:
            if len(sequences[member]) > depth:
                code = codes.setdefault(sequences[member][depth], len(codes))
                below.setdefault(code, []).append(member)
        if below:
            order = sorted(below)
            for code, slot in zip(order, trie.place(node, order), strict=True):
                todo.append((slot, below[code], depth + 1))
    return trie, codes, nodes


def _shard(group: pa.Table) -> pa.Table:
    """All nodes of a shard: whole ones, and its part of those above the cut."""
    rows = group.to_pylist()
    turns = [
        [row["turns"][i : i + HEX] for i in range(0, len(row["turns"]), HEX)] for row in rows
    ]
    trie, codes, nodes = packed(turns)
    room = len(trie.check)
    zeros = lambda: array("q", [0]) * room
    count, least, depth, size, inside, children, leaves, saved = (zeros() for _ in range(8))
    member, ends = array("q", [FREE]) * room, {}
    for i, row in enumerate(rows):
        node = 0
        path = [0]
        for code in map(codes.__getitem__, turns[i]):
            node = trie.child(node, code)
            path.append(node)
        ends[node] = row["ends"]
        for d, node in enumerate(path):
            if member[node] == FREE:
                member[node], depth[node], least[node] = i, d, row["least"]
                size[node] = row["sizes"][d - 1] if d else 0
            least[node] = min(least[node], row["least"])
            count[node] += row["n"]
    upper = lambda node: depth[node] < rows[member[node]]["cut"]
    for node in reversed(nodes):
        if not upper(node):
            leaves[node] += not children[node]
            saved[node] += (count[node] - 1) * size[node]
            if node:
                parent = trie.check[node]
                leaves[parent] += leaves[node]
                saved[parent] += saved[node]
                children[parent] += 1
    keys: dict[int, str] = {}
    above: dict[int, list[str]] = {}
    out = []
    for node in nodes:
        parent = trie.check[node] if node else None
        made = {
            "upper": upper(node),
            "parent": keys.get(parent),
            "conv_id": least[node],
            "depth": depth[node],
            "n_convs": count[node],
            "n_children": children[node],
            "n_leaves": leaves[node],
            "saved": saved[node],
            "size": size[node],
            "ends": ends.get(node),
        }
        if made["upper"]:
            prefix = rows[member[node]]["turns"][: HEX * depth[node]]
            keys[node] = made["key"] = hashlib.md5(prefix.encode()).hexdigest()
            above[node] = [*above[parent], keys[parent]] if node else []
            made["ancestors"] = above[node]
        elif parent not in keys:
            made["parent_conv_id"] = least[parent]
        out.append(made)
    return _table(out, NODES)


# --- all shards


def prefix_trie(
    convs: DataFrame, group_turns: int = GROUP_TURNS, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """The nodes of the trie of (conv_id, turns, sizes): every distinct sequence of first turns.

    Per node: conv_id (smallest member), depth, parent_conv_id (root: NULL), n_convs (members:
    conversations starting with it, those without turns at the root), n_children, n_leaves
    (childless nodes of its subtree, itself included), saved_tokens (over its subtree, each node's
    members but one times the bytes of its last text) and ends_sha256 (over the ids of the members
    that end there, ascending, joined by commas). Without conversations there are no nodes.

    A task holds a shard of about ``shard_turns`` turns and groups of at most ``group_turns``, or
    one single conversation, and the digests of one conversation are one row.
    """
    sequences = distinct_sequences(convs)
    total = sequences.agg(F.coalesce(F.sum(F.length("turns")), F.lit(0))).first()[0] // HEX
    shards = max(1, math.ceil(total / shard_turns))
    cut = grouped(sequences, group_turns)
    shard = F.pmod(F.xxhash64(_prefix(F.col("cut"))), F.lit(shards))
    nodes = staged(
        cut.select("turns", "sizes", "n", "least", "ends", "cut", shard.alias("shard"))
        .groupBy("shard")
        .applyInArrow(_shard, NODES),
        "nodes",
    )
    upper = _upper(nodes.filter("upper"))
    whole = nodes.filter(~F.col("upper"))
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS))
    parents = upper.select(
        F.col("key").alias("parent"),
        F.col("conv_id").alias("least"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1))).alias("salt"),
    )
    top = (
        whole.filter(F.col("parent").isNotNull())
        .withColumn("salt", salt)
        .join(parents, ["parent", "salt"], "left")
        .withColumn("parent_conv_id", F.col("least"))
    )
    deep = whole.filter(F.col("parent").isNull()).select(*_columns())
    return deep.unionByName(top.select(*_columns())).unionByName(upper.select(*_columns()))


def _columns() -> list[Column]:
    named = {"saved_tokens": F.col("saved"), "ends_sha256": F.coalesce("ends", F.lit(NO_ENDS))}
    return [named.get(name, F.col(name)).alias(name) for name in OUTPUT]


def _upper(parts: DataFrame) -> DataFrame:
    """Shared nodes from the shards' parts; what lies below in whole nodes is summed in these."""
    merged = staged(
        parts.groupBy("key", "parent", "depth", "size").agg(
            F.first("ancestors").alias("ancestors"),
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
            F.max("ends").alias("ends"),
        ),
        "upper",
    )
    among = merged.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("among"))
    own = merged.join(among, "key", "left").withColumns(
        {"n_children": F.col("n_children") + F.coalesce("among", F.lit(0))}
    )
    own = own.withColumns(
        {
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"),
            "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("size"),
        }
    )
    sums = (
        own.select(
            F.explode(F.array_append("ancestors", F.col("key"))).alias("key"), "n_leaves", "saved"
        )
        .groupBy("key")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    )
    parents = merged.select(
        F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        own.drop("n_leaves", "saved").join(sums, "key").join(parents, "parent", "left")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(with_shared_heads(conversation_turns(table)))


SQL = {
    "op12_prefix_trie": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST,
                       md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS turns
  FROM turns GROUP BY conv_id
), crc AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS first_id, CAST(xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                            lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda bits, i: xor(bits >> 1, CASE WHEN bits & 1 = 1 THEN 3988292384 ELSE 0 END))),
    4294967295) % 9 AS BIGINT) AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns[:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM crc c LEFT JOIN own f ON f.conv_id = c.first_id
), prefixes AS (
  SELECT conv_id, d AS depth, turns[:d] AS node, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                         FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), children AS (
  SELECT node[:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.node[depth].text) END AS saved
  FROM nodes n LEFT JOIN children c ON c.node = n.node
), above AS (
  SELECT node[:unnest(range(depth + 1))] AS node, n_children, saved FROM counted
), below AS (
  SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM above GROUP BY node
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.node = c.node
LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.node[:c.depth - 1]
"""
}
