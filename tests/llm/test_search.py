"""Exact search, hard negatives and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stridelog.llm import exact_search, hard_negatives, prefix_trie, vectors
from stridelog.llm.exact_search import KDTree
from stridelog.llm.hard_negatives import Anchors, encoded
from stridelog.llm.prefix_trie import DoubleArray, conversation_turns, packed, with_shared_heads

from .conftest import dicts

CLASHES = ("row", "shard", "part", "vector", "query", "is_query", "label_", "score", "rank", "key")


def table_of(spark, rows, kinds):
    """Rows with columns whose names the operators use inside."""
    schema = ", ".join([*kinds, *(f"{c} string" for c in CLASHES)])
    return spark.createDataFrame([(*row, *("x" for _ in CLASHES)) for row in rows], schema)


VECTORS = ("vec_id bigint", "embedding array<float>", "label int")


def vector_rows(n=160, width=6, seed=0):
    """Clusters, copies, repeated and missing ids, vectors that cannot be used."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = []
    for i in range(n):
        v = centres[i % 4] + rng.normal(scale=0.3, size=width)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    same = rows[20][1]
    rows += [(n + i, same, i % 3) for i in range(30)]
    rows += [(20, same, 1), (20, same, 1), (None, same, 0), (None, rows[3][1], None)]
    rows += [
        (1000, None, 1),
        (1001, [None] * width, 1),
        (1002, [float("nan")] * width, 1),
        (1003, [float("inf")] * width, 1),
        (1020, [3e30] * width, 1),
        (1040, [0.0] * width, 2),
        (1060, [1.0], 2),
        (1080, [], 2),
    ]
    return rows


def whole(rows, scale, labelled=False):
    """(vec_id, label, integers) of the usable rows, filled up with zeros."""
    out = []
    for i, v, label in rows:
        if v is None or (labelled and label is None):
            continue
        if any(x is None or not math.isfinite(x) or abs(scale * x) >= 2**31 - 1 for x in v):
            continue
        w = [math.floor(scale * x) for x in v]
        out.append((i, label, w + [0] * (6 - len(w))))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def by_score(pairs):
    """(score, id) with the greatest score first, then the smaller id, NULL last."""
    return sorted(pairs, key=lambda p: (-p[0], p[1] is None, p[1] or 0))


# --- exact search


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_tree_finds_the_best_rows(leaf):
    rng = np.random.default_rng(leaf)
    points = rng.integers(-20, 20, (300, 5))
    points[100:200] = points[7]
    queries = np.concatenate((points[:40], np.zeros((1, 5), np.int64)))
    own = np.array([*range(40), -1])
    ties = rng.permutation(300)
    floors = np.full(41, vectors.LEAST)
    floors[5] = 10**6
    best = KDTree(points, leaf).search(queries, own, ties, 7, floors)
    for q in range(41):
        want = sorted(
            (-int(queries[q] @ p), ties[i], i)
            for i, p in enumerate(points)
            if i != own[q] and queries[q] @ p >= floors[q]
        )[:7]
        mine = best.query == q
        assert list(best.place[mine]) == [i for _, _, i in want]


def test_a_box_bound_passes_over_most_leaves():
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(4096, 3)) * 1000).astype(np.int64)
    tree = KDTree(points, 32)
    seen = []
    scored = tree._score
    tree._score = lambda q, o, t, active, node, best: (
        seen.extend(node.tolist()), scored(q, o, t, active, node, best)
    )
    tree.search(points[:1], np.array([0]), np.arange(4096), 5, np.array([vectors.LEAST]))
    assert len(seen) == len(set(seen)) < 40  # of 128


def test_products_are_exact_beyond_doubles():
    a = np.array([[2**30, 2**30 - 1, -(2**30)]])
    assert vectors.products(a, a[:, ::-1]).tolist() == [[dot(a[0].tolist(), a[0, ::-1].tolist())]]


@pytest.mark.parametrize("shard_rows", [16, 8192])
def test_exact_search_equals_brute_force(llm, monkeypatch, shard_rows):
    monkeypatch.setattr(exact_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(exact_search, "QUERY_ROWS", 4)
    rows = vector_rows()
    table = table_of(llm, rows, VECTORS)
    got = defaultdict(list)
    for r in dicts(exact_search.exact_search(table, F.col("vec_id") % 20 == 0, 64, k=9)):
        got[r["query"], r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    usable = whole(rows, 64)
    want = []
    for i, (q, _, v) in enumerate(usable):
        if q is not None and q % 20 == 0:
            others = [(dot(v, w), o) for j, (o, _, w) in enumerate(usable) if j != i]
            want.append((q, [(n + 1, *p) for n, p in enumerate(by_score(others)[:9])]))
    assert sorted((q, sorted(found)) for (_, q), found in got.items()) == sorted(want)
    assert sum(q == 20 for q, _ in want) == 3


def test_fewer_rows_than_asked_for_and_none(llm):
    few = table_of(llm, [(0, [1.0], 1), (1, [-1.0], 1), (2, None, 1)], VECTORS)
    ask = F.col("vec_id") % 20 == 0
    assert [
        (r["query_id"], r["rank"], r["vec_id"], r["score"])
        for r in dicts(exact_search.exact_search(few, ask, 64))
    ] == [(0, 1, 1, -4096)]
    nothing = table_of(llm, [], VECTORS)
    assert dicts(exact_search.exact_search(nothing, ask, 64)) == []
    assert dicts(hard_negatives.hard_negatives(nothing, ask, F.col("label"), 256)) == []


# --- hard negatives


@pytest.mark.parametrize("width", [1, 6, 64, 100])
def test_every_product_lies_in_its_interval(width):
    rng = np.random.default_rng(width)
    points = rng.integers(-300, 300, (200, width))
    points[0] = 0
    points[1] = points[2] * 50
    anchors = Anchors(np.concatenate((points[:20], rng.integers(-9, 9, (5, width)))))
    low, high = anchors.intervals(*encoded(points))
    exact = anchors.vectors @ points.T
    assert (low <= exact).all() and (exact <= high).all()
    lengths = np.sqrt((points**2).sum(1))
    assert (high - low <= 2.5 * anchors.length[:, None] * lengths + 1e-6).all()


def test_intervals_pass_over_rows_that_cannot_matter():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(2, 64))
    near = (centres[:1] + rng.normal(scale=0.1, size=(50, 64))) * 100
    far = (centres[1:] + rng.normal(scale=0.1, size=(50, 64))) * 100
    anchors = Anchors(near[:1].astype(np.int64))
    _, high = anchors.intervals(*encoded(np.concatenate((near, far)).astype(np.int64)))
    scores = anchors.vectors @ near.astype(np.int64).T
    assert (high[0, 50:] < np.sort(scores[0])[-10]).all()


@pytest.mark.parametrize("shard_rows", [16, 8192])
def test_hard_negatives_equal_brute_force(llm, monkeypatch, shard_rows):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    rows = vector_rows()
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(
        table_of(llm, rows, VECTORS), F.col("vec_id") % 20 == 0, moved, 256, 3, 4
    )
    mine = sorted(
        (r["anchor_id"], r["positive_id"], r["positive_score"], r["rank"], r["negative_id"],
         r["negative_score"])
        for r in dicts(got)
    )
    usable = [
        (i, (label + 1) % 3 if i is not None and i % 7 == 0 else label, v)
        for i, label, v in whole(rows, 256, labelled=True)
    ]
    want = []
    for i, (a, label, v) in enumerate(usable):
        if a is None or a % 20:
            continue
        others = [(dot(v, w), o, l) for j, (o, l, w) in enumerate(usable) if j != i]
        for score, positive in by_score([p[:2] for p in others if p[2] == label])[:3]:
            inside = [
                p[:2] for p in others if p[2] != label and 30 * score <= 100 * p[0] <= 90 * score
            ]
            for rank, (s, n) in enumerate(by_score(inside)[:4], 1):
                want.append((a, positive, score, rank, n, s))
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert want


# --- prefix trie


def test_double_array_holds_exactly_its_sequences():
    rng = random.Random(5)
    sequences = [[rng.choice("abcdefgh") for _ in range(rng.randrange(6))] for _ in range(200)]
    trie, codes, nodes = packed(sequences)
    prefixes = {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)}
    assert len(nodes) == len(set(nodes)) == len(prefixes)

    def walk(sequence):
        node = 0
        for turn in sequence:
            node = trie.child(node, codes[turn])
        return node

    assert len({walk(p) for p in prefixes}) == len(prefixes)
    for prefix in prefixes:
        for turn in codes.keys() - {p[-1] for p in prefixes if p and p[:-1] == prefix}:
            with pytest.raises(KeyError):
                trie.child(walk(prefix), codes[turn])


def test_children_find_room_beyond_the_arrays():
    trie = DoubleArray()
    first = trie.place(0, list(range(0, 400, 2)))
    second = trie.place(first[0], [0, 1, 2, 3])
    assert len({*first, *second}) == 204 and all(trie.check[s] == first[0] for s in second)


CONVERSATIONS = ("conv_id bigint", "turn bigint", "role string", "text string")


def brute_force(rows, family=5, heads=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        first = c - int(math.fmod(c, family))
        rebuilt = (*own.get(first, [])[:h], *turns[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    out = []
    for node, convs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        leaf = [v for v in below if not any(w[:-1] == v for w in members if w)]
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                sum(w[:-1] == node for w in members if w),
                len(leaf),
                sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v),
                hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda r: (r[1], r[0]))


def random_conversations(seed, n=60, alphabet="ab", longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(-5, n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "user", "é"]), rng.choice(alphabet)))
    rows += [(None, 1, "user", "no id"), (70, None, None, None), (70, None, None, None)]
    rows += [(71, 1, "user", "b"), (71, 1, "user", "a"), (71, None, "user", "ü"), (2**62, 1, "", "")]
    # one conversation many times, and a long common beginning
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(3)]
    rows += [
        (c, t, "user", f"long {t}" if t < 20 else f"{c} {t}") for c in range(2000, 2040, 5) for t in range(23)
    ]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [1, 7, 20_000])
def test_trie_equals_brute_force(llm, turns):
    rows = random_conversations(turns)
    table = table_of(llm, rows, CONVERSATIONS)
    convs = with_shared_heads(conversation_turns(table))
    got = [
        tuple(r[c] for c in prefix_trie.OUTPUT)
        for r in dicts(prefix_trie.prefix_trie(convs, turns, turns))
    ]
    assert sorted(got, key=lambda r: (r[1], r[0])) == brute_force(rows)


def test_conversations_without_turns_and_empty_tables(llm):
    schema = "conv_id bigint, turns array<string>, sizes array<int>"
    bare = llm.createDataFrame([(3, [], []), (4, [], [])], schema)
    (root,) = dicts(prefix_trie.prefix_trie(bare))
    assert root == {
        "conv_id": 3, "depth": 0, "parent_conv_id": None, "n_convs": 2, "n_children": 0,
        "n_leaves": 1, "saved_tokens": 0, "ends_sha256": hashlib.sha256(b"3,4").hexdigest(),
    }
    none = conversation_turns(table_of(llm, [], CONVERSATIONS))
    assert dicts(prefix_trie.prefix_trie(with_shared_heads(none))) == []


def test_ids_of_one_conversation_are_hashed_in_order(llm):
    ids = [*range(-600, 5000, 7), 2**40, -(2**40)]
    convs = llm.createDataFrame(
        [(i, ["0" * 32], [1]) for i in ids], "conv_id bigint, turns array<string>, sizes array<int>"
    )
    (row,) = dicts(prefix_trie.distinct_sequences(convs))
    expected = ",".join(map(str, sorted(ids)))
    assert row["ends"] == hashlib.sha256(expected.encode()).hexdigest()
    assert (row["n"], row["least"]) == (len(ids), -(2**40))


def test_table_of_arrow_schema():
    made = prefix_trie._table([], prefix_trie.NODES)
    assert made.schema.field("ancestors").type == pa.list_(pa.string())
