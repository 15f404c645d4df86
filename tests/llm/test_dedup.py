"""Exact, near and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stridelog.llm import near_dedup
from stridelog.llm.components import connected_components
from stridelog.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from stridelog.llm.near_dedup import confirmed_links, drop_near_duplicates, near_components
from stridelog.llm.substring_dedup import remove_repeats, substring_dedup

from .conftest import awkward, by_id, dicts, prose, table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return (text or "").encode().split()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- exact


def test_exact_equals_brute_force(docs):
    groups = defaultdict(list)
    for i, t in awkward():
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0))
    expected = sorted(
        (i is None, i or 0, len(g), sha(bare.encode()), min(g)[2])
        for bare, g in groups.items()
        for _, none, i in [(a, b, None if b else c) for a, b, c in g]
    )
    got = exact_dedup(docs)
    rows = dicts(got)
    assert sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["group_size"], r["text_sha256"], r["keep_id"] or 0)
        for r in rows
    ) == expected
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept})
    assert by_id(got)[1]["keep_id"] == 3


def test_equal_digests_with_unlike_bytes_are_told_apart(llm, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))
    rows = by_id(exact_dedup(table(llm, [(1, "a"), (2, "b"), (3, "a "), (4, "b")])))
    assert {i: (r["keep_id"], r["group_size"]) for i, r in rows.items()} == {
        1: (3, 2), 3: (3, 2), 2: (2, 2), 4: (2, 2)
    }


def test_exact_stage_keeps_one_row_with_all_columns(docs, empty):
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [SPACE.sub("", r["text"] or "") for r in dicts(kept)]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", t or "") for _, t in awkward()})
    assert drop_exact_duplicates(empty).count() == exact_dedup(empty).count() == 0


# --- near


def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        out.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()))
    return out


def brute_components(rows, size=2, threshold=80):
    sets = sets_of(rows, size)
    label = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                low, high = sorted((label[x], label[y]))
                label = [low if v == high else v for v in label]
    ids = defaultdict(list)
    for v, (i, _) in zip(label, sets):
        ids[v].append(i)
    smallest = {v: min((i for i in g if i is not None), default=None) for v, g in ids.items()}
    return sorted(
        (str(i), len(s), str(smallest[v] if s else i)) for v, (i, s) in zip(label, sets)
    )


def got_components(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in dicts(df))


@pytest.mark.parametrize("size", [2, 5])
def test_near_equals_brute_force(docs, size):
    assert got_components(near_components(docs, size)) == brute_components(awkward(), size)


def chain(n: int) -> list[tuple[int, str]]:
    """Each text is near the next, the ends are far apart; and a tight group of copies."""
    words = prose(11, 100, 10**6).split()
    rows = []
    for i in range(n):
        words = words[4:] + [f"n{i}a", f"n{i}b", f"n{i}c", f"n{i}d"]
        rows.append((100 - i, " ".join(words)))
    base = prose(12, 150, 10**6).split()
    rows += [(200 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(90)]
    return rows


def test_chains_and_groups_larger_than_a_node(llm, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 8)
    rows = chain(12)
    assert got_components(near_components(table(llm, rows))) == brute_components(rows)


@pytest.mark.parametrize("depth", [4, 6, 8])
def test_pairs_at_the_threshold_meet_in_deep_nodes(depth):
    pairs = 4000 if depth < 6 else 600
    rng = np.random.default_rng(depth)
    one, leader = rng.integers(0, 1 << 32, (2, pairs, 64))
    two = np.where(rng.random(one.shape) < 0.81, one, rng.integers(0, 1 << 32, one.shape))
    left, right, leader = (x.astype("<u4") for x in (one, two, leader))
    names = ["path", "node", "leaders", "signature", "sketches"]
    pair = np.concatenate([np.arange(pairs), np.arange(pairs)])
    signatures = np.concatenate([left, right])

    def together(paths, nodes):
        """The places where both of a pair are: each path and pair that occurs twice."""
        places, n = np.unique(np.stack([paths, nodes % pairs], axis=1), axis=0, return_counts=True)
        return places[n > 1]

    def batch(level):
        paths = np.concatenate([level[:, 0], level[:, 0]])
        nodes = np.concatenate([level[:, 1], level[:, 1] + pairs])
        bytes_of = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(paths), pa.array(nodes), pa.array([[-1]] * len(nodes), pa.list_(pa.int64())),
             bytes_of(signatures[nodes]), bytes_of(leader[pair[nodes]].astype(np.uint8))],
            names,
        )

    top = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(2 * pairs)), pa.array([s.tobytes() for s in signatures], pa.binary())],
        ["node", "signature"],
    )
    out = list(near_dedup._first_level([top]))
    for d in range(1, depth + 1):
        paths, nodes = (np.concatenate([b.column(i).to_numpy() for b in out]) for i in (0, 1))
        level = together(paths, nodes)
        if d < depth:
            out = list(near_dedup._beside_leaders([batch(level)]))
    lost = pairs - len(np.unique(level[:, 1]))
    assert lost <= pairs / 1000


def test_trees_follow_from_the_target():
    assert near_dedup.missed(near_dedup.TREES) <= near_dedup.MISSED < near_dedup.missed(near_dedup.TREES - 1)


def hot_group(n: int, changed: float, seed: int) -> list[tuple[int, str]]:
    """Texts made from one: most pairs are somewhat below the threshold, some reach it."""
    rng = random.Random(seed)
    base = prose(seed, 120, 10**6).split()
    return [
        (i, " ".join(f"x{rng.random()}" if rng.random() < changed else w for w in base))
        for i in range(n)
    ]


@pytest.mark.parametrize("changed", [0.02, 0.035, 0.06])
def test_a_hot_group_loses_no_link_and_does_not_multiply(llm, monkeypatch, changed):
    """All of the search, absorption and deepest nodes included, on pairs around the threshold."""
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 16)
    rows = hot_group(250, changed, 3)
    made = []
    keep = near_dedup.staged
    monkeypatch.setattr(
        near_dedup, "staged", lambda df, name: (made.append((name, out := keep(df, name))), out)[1]
    )
    assert got_components(near_components(table(llm, rows))) == brute_components(rows)
    if changed < 0.05:
        levels = [df.count() for name, df in made if name == "compared"]
        assert max(levels) <= 8 * near_dedup.TREES * len(rows)


def test_groups_too_large_for_a_task(llm):
    rows = chain(12)
    got = near_components(table(llm, rows), group_shingles=600)
    assert got_components(got) == brute_components(rows)


def test_confirmed_links_join_what_is_connected():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    links = confirmed_links(list(range(40)), sets, 60)
    label = list(range(40))
    for a, b in links:
        inter = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * inter >= 60 * (len(sets[a]) + len(sets[b]) - inter)
        label = [label[a] if v == label[b] else v for v in label]
    for a in range(40):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 60 * (len(sets[a]) + len(sets[b]) - inter):
                assert label[a] == label[b]


def test_components_of_a_long_path_and_a_star(llm):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(100, i) for i in range(101, 160)]
    edges = llm.createDataFrame([*path, *star, (7, 7), (3, 2)], "a bigint, b bigint")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(edges.limit(0)).count() == 0


def test_near_stage(docs, empty):
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in dicts(kept)}
    assert {1, 6, 7, 8, 9, 17} <= ids and not ids & {2, 3, 18}
    assert near_components(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


# --- substrings


def brute_removed(rows, n=13):
    first = {}
    rank = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < rank(i):
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), sha(kept)))
    return sorted(out)


def got_removed(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dicts(df))


@pytest.mark.parametrize("group_suffixes", [10**6, 1])
def test_substrings_equal_brute_force(docs, group_suffixes):
    got = got_removed(substring_dedup(docs, group_suffixes=group_suffixes))
    assert got == brute_removed(awkward())


@pytest.mark.parametrize("group_suffixes", [10**6, 20])
def test_substrings_of_few_words(llm, group_suffixes):
    rows = [(i, prose(i, 5 + i, 3)) for i in range(40)]  # three words: everything repeats
    rows += [(100 - i, "was " * (10 * i)) for i in range(30)]  # one word, more than a row's suffixes
    got = got_removed(substring_dedup(table(llm, rows), group_suffixes=group_suffixes))
    assert got == brute_removed(rows)


def test_substring_stage(docs, empty):
    done = remove_repeats(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    rows = by_id(done)
    assert rows[1]["text"] == prose(1, 120) and rows[2]["text"] == ""
    assert rows[13]["text"] == prose(6, 60) and rows[13]["n_chars"] == len(prose(6, 60))
    assert rows[6]["text"] is None and rows[8]["text"] == " \t\n\x0b\x0c\r"
    assert remove_repeats(empty).count() == 0 and substring_dedup(empty).count() == 0
