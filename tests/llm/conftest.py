"""Awkward documents that every operator must take, and a sample of the generated ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from stridelog.llm.shipping import ship

#: The columns of documents, then some whose names operators use inside.
NAMES = (
    "row", "part", "path", "node", "digest", "n", "length", "words", "anchor", "bucket",
    "__sha", "__copy", "__words", "__kept", "sha", "copy", "kept", "other_doc_id", "__doc_id", "runs",
)
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(name, T.StringType()) for name in NAMES),
    ]
)


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    passage = prose(2, 30)
    near = base.split()
    near[60] = "changed"
    long = prose(3, 30_000, 5_000)
    return [
        (1, base),
        (2, base),  # copy
        (3, base.replace(" ", "\n\t ") + " "),  # copy but for white space; most code points
        (4, " ".join(near)),  # near copy
        (5, " ".join(near[:-1])),  # linked to 4, and to 1
        (6, None),
        (7, ""),
        (8, " \t\n\x0b\x0c\r"),
        (9, "one"),
        (10, "One"),
        (11, "released under the MIT License. MIT license, Apache License; GNU General Public License"),
        (12, prose(4, 50) + " " + passage + " " + prose(5, 40)),
        (13, passage + " " + prose(6, 60)),
        (14, passage + " " + passage + " " + passage),  # repeats within itself
        (15, "é" * 20 + "😀 x́ don't I'll 12345   ...\n\n***"),
        (16, "line one\nline one\nline two\n\nline one"),
        (17, long),
        (18, long + " end"),
        (19, "x" * 20_000),  # one very long word
        (20, "short text with <|endoftext|> inside"),
        (20, "short text with <|endoftext|> inside"),  # repeated row
        (None, "no id at all " + prose(7, 30)),
        (None, None),
    ]


def table(spark, rows, partitions: int = 3):
    """Rows (id, text) as documents, with every other column NULL or clashing in name."""
    full = [(i, t, None, None, None, *("x" for _ in NAMES)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def docs(llm):
    return table(llm, awkward())


@pytest.fixture(scope="session")
def empty(llm):
    return table(llm, [])


def dicts(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in dicts(df)}
