"""Corpus preparation: toxic documents go, then exact and near copies, then repeated passages;
what is left is packed into sequences.

Each stage takes all that the stage before kept, as written Parquet, and returns the columns of
``documents``; the last returns packed pieces. SQL cannot express the first and third stage, so
``ORACLE_SQL`` is None and tests compare the stages with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stridelog.llm.best_fit_packing import best_fit_packing
from stridelog.llm.common import documents, staged
from stridelog.llm.exact_dedup import drop_exact_duplicates
from stridelog.llm.near_dedup import drop_near_duplicates
from stridelog.llm.shipping import ship
from stridelog.llm.substring_dedup import remove_repeats
from stridelog.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return best_fit_packing(docs, vocabulary, end_id=1, size=4096)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("near dedup", near),
    ("substring dedup", substrings),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
