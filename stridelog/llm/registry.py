"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit_packing,
    byte_bpe,
    exact_dedup,
    exact_search,
    hard_negatives,
    language_id,
    license_scan,
    near_dedup,
    prefix_trie,
    quality_rules,
    substring_dedup,
    token_records,
    toxicity,
)
from .shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_best_fit_packing": best_fit_packing.op9_best_fit_packing,
    "op10_token_records": token_records.op10_token_records,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_exact_search": exact_search.op13_exact_search,
}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

SQL = {
    **substring_dedup.SQL,
    **quality_rules.SQL,
    **license_scan.SQL,
    **exact_dedup.SQL,
    **hard_negatives.SQL,
    **prefix_trie.SQL,
    **exact_search.SQL,
}
