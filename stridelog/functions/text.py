"""String predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column


def like_prefix(col: Column, pattern: str) -> Column:
    """``col LIKE pattern`` with the literal head of the pattern tested first.

    In these patterns ``_`` is the one-character wildcard, so Spark has to evaluate them as
    regular expressions. The ``startswith`` in front rejects nearly every row on raw bytes
    and, unlike the regular expression, can be pushed to the Parquet reader.
    """
    head = re.split(r"[%_]", pattern, maxsplit=1)[0]
    return col.startswith(head) & col.like(pattern)
