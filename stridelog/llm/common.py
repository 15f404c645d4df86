"""Helpers shared by the operators: shared storage, input columns, null-safe joins."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators see it: the ASCII characters that ``bytes.split()`` splits at.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may leave the setting out (as tests do); it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="stridelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm/{uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, computes ``df`` once for several uses and makes values that depend on the
    order of rows stable; a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where NULL equals NULL; the right keys are dropped."""
    names = unused(left, *(f"other_{k}" for k in keys))
    right = right.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[n]) for k, n in zip(keys, names)))
    joined = left.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names)


def stripped(text: Column) -> Column:
    """The text without its white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")


def is_held_out(doc_id: Column) -> Column:
    """The quarter of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
