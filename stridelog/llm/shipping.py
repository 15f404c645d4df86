"""Makes this package importable on executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application."""
    _ship(spark.sparkContext.applicationId, spark)


@cache
def _ship(_application: str, spark: SparkSession) -> None:
    folder = Path(tempfile.mkdtemp(prefix="stridelog-"))
    copy = folder / "copy" / _PACKAGE.name
    shutil.copytree(_PACKAGE, copy, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(folder / _PACKAGE.name), "zip", folder / "copy")
    spark.sparkContext.addPyFile(archive)
