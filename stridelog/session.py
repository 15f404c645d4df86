"""Session settings the reports are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on: local time and dates, and errors instead of silent NULLs. Sizes,
#: adaptive execution and skew handling stay as the caller or the cluster sets them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to an existing session and return it."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
