"""Session settings that the library's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session in UTC whose partition columns stay strings (a bucket such as 0235 is no number)."""
    builder = SparkSession.builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
