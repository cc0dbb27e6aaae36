"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tracklake", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    return SparkSession.builder.appName(name).config(map=defaults | conf).getOrCreate()
