"""Column functions for region strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def region_columns(region: Column) -> list[Column]:
    """contig, start and end of ``chr:start-end`` strings; null where not given."""
    bare = F.regexp_replace(region, ",", "")
    part = lambda i: F.nullif(F.regexp_extract(bare, r"^([^:]+)(?::(\d+)-(\d+))?$", i), F.lit(""))
    return [part(1).alias("contig"), part(2).cast("bigint").alias("start"), part(3).cast("bigint").alias("end")]
