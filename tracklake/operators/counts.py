"""Feature counts: sums of signal per feature and sample, rollups, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import canonical
from .signal import reduce_ranges


def count_features(coverage: DataFrame, features: DataFrame, contigs: DataFrame, samples: DataFrame, aggregate_by: str | list[str] | None = None, strand: str | None = None, strand_mode=None, integerize: bool = True, filter_zero: bool = False, canonical_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(feature_id..., sample, count) and the features' metadata.

    ``aggregate_by`` sums the counts of features with equal ids; metadata then
    has the least start, greatest end, summed length, and contig and strand of
    the first range.
    """
    if strand is not None:
        features = features.where(F.col("strand") == strand)
    if canonical_only:
        features = features.where(canonical())
    reduced = reduce_ranges(coverage, features, contigs, samples, ["sum"], strand_mode)
    signal = reduced.select("range_index", "sample", F.col("sum").cast("double").alias("count"))
    if aggregate_by is None:
        keys = ["range_index"]
        counts = signal
        meta = features.withColumn("length", F.col("end") - F.col("start"))
    else:
        keys = [aggregate_by] if isinstance(aggregate_by, str) else list(aggregate_by)
        named = features.where(F.coalesce(*(F.col(k).cast("string") for k in keys)).isNotNull())
        counts = signal.join(named.select("range_index", *keys), "range_index").groupBy(*keys, "sample").agg(F.sum("count").alias("count"))
        meta = rollup_metadata(named, keys)
    if integerize:
        counts = integers(counts)
    if filter_zero:
        counts = nonzero_features(counts, keys)
        meta = meta.join(counts.select(*keys).distinct(), keys, "left_semi")
    return counts, meta


def integers(counts: DataFrame) -> DataFrame:
    """Whole counts; halves go to the even neighbour."""
    return counts.withColumn("count", F.bround("count").cast("bigint"))


def rollup_metadata(features: DataFrame, keys: list[str]) -> DataFrame:
    """One row per id: bounds, summed length, contig and strand of the first range."""
    firsts = [F.min_by(c, "range_index").alias(c) for c in ("contig", "strand") if c in features.columns]
    return features.groupBy(*keys).agg(*firsts, F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("length"))


def nonzero_features(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of features that are not zero in all samples."""
    some = counts.groupBy(*keys).agg(F.max(F.abs("count")).alias("_m")).where("_m > 0").select(*keys)
    return counts.join(some, keys, "left_semi")


def to_matrix(counts: DataFrame, keys: list[str], samples: list[str], value: str = "count") -> DataFrame:
    """Features by samples; the samples are given, so that the columns are stable."""
    return counts.groupBy(*keys).pivot("sample", samples).agg(F.first(value))
