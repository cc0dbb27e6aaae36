"""Quantile peaks of tiled signal, all samples in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import merge_ranges, overlap_join, subtract, tile_genome


def quantile_peaks(tiles: DataFrame, quantile: float = 0.98, merge: bool = True, blacklist: DataFrame | None = None, slack: int = 0) -> DataFrame:
    """sample, contig, start, end of tiles at or above a sample's threshold.

    The threshold is the quantile of its positive tiles; a quantile of 1 or
    more gives no peaks.  tiles: sample, contig, start, end, signal.
    """
    if quantile >= 1:
        return tiles.select("sample", "contig", "start", "end").limit(0)
    limit = tiles.where("signal > 0").groupBy("sample").agg(F.percentile("signal", F.lit(float(quantile))).alias("_t"))
    high = tiles.join(F.broadcast(limit), "sample").where("signal >= _t").select("sample", "contig", "start", "end")
    if merge:
        high = merge_ranges(high, ["sample", "contig"], slack)
    if blacklist is not None:
        high = subtract(high, blacklist.select("contig", "start", "end"))
    return high


def tile_signal(signal: DataFrame, tiles: DataFrame, width: int | None = None) -> DataFrame:
    """Mean of segments (sample, contig, start, end, value) over each tile; gaps are 0."""
    cut = overlap_join(tiles, signal, width, "s_")
    area = F.sum(F.col("s_value") * (F.least("end", "s_end") - F.greatest("start", "s_start")))
    means = cut.groupBy(F.col("s_sample").alias("sample"), "contig", "start", "end").agg(area.alias("_a"))
    return means.withColumn("signal", F.col("_a") / (F.col("end") - F.col("start"))).drop("_a")


def call_peaks(signal: DataFrame, contigs: DataFrame, tile: int = 128, quantile: float = 0.98, blacklist: DataFrame | None = None, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(peaks, log tile signal) of samples' segments."""
    tiles = tile_genome(contigs, tile)
    if blacklist is not None:
        tiles = subtract(tiles, blacklist.select("contig", "start", "end"))
    logged = tile_signal(signal, tiles).withColumn("signal", F.log1p("signal"))
    return quantile_peaks(logged, quantile, merge, blacklist), logged
