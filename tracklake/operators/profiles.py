"""The data of profile, tornado and locus plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orient(windows: DataFrame, n_bins: int, oriented: bool = False) -> DataFrame:
    """Mirror the bins of minus intervals, unless the windows are oriented already."""
    if oriented or "strand" not in windows.columns:
        return windows
    return windows.withColumn("bin", F.when(F.col("strand") == "-", n_bins - 1 - F.col("bin")).otherwise(F.col("bin")))


def metaplot(windows: DataFrame, groups: DataFrame | None = None, error: str = "sem") -> DataFrame:
    """label, bin, mean and err of the values over intervals; nulls are skipped.

    groups: sample and label.  A group's profile is the mean of its samples'
    means, and its error is taken across samples.
    """
    if error not in ("sem", "std"):
        raise ValueError(f"{error!r} is neither sem nor std")
    spread = lambda v: F.stddev_pop(v) / F.sqrt(F.count(v)) if error == "sem" else F.stddev_pop(v)
    if groups is None:
        return windows.groupBy(F.col("sample").alias("label"), "bin").agg(F.avg("value").alias("mean"), spread("value").alias("err"))
    means = windows.groupBy("sample", "bin").agg(F.avg("value").alias("m")).join(F.broadcast(groups), "sample")
    return means.groupBy("label", "bin").agg(F.avg("m").alias("mean"), spread("m").alias("err"))


#: Parts in which rows are ranked.
PARTS = 64


def _ranked(rows: DataFrame, order: Column) -> DataFrame:
    """row_rank from 0 by ``order`` (a double, nulls last) and range_index, numbered in parts.

    Approximate quantiles of the order bound the parts, and what stands before
    a part is the sum of the counts of those below it.  Equal values are in
    one part.
    """
    placed = rows.select("range_index", F.coalesce(order.cast("double"), F.lit(float("inf"))).alias("o"))
    bounds = placed.agg(F.percentile_approx("o", [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda x: x < F.col("o"))) if bounds else F.lit(0)
    placed = placed.withColumn("part", part)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("o", "range_index")) - 1
    numbered = placed.withColumn("within", within).join(F.broadcast(starts), "part")
    return numbered.select("range_index", (F.col("before") + F.col("within")).cast("int").alias("row_rank"))


def tornado(windows: DataFrame, sort_by: str | None = "mean", panel: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """panel, range_index, row_rank, bin, value; rows in the order of one panel.

    sort_by: mean, mean_r (ascending), max, or None for the given order.
    """
    cells = windows.withColumn("panel", F.col("sample"))
    if groups is not None:
        joined = windows.join(F.broadcast(groups), "sample")
        cells = joined.groupBy(F.col("label").alias("panel"), "range_index", "bin").agg(F.avg("value").alias("value"))
    first = panel if panel is not None else cells.agg(F.min("panel")).first()[0]
    own = cells.where(F.col("panel") == first).groupBy("range_index").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    keys = {"mean": -F.col("mean"), "mean_r": F.col("mean"), "max": -F.col("max"), None: F.col("range_index")}
    if sort_by not in keys:
        raise ValueError(f"{sort_by!r} is none of mean, mean_r, max, None")
    ranks = _ranked(own, keys[sort_by])
    return cells.join(ranks.select("range_index", "row_rank"), "range_index").select("panel", "range_index", "row_rank", "bin", "value")


def colour_limits(cells: DataFrame, scale_each: bool = False) -> DataFrame:
    """99th percentile of the absolute values, over all panels or for each."""
    made = F.percentile(F.abs("value"), F.lit(0.99)).alias("vmax")
    return cells.groupBy("panel").agg(made) if scale_each else cells.agg(made)


def difference(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Forward less reverse values of windows."""
    key = ["range_index", "bin", "sample"]
    return forward.join(reverse.select(*key, F.col("value").alias("_r")), key).withColumn("value", F.col("value") - F.col("_r")).drop("_r")


def locus(tracks: dict[str, DataFrame]) -> DataFrame:
    """track, kind, sample, start, end, value of points in a locus.

    tracks: by modality, coverage or stranded_coverage segments, methylation or
    variant sites; ValueError for any other.
    """
    from .sites import allele_frequency

    found = None
    for kind, df in tracks.items():
        if kind in ("coverage", "stranded_coverage"):
            rows = df.select(F.lit(kind).alias("kind"), "sample", "start", "end", F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("class"))
        elif kind == "methylation":
            rows = df.select(F.lit(kind).alias("kind"), "sample", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("methylation_pct").alias("value"), F.lit(None).cast("string").alias("class"))
        elif kind == "variant":
            rows = allele_frequency(df).select(F.lit(kind).alias("kind"), "sample", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), F.col("allele_frequency").alias("value"), F.col("genotype_class").alias("class"))
        else:
            raise ValueError(f"{kind!r} is none of coverage, stranded_coverage, methylation, variant")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no tracks given")
    return found
