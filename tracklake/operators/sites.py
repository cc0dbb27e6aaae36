"""Sparse sites: methylation and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import point_join
from .ranges import anchored, window_extent


def methylated(split: bool) -> tuple[Column, Column]:
    """(methylated, unmethylated) counts; a split schema has mC, hmC and C."""
    if split:
        return F.col("n_mc") + F.col("n_hmc"), F.col("n_c")
    return F.col("n_methylated"), F.col("n_unmethylated")


def count_methylation(sites: DataFrame, features: DataFrame, samples: DataFrame, split: bool = False, width: int | None = None) -> DataFrame:
    """Per (range_index, sample): counts, covered sites, ratio and mean percentage; and sites in all."""
    m, u = methylated(split)
    side = features.select("range_index", "contig", "start", "end")
    held = point_join(sites.withColumns({"_m": m, "_u": u}), side, width, "f_")
    sums = held.groupBy(F.col("f_range_index").alias("range_index"), "sample").agg(
        F.sum("_m").cast("bigint").alias("n_methylated"), F.sum("_u").cast("bigint").alias("n_unmethylated"),
        F.sum(F.when(F.col("methylation_pct").isNotNull(), 1).otherwise(0)).cast("bigint").alias("n_cpg_covered"),
        F.avg("methylation_pct").alias("mean_pct"),
    )
    totals = held.select(F.col("f_range_index").alias("range_index"), "pos").distinct().groupBy("range_index").agg(F.count(F.lit(1)).alias("n_cpg_total"))
    spine = side.crossJoin(F.broadcast(samples.select(F.col("sample_id").alias("sample"))))
    whole = spine.join(sums, ["range_index", "sample"], "left").join(totals, "range_index", "left")
    whole = whole.na.fill(0, ["n_methylated", "n_unmethylated", "n_cpg_covered", "n_cpg_total"])
    ratio = F.try_divide(F.col("n_methylated"), F.col("n_methylated") + F.col("n_unmethylated"))
    return whole.withColumn("methylation_ratio", ratio.cast("double"))


def methylation_windows(sites: DataFrame, ranges: DataFrame, samples: DataFrame, n_bins: int, variable: str = "methylation_pct", fixed_width: int | None = None, upstream: int | None = None, downstream: int | None = None, anchor: str = "midpoint", width: int | None = None) -> DataFrame:
    """(range_index, bin, sample, value) means of sites in windows, 5' to 3'.

    The bin of a site is its place times n_bins over the width, mirrored on
    the minus strand; such results are already oriented.  Count variables of a
    site that another sample has read 0, as in a dense table; percentages of
    it are missing.  Bins without a site are null.
    """
    up, down = window_extent(fixed_width, upstream, downstream)
    size = up + down
    wins = anchored(ranges, up, down, anchor)
    minus = F.col("strand") == "-" if "strand" in wins.columns else F.lit(False)
    side = wins.select("range_index", "contig", F.col("win_start").alias("start"), F.col("win_end").alias("end"), minus.alias("_minus"))
    if variable != "methylation_pct":
        every = sites.select("contig", "pos").distinct().crossJoin(F.broadcast(samples.select(F.col("sample_id").alias("sample"))))
        sites = every.join(sites, ["contig", "pos", "sample"], "left").na.fill(0, [variable])
    held = point_join(sites, side, width, "w_")
    place = F.col("pos") - F.col("w_start")
    place = F.when(F.col("w__minus"), size - 1 - place).otherwise(place)
    means = held.withColumn("bin", F.floor(place * n_bins / size)).groupBy(F.col("w_range_index").alias("range_index"), "bin", "sample").agg(F.avg(variable).alias("value"))
    spine = side.select("range_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))).alias("bin"))
    spine = spine.crossJoin(F.broadcast(samples.select(F.col("sample_id").alias("sample"))))
    return spine.join(means, ["range_index", "bin", "sample"], "left")


def merge_strands(report: DataFrame) -> DataFrame:
    """CpG report rows (contig, pos, strand, n_mc, n_hmc, n_c) on the plus strand.

    Counts stop at 65535, as in the stored type of the source format.
    """
    at = F.when(F.col("strand") == "-", F.col("pos") - 1).otherwise(F.col("pos"))
    sums = report.groupBy("contig", at.alias("pos")).agg(*(F.sum(c).alias(c) for c in ("n_mc", "n_hmc", "n_c")))
    total = F.col("n_mc") + F.col("n_hmc") + F.col("n_c")
    kept = sums.withColumn("methylation_pct", (100 * F.try_divide(F.col("n_mc") + F.col("n_hmc"), total)).cast("double"))
    return kept.withColumns({c: F.least(F.col(c), F.lit(65535)).cast("int") for c in ("n_mc", "n_hmc", "n_c")})


def join_split_reports(mc: DataFrame | None, hmc: DataFrame | None) -> DataFrame:
    """Reports of mC and hmC (contig, pos, strand, n_mod, n_not_mod) as one.

    The total is that of the mC report; a missing report, or a site that one of
    them lacks, counts 0 there.
    """
    if mc is None and hmc is None:
        raise ValueError("give an mC or an hmC report")
    key = ["contig", "pos", "strand"]
    if mc is None or hmc is None:
        own = mc if mc is not None else hmc
        zero, mod = F.lit(0), F.col("n_mod")
        return own.select(*key, (mod if mc is not None else zero).alias("n_mc"), (zero if mc is not None else mod).alias("n_hmc"), F.col("n_not_mod").alias("n_c"))
    other = hmc.select(*key, F.col("n_mod").alias("_h"))
    joined = mc.join(other, key, "full_outer").na.fill(0, ["n_mod", "n_not_mod", "_h"])
    left = F.greatest(F.col("n_not_mod") - F.col("_h"), F.lit(0))
    return joined.select(*key, F.col("n_mod").alias("n_mc"), F.col("_h").alias("n_hmc"), left.alias("n_c"))


def as_split(sites: DataFrame) -> DataFrame:
    """Sites without the split read as mC only."""
    return sites.withColumns({"n_mc": F.col("n_methylated"), "n_hmc": F.lit(0), "n_c": F.col("n_unmethylated")})


def dense_sites(sites: DataFrame, samples: DataFrame, fill: dict[str, object]) -> DataFrame:
    """Every position of any sample for every sample, with the given fills."""
    every = sites.select("contig", "pos").distinct().crossJoin(F.broadcast(samples.select(F.col("sample_id").alias("sample"))))
    joined = every.join(sites, ["contig", "pos", "sample"], "left")
    return joined.na.fill({k: v for k, v in fill.items() if v is not None and k in sites.columns})


def positions(sites: DataFrame) -> DataFrame:
    return sites.select("contig", "pos").distinct()


def alleles(variants: DataFrame, samples: DataFrame) -> DataFrame:
    """ref and alt of each position, from the first sample that reports it."""
    order = F.broadcast(samples.select(F.col("sample_id").alias("sample"), "sample_idx"))
    first = F.min_by(F.struct("ref", "alt"), "sample_idx")
    return variants.join(order, "sample").groupBy("contig", "pos").agg(first.alias("a")).select("contig", "pos", "a.ref", "a.alt")


def site_region(sites: DataFrame, contig: str, start: int, end: int, inclusive: bool = False) -> DataFrame:
    """Sites in [start, end), or in [start, end] of 1-based variants."""
    high = F.col("pos") <= end if inclusive else F.col("pos") < end
    return sites.where((F.col("contig") == contig) & (F.col("pos") >= start) & high)


def allele_frequency(variants: DataFrame) -> DataFrame:
    """alt / (ref + alt), null without reads, and the genotype that it suggests."""
    af = F.try_divide(F.col("ad_alt"), F.col("ad_ref") + F.col("ad_alt")).cast("double")
    called = F.when(F.col("allele_frequency") >= 0.8, "hom_alt").when(F.col("allele_frequency") > 0.2, "het").when(F.col("allele_frequency").isNotNull(), "hom_ref")
    return variants.withColumn("allele_frequency", af).withColumn("genotype_class", called)
