"""Reduction of coverage over ranges, and windows of it, with implicit zeros.

Coverage is run-length segments with values above 0; a base without a segment
is 0.  No operator lists single bases unless its result does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Reduction
from .intervals import clip, overlap_join
from .ranges import anchored, window_extent


def wanted_strand(mode: int | str | None) -> Column:
    """Strand of the coverage for a range: 1 same, 2 opposite, else the total."""
    if mode in (1, "1", "same"):
        return F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("*")
    if mode in (2, "2", "opposite"):
        return F.when(F.col("strand") == "+", "-").when(F.col("strand") == "-", "+").otherwise("*")
    return F.lit("*")


def _overlaps(side: DataFrame, coverage: DataFrame, want: Column, width: int | None, stranded: bool) -> DataFrame:
    """Pairs of ``side`` and the segments of the strand that it wants."""
    if not stranded:
        return overlap_join(side, coverage.where(F.col("strand") == want).drop("strand"), width, "c_")
    side = side.withColumn("_want", want)
    # of the three strands only those that a range wants are shuffled
    read = coverage.join(F.broadcast(side.select(F.col("_want").alias("strand")).distinct()), "strand", "left_semi")
    return overlap_join(side, read, width, "c_", {"_want": "strand"})


def _sums(held: DataFrame, keys: list[str], kinds: list[Reduction]) -> DataFrame:
    """One row per key of what ``_made`` needs, from (value, n) segments clipped to the key's bases.

    Segments are summed at once, so that most of them end in the task of the
    join; only a median needs them by value, and then a list of no more than
    the key's distinct values.
    """
    value, n = F.col("value"), F.col("n")
    if Reduction.MEDIAN in kinds:
        # dealt out by key at once: a list of one or two values in each task would only be sorted twice
        held = held.groupBy(*keys, "value").agg(F.sum("n").alias("n")).repartition(*keys)
    found = {}
    if {Reduction.SUM, Reduction.MEAN} & set(kinds):
        found["_area"] = F.sum(value * n)
    if Reduction.MAX in kinds:
        found["_max"] = F.max(value)
    if Reduction.MIN in kinds:
        found["_min"] = F.min(value)
    if {Reduction.MAX, Reduction.MIN, Reduction.MEDIAN} & set(kinds):
        found["_covered"] = F.sum(n)
    if Reduction.MEDIAN in kinds:
        found["_values"] = F.collect_list(F.when(value.isNotNull(), F.struct(value.cast("double").alias("value"), n.cast("bigint").alias("n"))))
        found["_known"] = F.sum(F.when(value.isNotNull(), n))
    return held.groupBy(*keys).agg(*(made.alias(name) for name, made in found.items()))


def _made(kind: Reduction, length: Column) -> Column:
    """A reduction over ``length`` bases from the columns of ``_sums``; bases without a segment are 0."""
    zero = F.lit(0)
    bare = length - F.coalesce("_covered", zero)
    if kind is Reduction.SUM:
        return F.coalesce("_area", zero)
    if kind is Reduction.MEAN:
        return F.coalesce("_area", zero) / length
    if kind is Reduction.MAX:
        return F.when(bare > 0, F.greatest("_max", zero)).otherwise(F.col("_max"))
    if kind is Reduction.MIN:
        return F.when(bare > 0, F.least("_min", zero)).otherwise(F.col("_min"))
    # the values at both middle places of all bases, in one pass over the sorted list
    rest = F.when(bare > 0, F.array(F.struct(F.lit(0.0).alias("value"), bare.cast("bigint").alias("n")))).otherwise(F.expr("cast(array() as array<struct<value: double, n: bigint>>)"))
    whole = F.array_sort(F.concat(F.coalesce("_values", F.expr("cast(array() as array<struct<value: double, n: bigint>>)")), rest))
    total = F.coalesce("_known", zero) + F.greatest(bare, zero)
    none = F.lit(None).cast("double")

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["low"], F.when(seen * 2 >= total, x["value"])).alias("low"), F.coalesce(acc["high"], F.when(seen * 2 > total, x["value"])).alias("high"))

    start = F.struct(F.lit(0).cast("bigint").alias("seen"), none.alias("low"), none.alias("high"))
    return F.aggregate(whole, start, step, lambda acc: (acc["low"] + acc["high"]) / 2)


def reduce_ranges(coverage: DataFrame, ranges: DataFrame, contigs: DataFrame, samples: DataFrame, reductions: list[str] | None = None, strand_mode: int | str | None = None, min_count: int = 1, width: int | None = None) -> DataFrame:
    """One row per (range_index, sample): sum, count, mean and the reductions.

    ranges: range_index, contig, start, end, and strand for a strand mode.
    Ranges are clipped to their contig and the result holds clipped
    coordinates; those left empty are dropped.  ``mean`` is null where a range
    has less than ``min_count`` bases.
    """
    names = list(dict.fromkeys(["sum", "mean", *(Reduction.of(r).value for r in reductions or [])]))
    ranges = clip(ranges, contigs).withColumn("range_length", F.col("end") - F.col("start"))
    keys = [c for c in ("range_index", "contig", "start", "end", "range_length", "strand", "name") if c in ranges.columns]
    side = ranges.select(*keys)
    stranded = str(strand_mode) in ("1", "2", "same", "opposite")
    slim = ranges.select("range_index", "contig", "start", "end", *(["strand"] if stranded else []))
    pairs = _overlaps(slim, coverage, wanted_strand(strand_mode), width, stranded)
    held = pairs.select(
        "range_index", F.col("c_sample").alias("sample"), F.col("c_value").alias("value"),
        (F.least("end", "c_end") - F.greatest("start", "c_start")).alias("n"),
    )
    kinds = [Reduction.of(n) for n in names]
    sums = _sums(held, ["range_index", "sample"], kinds)
    # dealt out first: all ranges may come from one small file
    spine = side.repartition("range_index").crossJoin(F.broadcast(samples.select(F.col("sample_id").alias("sample"))))
    whole = spine.join(sums, ["range_index", "sample"], "left")
    made = {k.value: F.coalesce(_made(k, F.col("range_length")), F.lit(0)).cast("double" if k in (Reduction.MEAN, Reduction.MEDIAN) else "bigint") for k in kinds}
    made["mean"] = F.when(F.col("range_length") >= min_count, made["mean"])
    return whole.select("range_index", "sample", *keys[1:], *(c.alias(n) for n, c in made.items()), F.col("range_length").cast("bigint").alias("count"))


def extract_windows(coverage: DataFrame, ranges: DataFrame, contigs: DataFrame, samples: DataFrame, fixed_width: int | None = None, upstream: int | None = None, downstream: int | None = None, anchor: str = "midpoint", bin_size: int | None = None, bin_agg: str = "mean", strand_aware: bool = False, force_strand: str | None = None, width: int | None = None) -> DataFrame:
    """(interval, bin or position, sample, value) of windows around ranges.

    With no extent, the ranges themselves are the windows, and a remainder
    that fills no bin is dropped.  Bases outside the contig are null: they
    count neither in a bin's mean nor in its length, and a bin wholly outside
    is null.  Strand-aware windows read + ranges from the + coverage and all
    others from the - coverage.
    """
    kind = Reduction.of(bin_agg)
    step = bin_size or 1
    if fixed_width is None and upstream is None and downstream is None:
        up = 0
        wins = ranges.withColumns({"win_start": F.col("start"), "win_end": F.col("end")})
        n_bins = F.floor((F.col("win_end") - F.col("win_start")) / step)
    else:
        up, down = window_extent(fixed_width, upstream, downstream)
        if (up + down) % step:
            raise ValueError(f"a window of {up + down} is not divisible into bins of {step}")
        wins = anchored(ranges, up, down, anchor)
        n_bins = F.lit((up + down) // step)
    stranded = force_strand not in ("+", "-") and strand_aware and "strand" in ranges.columns
    if force_strand in ("+", "-"):
        want = F.lit(force_strand)
    elif stranded:
        want = F.when(F.col("strand") == "+", "+").otherwise("-")
    else:
        want = F.lit("*")
    keys = [c for c in ("range_index", "contig", "start", "end", "strand", "name") if c in ranges.columns]
    wins = wins.join(F.broadcast(contigs), "contig").select(*keys, "win_start", "win_end", "length", n_bins.cast("bigint").alias("_bins"))
    # dealt out first: all ranges may come from one small file
    spine = wins.where("_bins > 0").repartition("range_index").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_bins") - 1)))
    spine = spine.withColumns({"_s": F.col("win_start") + F.col("bin") * step, "_e": F.col("win_start") + (F.col("bin") + 1) * step})
    spine = spine.withColumns({"_s": F.greatest("_s", F.lit(0)), "_e": F.least("_e", "length")}).withColumn("_n", F.greatest(F.col("_e") - F.col("_s"), F.lit(0)))
    # overlaps of whole windows with segments, then one row for each bin that both touch
    core = wins.where("_bins > 0").select("range_index", "contig", "win_start", F.greatest("win_start", F.lit(0)).alias("start"), F.least(F.col("win_start") + F.col("_bins") * step, F.col("length")).alias("end"), *(["strand"] if stranded else []))
    pairs = _overlaps(core.where("end > start"), coverage, want, width, stranded)
    cut = pairs.select("range_index", "win_start", F.col("c_sample").alias("sample"), F.col("c_value").alias("value"), F.greatest("start", "c_start").alias("s"), F.least("end", "c_end").alias("e"))
    cut = cut.withColumn("bin", F.explode(F.sequence(F.floor((F.col("s") - F.col("win_start")) / step), F.floor((F.col("e") - 1 - F.col("win_start")) / step))))
    low, high = F.col("win_start") + F.col("bin") * step, F.col("win_start") + (F.col("bin") + 1) * step
    cell = ["range_index", "bin", "sample"]
    held = cut.select(*cell, "value", (F.least("e", high) - F.greatest("s", low)).alias("n"))
    cells = spine.select(*keys, "bin", "_n").crossJoin(F.broadcast(samples.select(F.col("sample_id").alias("sample"))))
    whole = cells.join(_sums(held, cell, [kind]), cell, "left")
    value = F.when(F.col("_n") > 0, F.coalesce(_made(kind, F.col("_n")), F.lit(0)).cast("double"))
    return whole.select(*cell, value.alias("value"), *keys[1:], (F.col("bin") * step - up).cast("bigint").alias("offset"))


def region_slice(coverage: DataFrame, contigs: DataFrame, contig: str, start: int | None = None, end: int | None = None, strand: str = "*", samples: list[str] | None = None) -> DataFrame:
    """Segments of a region, cut to it; pushes contig, strand and bounds to the scan."""
    length = contigs.where(F.col("contig") == contig).select("length").first()
    if length is None:
        raise ValueError(f"unknown contig {contig}")
    start, end = start or 0, length[0] if end is None else end
    if not 0 <= start < end <= length[0]:
        raise ValueError(f"{contig}:{start}-{end} is outside the contig")
    found = coverage.where((F.col("contig") == contig) & (F.col("strand") == strand) & (F.col("end") > start) & (F.col("start") < end))
    if samples is not None:
        found = found.where(F.col("sample").isin(samples))
    return found.withColumns({"start": F.greatest("start", F.lit(start)).cast("bigint"), "end": F.least("end", F.lit(end)).cast("bigint")})


def region_dense(coverage: DataFrame, contigs: DataFrame, samples: DataFrame, contig: str, start: int, end: int, strand: str = "*") -> DataFrame:
    """(sample, pos, value) of every base of a region, with its zeros."""
    cut = region_slice(coverage, contigs, contig, start, end, strand)
    bases = cut.select("sample", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "value")
    spine = coverage.sparkSession.range(start, end).withColumnRenamed("id", "pos").crossJoin(F.broadcast(samples.select(F.col("sample_id").alias("sample"))))
    return spine.join(bases, ["sample", "pos"], "left").select("sample", "pos", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))


def sparsity(coverage: DataFrame, contigs: DataFrame, samples: DataFrame) -> DataFrame:
    """Percentage of zero bases, as the mean over contigs, by sample."""
    covered = coverage.where("strand = '*'").groupBy("sample", "contig").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    cells = samples.select(F.col("sample_id").alias("sample")).crossJoin(F.broadcast(contigs))
    share = cells.join(covered, ["sample", "contig"], "left").withColumn("s", 100 * (1 - F.coalesce("n", F.lit(0)) / F.col("length")))
    return share.groupBy("sample").agg(F.avg("s").alias("sparsity"))


def library_sizes(samples: DataFrame) -> DataFrame:
    """sample and its total reads as a double; null for an incomplete one."""
    return samples.select(F.col("sample_id").alias("sample"), F.when(F.col("completed"), F.col("total_reads").cast("double")).alias("library_size"))


def sweep(blocks: DataFrame) -> DataFrame:
    """Run-length coverage of aligned blocks (contig, start, end, sample, strand).

    Starts and ends are summed by position first, so the running sum sees one
    row per position and not one per read.
    """
    from pyspark.sql import Window

    up = blocks.select("contig", "sample", "strand", F.col("start").alias("pos"), F.lit(1).alias("d"))
    down = blocks.select("contig", "sample", "strand", F.col("end").alias("pos"), F.lit(-1).alias("d"))
    steps = up.union(down).groupBy("contig", "sample", "strand", "pos").agg(F.sum("d").alias("d")).where("d != 0")
    order = Window.partitionBy("contig", "sample", "strand").orderBy("pos")
    depth = steps.withColumns({"value": F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)), "end": F.lead("pos").over(order)})
    return depth.where("value > 0 and end is not null").select("contig", F.col("pos").alias("start"), "end", "sample", "strand", "value")
