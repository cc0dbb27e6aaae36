"""Interval algebra: overlap joins, merging, subtraction, windows, masks.

Intervals are 0-based and half open.  Theta joins go through an equi-join on
``(contig, level, bin)``.  Bins are about as wide as the left intervals, and
64 times wider on each level above, so that an interval of any length lies in
some dozens of bins of its own level.  A pair meets on the level of its longer
interval, and counts in the first bin that both touch, so no pair comes twice
and no distinct is needed.  A hot contig is spread over its bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a level to the length up to which an interval is on it, and levels in all.
FAN, LEVELS = 64, 6
#: Least and greatest width of the lowest level's bins.
NARROW, WIDE = 16, 1 << 20
#: Bytes of files for which a join has a partition at least.
PART_BYTES = 8 << 20


def bin_width(df: DataFrame, start: str = "start", end: str = "end") -> tuple[int, int]:
    """(bin width, highest level) for these intervals, by one small aggregate."""
    size = F.col(end) - F.col(start)
    mean, most = df.agg(F.avg(size), F.max(size)).first()
    width = 1 << round(math.log2(min(max(mean or NARROW, NARROW), WIDE)))
    return width, _level_of(most or 0, width)


def _level_of(length: int, width: int) -> int:
    level = 0
    while length > FAN * width * FAN**level and level < LEVELS - 1:
        level += 1
    return level


def _level(length: Column, width: int) -> Column:
    found = F.lit(LEVELS - 1)
    for level in range(LEVELS - 2, -1, -1):
        found = F.when(length <= FAN * width * FAN**level, level).otherwise(found)
    return found


def _step(at: Column, width: int) -> Column:
    """Width of the bins of level ``at``."""
    found = F.lit(width).cast("bigint")
    for level in range(1, LEVELS):
        found = F.when(at == level, F.lit(width * FAN**level).cast("bigint")).otherwise(found)
    return found


def _place(start: Column, level: Column, width: int) -> Column:
    """One number for a level and the bin of ``start`` on it."""
    return F.floor(start / _step(level, width)) * LEVELS + level


def _listed(df: DataFrame, start: str, end: str, width: int, highest: int, place: str) -> DataFrame:
    """``df`` with one row for each bin that an interval touches, from its own level to ``highest``.

    ``place`` is the level and the bin; place_up whether the level is above the
    interval's own (always 0 without such levels).
    """
    own = _level(F.col(end) - F.col(start), width)
    at = F.col(f"{place}_at")
    rows = df.withColumn(f"{place}_at", F.explode(F.sequence(own, F.greatest(own, F.lit(highest)))) if highest else own)
    rows = rows.withColumn(f"{place}_up", (at > own).cast("int") if highest else F.lit(0))
    low = F.floor(F.col(start) / _step(at, width))
    high = F.greatest(F.floor((F.col(end) - 1) / _step(at, width)), low)
    return rows.withColumn(place, F.explode(F.sequence(low, high))).withColumn(place, F.col(place) * LEVELS + at).drop(f"{place}_at")


def _parts(*sides: DataFrame) -> int | None:
    """Partitions for a join, one for every PART_BYTES of the files below its sides; None where the session has as many."""
    size = 0
    for side in sides:
        leaves = side._jdf.queryExecution().optimizedPlan().collectLeaves()
        known = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
        size += sum(x for x in known if x < 1 << 60)  # what has no size says the greatest number
    parts = -(-size // PART_BYTES)
    return parts if parts > int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def overlap_join(left: DataFrame, right: DataFrame, width: int | None = None, prefix: str = "r_", extra: dict[str, str] | None = None) -> DataFrame:
    """Pairs of overlapping intervals; right columns get ``prefix``.

    Both sides have contig, start and end.  ``extra``: left columns and the
    right ones that must be equal to them (sample, strand); they join the key.
    ``width``: of the bins, else by the lengths on the left.

    Both sides are sorted and merged: Spark's estimate of a side does not know
    how many bins its rows are listed in, and it would broadcast millions of
    them from the driver.  Large tables are dealt over more partitions than the
    session has, so that a task does not grow with them.
    """
    width, highest = (width, LEVELS - 1) if width else bin_width(left)
    parts = _parts(left, right)
    # a side that comes from one small file, or from a few contigs, is dealt out before it is listed;
    # the left may meet longer intervals of the right on any level
    a = _listed(left.repartition("contig", "start", "end"), "start", "end", width, LEVELS - 1, "_l")
    b = right.select(*(F.col(c).alias(prefix + c) for c in right.columns))
    b = _listed(b, f"{prefix}start", f"{prefix}end", width, highest, "_r")
    if highest:
        # 0: whom the right lists on its own level; 1: on a higher one, where only the left's own level counts
        kind = F.explode(F.when(F.col("_l_up") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        a = a.withColumn("_l_up", kind).withColumn("_l", F.col("_l") * 2 + F.col("_l_up"))
        b = b.withColumn("_r", F.col("_r") * 2 + F.col("_r_up"))
    a, b = a.drop("_l_up"), b.drop("_r_up")
    keys = {"_l": "_r"} | {own: prefix + other for own, other in {"contig": "contig", **(extra or {})}.items()}
    if parts:
        a, b = a.repartition(parts, *keys), b.repartition(parts, *keys.values())
    b = b.hint("merge")
    same = F.lit(True)
    for own, other in keys.items():
        same = same & (a[own] == b[other])
    theta = (F.col("start") < F.col(f"{prefix}end")) & (F.col(f"{prefix}start") < F.col("end"))
    # on the level of the longer one, in the bin where the later one starts
    longer = F.greatest(F.col("end") - F.col("start"), F.col(f"{prefix}end") - F.col(f"{prefix}start"))
    first = _place(F.greatest("start", f"{prefix}start"), _level(longer, width), width)
    return a.join(b, same & theta & (first == (F.floor(F.col("_l") / 2) if highest else F.col("_l")))).drop("_l", "_r")


def point_join(points: DataFrame, ranges: DataFrame, width: int | None = None, prefix: str = "r_") -> DataFrame:
    """Pairs of a point (contig, pos) and a range that holds it, by a merge as in overlap_join."""
    width, highest = (width, LEVELS - 1) if width else bin_width(ranges)
    level = F.explode(F.sequence(F.lit(0), F.lit(highest))) if highest else F.lit(0)
    a = points.withColumn("_p_at", level)
    a = a.withColumn("_p", _place(F.col("pos"), F.col("_p_at"), width)).drop("_p_at")
    b = ranges.select(*(F.col(c).alias(prefix + c) for c in ranges.columns))
    b = _listed(b, f"{prefix}start", f"{prefix}end", width, 0, "_r").hint("merge")
    holds = (F.col("contig") == F.col(f"{prefix}contig")) & (F.col("_p") == F.col("_r"))
    inside = (F.col("pos") >= F.col(f"{prefix}start")) & (F.col("pos") < F.col(f"{prefix}end"))
    return a.join(b, holds & inside).drop("_p", "_r", "_r_up")


def clusters(ranges: DataFrame, by: list[str], slack: int = 0) -> DataFrame:
    """``ranges`` with ``_cluster``: a running number of gaps within each group.

    Touching ranges stay apart with slack 0 and join with slack 1.
    """
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") >= reach + slack), 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return ranges.withColumn("_open", opens).withColumn("_cluster", F.sum("_open").over(running)).drop("_open")


def merge_ranges(ranges: DataFrame, by: list[str] | None = None, slack: int = 0, annotations: list[str] | None = None, sep: str = ";", stranded: bool = False) -> DataFrame:
    """One row per cluster of overlapping ranges; annotations joined in order."""
    by = list(by or ["contig"]) + (["strand"] if stranded else [])
    grouped = clusters(ranges, by, slack).groupBy(*by, "_cluster")
    joined = [
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", F.col(c).cast("string").alias("v")))), lambda x: x["v"]), sep).alias(c) for c in annotations or []
    ]
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), *joined).drop("_cluster")


def subtract(left: DataFrame, holes: DataFrame, width: int | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """The parts of each left interval outside all holes; other columns stay.

    Pieces are cut for each distinct interval, and joined back by its place:
    no row needs a number that could change when a task runs again.
    """
    keys = ["contig", "start", "end", *(extra or {})]
    own = left.select(*keys).distinct()
    cut = overlap_join(own, holes, width, "h_", extra).select(*keys, F.greatest("start", "h_start").alias("bs"), F.least("end", "h_end").alias("be"))
    # a hole of length zero at the end closes the last piece
    edges = cut.union(own.select(*keys, F.col("end").alias("bs"), F.col("end").alias("be")))
    order = Window.partitionBy(*keys).orderBy("bs", "be")
    reach = F.coalesce(F.max("be").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start"))
    pieces = edges.withColumn("_from", reach).where(F.col("_from") < F.col("bs"))
    whole = left.join(pieces.select(*keys, "_from", "bs"), keys)
    columns = [F.col("_from").alias("start") if c == "start" else F.col("bs").alias("end") if c == "end" else F.col(c) for c in left.columns]
    return whole.select(*columns)


def fixed_windows(contigs: DataFrame, width: int = 50_000) -> DataFrame:
    """contig, start, end of windows side by side; the last one may be shorter."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(width).cast("bigint")))
    return contigs.where("length > 0").select("contig", "length", at.alias("start")).select("contig", "start", F.least(F.col("start") + width, F.col("length")).alias("end"))


def numbered(ranges: DataFrame, name: str = "ranges_id", order: tuple[str, ...] = ("contig", "start")) -> DataFrame:
    """Number ranges from 0 in order, by counts per contig and no global window."""
    sizes = ranges.groupBy("contig").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)  # one row per contig
    starts = sizes.select("contig", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("contig").orderBy(*order[1:], "end"))
    return ranges.join(F.broadcast(starts), "contig").withColumn(name, (F.col("_before") + within - 1).cast("bigint")).drop("_before")


def canonical(column: str | Column = "contig") -> Column:
    """Whether a contig is canonical: chr..., without an underscore."""
    c = F.col(column) if isinstance(column, str) else column
    return c.startswith("chr") & ~c.contains("_")


def tile_genome(contigs: DataFrame, width: int = 128) -> DataFrame:
    return fixed_windows(contigs.where(~F.col("contig").contains("_")), width)


def annotate(intervals: DataFrame, features: DataFrame, width: int | None = None, prefix: str = "feature_", require_overlap: bool = True) -> DataFrame:
    """Intervals with each feature that they overlap; else, once, with nulls."""
    joined = overlap_join(intervals, features, width, prefix)
    if require_overlap:
        return joined
    key = ["contig", "start", "end"]
    lone = intervals.join(joined.select(*key).distinct(), key, "left_anti").dropDuplicates(key)
    return joined.unionByName(lone, allowMissingColumns=True)


def position_mask(positions: DataFrame, ranges: DataFrame, width: int | None = None) -> DataFrame:
    """contig, pos and whether any range of the contig holds it."""
    hits = point_join(positions, ranges, width).select("contig", "pos").distinct().withColumn("_hit", F.lit(True))
    return positions.join(hits, ["contig", "pos"], "left").withColumn("in_range", F.coalesce("_hit", F.lit(False))).drop("_hit")


def clip(ranges: DataFrame, contigs: DataFrame) -> DataFrame:
    """Ranges cut to their contig; what is empty or on no contig goes."""
    joined = ranges.join(F.broadcast(contigs), "contig")
    cut = joined.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "length")})
    return cut.where("end > start").drop("length")


def contig_overlap(ranges: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig and where it occurs: shared, ranges or store."""
    a = ranges.select("contig").distinct().withColumn("_r", F.lit(1))
    b = contigs.select("contig").distinct().withColumn("_s", F.lit(1))
    where = F.when(F.col("_r").isNotNull() & F.col("_s").isNotNull(), "shared").when(F.col("_r").isNotNull(), "ranges").otherwise("store")
    return a.join(b, "contig", "full_outer").select("contig", where.alias("found_in"))
