"""Ranges from frames, files and annotations; promoters and anchored windows."""

from __future__ import annotations

import os
import re
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Anchor, FeatureType
from .intervals import merge_ranges, numbered

#: Names under which ranges may bring their columns.
ALIASES = {
    "contig": ("contig", "seqname", "Chromosome", "chr", "chrom"),
    "start": ("start", "Start", "pos"),
    "end": ("end", "End"),
    "strand": ("strand", "Strand"),
    "name": ("Name", "name", "interval_name", "interval", "id"),
}


def as_ranges(df: DataFrame) -> DataFrame:
    """Columns renamed to contig, start, end, strand and name; ValueError without the first three."""
    for own, names in ALIASES.items():
        found = next((n for n in names if n in df.columns), None)
        if found is None:
            if own in ("contig", "start", "end"):
                raise ValueError(f"ranges need a column {own} (one of {', '.join(names)})")
        elif found != own:
            df = df.drop(own).withColumnRenamed(found, own) if own in df.columns else df.withColumnRenamed(found, own)
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


def resolve_ranges(spark, ranges_df: DataFrame | None = None, intervals_path=None, gtf_path=None, feature_type: str | None = None) -> DataFrame:
    """Ranges from a frame, else a BED file, else features of a GTF file."""
    from ..sources.text import read_bed, read_gtf

    if ranges_df is not None:
        return as_ranges(ranges_df)
    if intervals_path is not None:
        path = os.fspath(intervals_path)
        if path.endswith((".bed", ".bed.gz")):
            return as_ranges(read_bed(spark, path))
        if path.endswith((".gtf", ".gff", ".gtf.gz", ".gff.gz", ".gff3")):
            return as_ranges(read_gtf(spark, path))
        raise ValueError(f"ranges can't be read from {path}")
    if gtf_path is not None and feature_type is not None:
        return feature_ranges(read_gtf(spark, gtf_path), feature_type)
    raise TypeError("give ranges_df, intervals_path, or gtf_path with feature_type")


def feature_ranges(gtf: DataFrame, feature_type: str, upstream: int = 1000, downstream: int = 200) -> DataFrame:
    """Features of one type, with length and midpoint."""
    kind = FeatureType.of(feature_type)
    if kind is FeatureType.PROMOTER:
        return promoters(gtf, upstream, downstream)
    found = gtf.where(F.col("feature") == kind.value)
    return found.withColumns({"length": F.col("end") - F.col("start"), "midpoint": F.floor((F.col("start") + F.col("end")) / 2)})


def promoters(gtf: DataFrame, upstream: int = 1000, downstream: int = 200, anchor: str = "gene", strand_aware: bool = False) -> DataFrame:
    """Windows around the starts of genes, or of transcripts where no gene is.

    The window runs from ``upstream`` before to ``downstream`` behind in genome
    order for either strand, unless ``strand_aware`` mirrors it.
    """
    genes = gtf.where(F.col("feature") == anchor)
    if anchor == "gene":
        alone = gtf.where(F.col("feature") == "transcript").join(genes.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_anti")
        genes = genes.unionByName(alone)
    strand = F.coalesce("strand", F.lit("+"))
    tss = F.when(strand == "-", F.col("end")).otherwise(F.col("start"))
    up, down = F.lit(upstream), F.lit(downstream)
    if strand_aware:
        up, down = F.when(strand == "-", down).otherwise(up), F.when(strand == "-", up).otherwise(down)
    placed = genes.withColumn("_tss", tss).withColumn("strand", strand)
    return placed.withColumns({"start": F.greatest(F.lit(0), F.col("_tss") - up).cast("bigint"), "end": (F.col("_tss") + down).cast("bigint"), "feature": F.lit("promoter")}).drop("_tss")


def load_ranges(frames: list[DataFrame], one_based: bool = False, merge: bool = False) -> DataFrame:
    """Ranges of several frames with ``ranges_id``; stranded ones are refused."""
    if not frames:
        raise ValueError("no ranges given")
    frames = [as_ranges(f) for f in frames]
    if any("strand" in f.columns for f in frames):
        raise ValueError("ranges must not be stranded")
    whole = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if one_based:
        whole = whole.withColumns({"start": F.col("start") - 1, "end": F.col("end") - 1})
    return numbered(merge_ranges(whole) if merge else whole)


def window_extent(fixed_width: int | None, upstream: int | None, downstream: int | None) -> tuple[int, int]:
    """(up, down) of a window; ValueError if both or neither way is given."""
    if fixed_width is not None and (upstream is not None or downstream is not None):
        raise ValueError("give fixed_width, or upstream and downstream")
    if fixed_width is not None:
        return fixed_width // 2, fixed_width - fixed_width // 2
    if upstream is None and downstream is None:
        raise ValueError("give fixed_width, or upstream and downstream")
    return upstream or 0, downstream or 0


def anchored(ranges: DataFrame, up: int, down: int, anchor: str = "midpoint") -> DataFrame:
    """Add win_start and win_end around each range's anchor, in genome order."""
    kind = Anchor.of(anchor)
    minus = F.col("strand") == "-" if "strand" in ranges.columns else F.lit(False)
    first, last = F.col("start"), F.col("end")
    if kind is Anchor.MIDPOINT:
        at = F.floor((first + last) / 2)
    elif kind is Anchor.START:
        at = F.when(minus, last).otherwise(first)
    else:
        at = F.when(minus, first).otherwise(last)
    return ranges.withColumns({"win_start": (at - up).cast("bigint"), "win_end": (at + down).cast("bigint")})


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    """(contig, start, end) of ``chr`` or ``chr:start-end``."""
    if ":" not in region:
        return region, None, None
    contig, _, span = region.rpartition(":")
    m = re.fullmatch(r"(-?\d+)-(-?\d+)", span.replace(",", "").strip())
    if not m or not contig:
        raise ValueError(f"{region!r} is not chr:start-end")
    start, end = int(m[1]), int(m[2])
    if start < 0 or end <= start:
        raise ValueError(f"{region!r} must have 0 <= start < end")
    return contig, start, end
