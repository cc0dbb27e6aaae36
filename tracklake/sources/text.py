"""Text formats: BED, bedGraph, CpG reports, VCF, GTF, contig sizes, metadata."""

from __future__ import annotations

import os
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import canonical
from ..operators.sites import join_split_reports, merge_strands


def _fields(spark: SparkSession, path) -> DataFrame:
    """Lines of tab-separated text, split into ``f``; comments and blanks go."""
    paths = [os.fspath(p) for p in path] if isinstance(path, (list, tuple)) else os.fspath(path)
    lines = spark.read.text(paths).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return lines.select("value", F.split("value", "\t").alias("f"))


def _f(i: int, kind: str = "string") -> Column:
    return F.get("f", F.lit(i)).try_cast(kind)


def read_bed(spark: SparkSession, path) -> DataFrame:
    rows = _fields(spark, path).where(~F.col("value").startswith("track") & ~F.col("value").startswith("browser"))
    found = rows.select(_f(0).alias("contig"), _f(1, "bigint").alias("start"), _f(2, "bigint").alias("end"), _f(3).alias("name"), _f(4).alias("score"), _f(5).alias("strand"))
    return found.where("start is not null and end is not null")


def read_bedgraph(spark: SparkSession, path, sample: str, filter_chromosomes: bool = True) -> DataFrame:
    """Methylation sites of a table with 4 to 6 columns; counts as far as given."""
    rows = _fields(spark, path).where(~F.col("value").startswith("track ") & ~F.col("value").startswith("browser ") & ~F.col("value").contains("type="))
    if rows.where(F.size("f") < 4).limit(1).count():
        raise ValueError(f"{path}: a methylation table needs at least 4 columns")
    return bedgraph_sites(rows, sample, filter_chromosomes)


def bedgraph_sites(rows: DataFrame, sample: str, filter_chromosomes: bool = True) -> DataFrame:
    """Sites of split lines: percentages with counts (6), coverage (5) or neither (4)."""
    pct, n = _f(3, "double"), F.size("f")
    cover = _f(4, "double")
    m = F.when(n >= 6, _f(5, "int")).when(n == 5, F.bround(pct / 100 * cover).cast("int")).otherwise(0)
    u = F.when(n >= 6, _f(4, "int")).when(n == 5, F.bround((1 - pct / 100) * cover).cast("int")).otherwise(0)
    found = rows.select(_f(0).alias("contig"), _f(1, "bigint").alias("pos"), F.lit(sample).alias("sample"), pct.alias("methylation_pct"), m.alias("n_methylated"), u.alias("n_unmethylated"))
    return found.where(canonical()) if filter_chromosomes else found


def read_cx_report(spark: SparkSession, path, sample: str, filter_chromosomes: bool = True) -> DataFrame:
    """Whole-molecule report of 9 columns, strands merged."""
    rows = _fields(spark, path).select(_f(0).alias("contig"), _f(1, "bigint").alias("pos"), _f(2).alias("strand"), _f(3, "bigint").alias("n_mc"), _f(4, "bigint").alias("n_hmc"), _f(5, "bigint").alias("n_c"))
    found = merge_strands(rows).withColumn("sample", F.lit(sample))
    return found.where(canonical()) if filter_chromosomes else found


def read_cx_split(spark: SparkSession, sample: str, mc=None, hmc=None, filter_chromosomes: bool = True) -> DataFrame:
    """mC and hmC reports of 7 columns as one, strands merged."""
    def report(path):
        return None if path is None else _fields(spark, path).select(_f(0).alias("contig"), _f(1, "bigint").alias("pos"), _f(2).alias("strand"), _f(3, "bigint").alias("n_mod"), _f(4, "bigint").alias("n_not_mod"))

    found = merge_strands(join_split_reports(report(mc), report(hmc))).withColumn("sample", F.lit(sample))
    return found.where(canonical()) if filter_chromosomes else found


def read_vcf(spark: SparkSession, path, sample: str, filter_chromosomes: bool = True) -> DataFrame:
    """The first sample's calls: genotype 0 to 2, or -1 where an allele is missing."""
    rows = _fields(spark, path)
    return vcf_calls(rows, sample, filter_chromosomes)


def vcf_calls(rows: DataFrame, sample: str, filter_chromosomes: bool = True) -> DataFrame:
    keys, values = F.split(F.coalesce(_f(8), F.lit("")), ":"), F.split(F.coalesce(_f(9), F.lit("")), ":")
    field = lambda name: F.when(F.array_contains(keys, name), F.get(values, (F.array_position(keys, name) - 1).cast("int")))
    gt = F.split(F.coalesce(field("GT"), F.lit(".")), r"[/|]")
    n_alt = F.size(F.filter(gt, lambda a: (a != "0") & (a != ".")))
    genotype = F.when(F.exists(gt, lambda a: (a == ".") | (a == "")), -1).otherwise(F.least(n_alt, F.lit(2)))
    depths = F.split(F.coalesce(field("AD"), F.lit("")), ",")
    depth = lambda i: F.coalesce(F.get(depths, F.lit(i)).try_cast("int"), F.lit(0))
    alt = F.get(F.split(_f(4), ","), F.lit(0))
    found = rows.select(
        _f(0).alias("contig"), _f(1, "bigint").alias("pos"), F.lit(sample).alias("sample"), _f(3).alias("ref"), F.coalesce(F.nullif(alt, F.lit("")), F.lit(".")).alias("alt"),
        _f(5, "double").alias("qual"), genotype.cast("int").alias("genotype"), depth(0).alias("ad_ref"), depth(1).alias("ad_alt"),
    )
    return found.where(canonical()) if filter_chromosomes else found


#: Attributes that become columns.
GTF_KEYS = ("gene_id", "gene_name", "transcript_id", "gene_type", "gene_biotype")


def gtf_attributes(text: Column) -> Column:
    """Map of the ``key "value";`` pairs of an attribute field; pairs without a space go."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p.contains(" "))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, " ", 1).alias("key"), F.trim(F.trim(F.substring(p, F.length(F.substring_index(p, " ", 1)) + 2, F.length(p))), F.lit('"')).alias("value")))
    # of a repeated key, the last value counts
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))


def gtf_rows(rows: DataFrame, keys=GTF_KEYS) -> DataFrame:
    held = rows.withColumn("attributes", gtf_attributes(_f(8)))
    strand = F.when(_f(6).isin("+", "-"), _f(6))
    return held.select(
        _f(0).alias("contig"), (_f(3, "bigint") - 1).alias("start"), _f(4, "bigint").alias("end"), strand.alias("strand"), _f(2).alias("feature"), _f(1).alias("source"),
        *(F.col("attributes").getItem(k).alias(k) for k in keys),
    )


def read_gtf(spark: SparkSession, path, feature_type: str | None = None, keys=GTF_KEYS) -> DataFrame:
    """Features of GTF files as 0-based ranges; no path gives an empty frame."""
    if isinstance(path, (list, tuple)) and not path:
        fields = "contig string, start bigint, end bigint, strand string, feature string, source string"
        return spark.createDataFrame([], ", ".join([fields, *(f"{k} string" for k in keys)]))
    found = gtf_rows(_fields(spark, path), keys)
    return found if feature_type is None else found.where(F.col("feature") == feature_type)


def read_chromsizes(spark: SparkSession, sizes, filter_chromosomes: bool = True, test: bool = False) -> DataFrame:
    """contig and length from a mapping or a file of two columns."""
    if isinstance(sizes, dict):
        found = spark.createDataFrame(list(sizes.items()), "contig string, length bigint")
    else:
        found = _fields(spark, sizes).select(_f(0).alias("contig"), _f(1, "bigint").alias("length"))
    if filter_chromosomes:
        found = found.where(canonical())
    return found.where(F.col("contig").isin("chr21", "chr22", "chrY")) if test else found


def read_metadata(spark: SparkSession, path) -> DataFrame:
    path = os.fspath(path)
    return spark.read.json(path, multiLine=True) if path.endswith(".json") else spark.read.csv(path, header=True, inferSchema=False)


def combine_metadata(spark: SparkSession, paths: list) -> DataFrame:
    """Union of metadata files by name, without columns on read files; missing files are skipped."""
    found = [spark.read.csv(os.fspath(p), header=True, inferSchema=False) for p in paths if os.path.exists(p)]
    if not found:
        raise ValueError("no metadata file found")
    kept = [f.select(*(c for c in f.columns if "r1" not in c.lower() and "r2" not in c.lower())) for f in found]
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept).na.fill("")


def classify_methylation(paths: list) -> dict[str, list]:
    """Paths by kind of methylation file, told by their names."""
    kinds: dict[str, list] = {"hmc": [], "mc": [], "cx": [], "bedgraph": []}
    for path in paths:
        name = os.path.basename(os.fspath(path))
        kind = "hmc" if "num_hmc_cxreport" in name else "mc" if "num_mc_cxreport" in name else "cx" if "CXreport" in name else "bedgraph"
        kinds[kind].append(path)
    return kinds


def file_digest(spark: SparkSession, path) -> DataFrame:
    """path and md5 of the first 16 KiB of files."""
    return spark.read.format("binaryFile").load(os.fspath(path)).select("path", F.md5(F.substring("content", 1, 16384)).alias("digest"))
