"""Building stores from files: checks beforehand, then coverage, methylation and variants."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facade import Dataset
from .operators import signal
from .plans.store import Store, combined_metadata
from .sources import bam, text


def _named(files: list, names: list[str] | None, label: str, cut: Callable[[str], str]) -> dict[str, object]:
    """Files by sample; ValueError for a wrong number of names or one that comes twice."""
    found = list(names) if names else [cut(os.path.basename(os.fspath(f))) for f in files]
    if len(found) != len(files):
        raise ValueError(f"{label}: {len(found)} names for {len(files)} files")
    if twice := sorted(n for n, k in Counter(found).items() if k > 1):
        raise ValueError(f"{label}: sample names come twice: {twice}")
    return dict(zip(found, files, strict=True))


def _require(path, label: str, suffix: str = "", index: tuple[str, ...] = ()) -> None:
    path = os.fspath(path)
    if not os.path.exists(path):
        raise FileNotFoundError(f"{label}: no file {path}")
    if not os.path.getsize(path):
        raise ValueError(f"{label}: {path} is empty")
    if not path.lower().endswith(suffix):
        raise ValueError(f"{label}: {path} does not end in {suffix}")
    if index and not any(os.path.exists(path + i) or os.path.exists(path.removesuffix(suffix) + suffix + i) for i in index):
        raise FileNotFoundError(f"{label}: {path} has no index ({', '.join(index)})")


class Inputs:
    """Files of a study by kind and sample, checked before any work starts."""

    def __init__(self, bam_files=(), bedgraph_files=(), cx_files=(), mc_files=(), hmc_files=(), vcf_files=(), bam_names=None, bedgraph_names=None, cx_names=None, split_names=None, vcf_names=None):
        if not any((bam_files, bedgraph_files, cx_files, mc_files, hmc_files, vcf_files)):
            raise ValueError("give files of at least one kind")
        if cx_files and (bedgraph_files or mc_files or hmc_files):
            raise ValueError("whole-molecule reports can't be mixed with other methylation files")
        if mc_files and hmc_files and len(mc_files) != len(hmc_files):
            raise ValueError("as many mC as hmC reports are needed")
        for f in bam_files:
            _require(f, "alignment", ".bam", (".bai", ".csi"))
        for f in (*bedgraph_files, *cx_files, *mc_files, *hmc_files):
            _require(f, "methylation")
        for f in vcf_files:
            _require(f, "variants", ".vcf.gz", (".tbi", ".csi"))
        stem, first = lambda n: n.rsplit(".", 1)[0], lambda n: n.split(".")[0]
        self.bam = _named(list(bam_files), bam_names, "alignment", stem)
        self.bedgraph = _named(list(bedgraph_files), bedgraph_names, "bedGraph", stem)
        self.cx = _named(list(cx_files), cx_names, "CX report", first)
        either = list(mc_files or hmc_files)
        split = _named(either, split_names, "split report", first)
        self.mc = dict(zip(split, mc_files, strict=True)) if mc_files else {}
        self.hmc = dict(zip(split, hmc_files, strict=True)) if hmc_files else {}
        self.split = list(split)
        self.vcf = _named(list(vcf_files), vcf_names, "variants", first)
        kinds = Counter([*self.bedgraph, *self.cx, *self.split])
        if twice := sorted(n for n, k in kinds.items() if k > 1):
            raise ValueError(f"samples come in several kinds of methylation files: {twice}")


def build_coverage(spark: SparkSession, path, alignments: dict[str, object], contigs: DataFrame | None = None, stranded=None, resume: bool = False, overwrite: bool = False, compression: str | None = None) -> Dataset:
    """A store of alignment files by sample; completed samples are skipped."""
    if contigs is None:
        contigs = text.read_chromsizes(spark, dict(bam.header(os.fspath(next(iter(alignments.values()))))))
    store = Store.create(spark, path, contigs, list(alignments), overwrite, resume, stranded=stranded, compression=compression)
    for sample in store.pending(list(alignments)):
        file = os.fspath(alignments[sample])
        # the file is decoded once: coverage and the number of reads come from the same rows
        reads = bam.read_bam(spark, file).persist()
        blocks = bam.coverage_blocks(reads, sample, store.manifest["stranded"][sample])
        runs = signal.sweep(blocks).join(F.broadcast(contigs), "contig").where(F.col("start") < F.col("length"))
        store.write_table(runs.withColumn("end", F.least("end", "length")).drop("length"), "coverage", sample)
        digest = text.file_digest(spark, file).first()["digest"]
        store.commit(sample, bam.mapped_reads(reads).first()["total_reads"], digest)
        reads.unpersist()
    return Dataset(store)


def _sites(spark: SparkSession, path, name: str, readers: dict[str, Callable[[], DataFrame]], resume: bool, overwrite: bool, compression: str | None) -> Dataset:
    """A store of sites by sample, each read, written and committed by itself."""
    frames = {sample: read() for sample, read in readers.items()}
    ends = [f.groupBy("contig").agg((F.max("pos") + 1).alias("length")) for f in frames.values()]
    contigs = fold(lambda a, b: a.union(b), ends).groupBy("contig").agg(F.max("length").alias("length"))
    store = Store.create(spark, path, contigs, list(readers), overwrite, resume, compression=compression)
    for sample in store.pending(list(readers)):
        store.write_table(frames[sample], name, sample)
        store.commit(sample)
    return Dataset(store)


def build_methylation(spark: SparkSession, path, inputs: Inputs, filter_chromosomes: bool = True, resume: bool = False, overwrite: bool = False, compression: str | None = None) -> Dataset:
    """Sites of bedGraph, whole-molecule or split reports; a mixture reads as split counts."""
    from .operators.sites import as_split

    mixed = bool(inputs.split and inputs.bedgraph)
    readers: dict[str, Callable[[], DataFrame]] = {}
    for sample, file in inputs.bedgraph.items():
        read = lambda s=sample, f=file: text.read_bedgraph(spark, f, s, filter_chromosomes)
        readers[sample] = (lambda r=read: as_split(r()).drop("n_methylated", "n_unmethylated")) if mixed else read
    for sample, file in inputs.cx.items():
        readers[sample] = lambda s=sample, f=file: text.read_cx_report(spark, f, s, filter_chromosomes)
    for sample in inputs.split:
        readers[sample] = lambda s=sample: text.read_cx_split(spark, s, inputs.mc.get(s), inputs.hmc.get(s), filter_chromosomes)
    return _sites(spark, path, "methylation", readers, resume, overwrite, compression)


def build_variants(spark: SparkSession, path, files: dict[str, object], filter_chromosomes: bool = True, resume: bool = False, overwrite: bool = False, compression: str | None = None) -> Dataset:
    """First sample's calls of each file."""
    readers = {s: (lambda s=s, f=f: text.read_vcf(spark, f, s, filter_chromosomes)) for s, f in files.items()}
    return _sites(spark, path, "variants", readers, resume, overwrite, compression)


class Study:
    """A folder with a store for each modality; missing ones are None."""

    def __init__(self, spark: SparkSession, path, read_only: bool = True):
        self.spark, self.path = spark, os.fspath(path)
        self.parts = {m: Dataset.open(spark, f"{self.path}/{m}", read_only) for m in ("coverage", "methylation", "variants") if os.path.exists(f"{self.path}/{m}/_store.json")}
        if not self.parts:
            raise FileNotFoundError(f"{self.path} holds no store")

    def __getattr__(self, name: str):
        if name in ("coverage", "methylation", "variants"):
            return self.parts.get(name)
        raise AttributeError(name)

    @property
    def modalities(self) -> list[str]:
        return list(self.parts)

    @property
    def sample_names(self) -> list[str]:
        """Of all modalities, in order of their first occurrence."""
        return list(dict.fromkeys(n for part in self.parts.values() for n in part.sample_names))

    @property
    def contigs(self) -> list[str]:
        return sorted({r["contig"] for part in self.parts.values() for r in part.contigs.collect()})

    def metadata(self) -> DataFrame:
        return combined_metadata({m: part.metadata() for m, part in self.parts.items()})

    def set_metadata(self, metadata: DataFrame, merge: bool = True) -> None:
        """Each part takes the rows of its own samples."""
        for part in self.parts.values():
            part.store.set_metadata(metadata.where(F.col("sample_id").isin(part.sample_names)), merge)


def create_dataset(spark: SparkSession, path, chromsizes=None, metadata=None, stranded=None, filter_chromosomes: bool = True, overwrite: bool = False, resume: bool = False, compression: str | None = None, sample_column: str = "sample_id", **files) -> Study:
    """A study from files of any kinds; ``files`` as in Inputs."""
    inputs = Inputs(**files)
    options = {"resume": resume, "overwrite": overwrite, "compression": compression}
    os.makedirs(os.fspath(path), exist_ok=True)
    if inputs.bam:
        contigs = text.read_chromsizes(spark, chromsizes if chromsizes is not None else dict(bam.header(os.fspath(next(iter(inputs.bam.values()))))), filter_chromosomes)
        build_coverage(spark, f"{os.fspath(path)}/coverage", inputs.bam, contigs, stranded, **options)
    if inputs.bedgraph or inputs.cx or inputs.split:
        build_methylation(spark, f"{os.fspath(path)}/methylation", inputs, filter_chromosomes, **options)
    if inputs.vcf:
        build_variants(spark, f"{os.fspath(path)}/variants", inputs.vcf, filter_chromosomes, **options)
    study = Study(spark, path, read_only=False)
    if metadata is not None:
        rows = metadata if isinstance(metadata, DataFrame) else text.combine_metadata(spark, list(metadata)) if isinstance(metadata, (list, tuple)) else text.read_metadata(spark, metadata)
        study.set_metadata(rows.withColumnRenamed(sample_column, "sample_id"))
    return study
