"""A store: a directory of Parquet tables with a manifest of samples.

A sample is written in full before its row is added to ``samples``; that row
is the commit, so a build that broke off goes on with the samples that lack it.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signal import sparsity
from ..schema import SAMPLES

#: Parquet settings by compression profile.
PROFILES = {
    "default": {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"},
    "fast": {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"},
    "none": {"compression": "uncompressed"},
}
MODALITIES = ("coverage", "methylation", "variants")


def profile(name: str | None) -> dict[str, str]:
    name = {None: "default", "uncompressed": "none", "off": "none"}.get(name, name)
    if name not in PROFILES:
        raise ValueError(f"{name!r} is none of {', '.join(PROFILES)}")
    return PROFILES[name]


def library_types(stranded, samples: list[str]) -> dict[str, str | None]:
    """Library type of each sample from None, a name, a list, or a mapping."""
    if stranded is None or isinstance(stranded, str):
        found = dict.fromkeys(samples, stranded)
    elif isinstance(stranded, dict):
        if unknown := set(stranded) - set(samples):
            raise ValueError(f"unknown samples {sorted(unknown)}")
        found = {s: stranded.get(s) for s in samples}
    elif isinstance(stranded, (list, tuple)):
        if len(stranded) != len(samples):
            raise ValueError("as many library types as samples are needed")
        found = dict(zip(samples, stranded, strict=True))
    else:
        raise TypeError("stranded must be a name, a list or a mapping")
    if bad := {t for t in found.values() if t not in (None, "U", "R", "F")}:
        raise ValueError(f"unknown library types {sorted(bad)}")
    return found


def sample_hash(names: list[str]) -> str:
    """16 hex digits for an ordered list of sample names."""
    import hashlib

    return hashlib.sha256("|".join(names).encode()).hexdigest()[:16]


def merged_metadata(samples: DataFrame, metadata: DataFrame, base: list[str], merge: bool = True) -> DataFrame:
    """``samples`` with the string columns of ``metadata`` by sample_id.

    ``merge``: values of other samples and columns stay, else only ``base``.
    """
    kept = samples if merge else samples.select(*base)
    own = [c for c in metadata.columns if c not in base]
    fresh = metadata.select("sample_id", *(F.col(c).cast("string").alias(f"_new_{c}") for c in own))
    joined = kept.join(fresh, "sample_id", "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) if c in kept.columns else F.col(f"_new_{c}") for c in own}).drop(*(f"_new_{c}" for c in own))


def unfinished(wanted: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of ``wanted`` whose sample_id is not completed."""
    return wanted.join(samples.where("completed").select("sample_id"), "sample_id", "left_anti")


class Store:
    """Tables under one path; all frames are lazy."""

    def __init__(self, spark: SparkSession, path, read_only: bool = True):
        self.spark, self.path, self.read_only = spark, os.fspath(path), read_only
        with open(f"{self.path}/_store.json", encoding="utf-8") as f:
            self.manifest = json.load(f)

    @classmethod
    def create(cls, spark: SparkSession, path, contigs: DataFrame, samples: list[str], overwrite: bool = False, resume: bool = False, read_only: bool = False, stranded=None, compression: str | None = None) -> Store:
        path = os.fspath(path)
        if read_only and overwrite:
            raise ValueError("a read-only store can't be overwritten")
        if len(set(samples)) != len(samples):
            raise ValueError("sample names must differ")
        if os.path.exists(f"{path}/_store.json") and not overwrite:
            if not resume:
                raise FileExistsError(path)
            store = cls(spark, path, read_only)
            if store.manifest["samples"] != list(samples):
                raise ValueError("the samples differ from those of the store")
            return store
        if overwrite:
            shutil.rmtree(path, ignore_errors=True)
        os.makedirs(path, exist_ok=True)
        profile(compression)
        contigs.coalesce(1).write.mode("overwrite").parquet(f"{path}/contigs")
        manifest = {"samples": list(samples), "stranded": library_types(stranded, list(samples)), "sample_hash": sample_hash(list(samples)), "compression": compression}
        with open(f"{path}/_store.json", "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        return cls(spark, path, read_only)

    # --- writing ---------------------------------------------------------

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")

    def write_table(self, df: DataFrame, name: str, sample: str) -> None:
        """One sample's rows, partitioned so that contig and sample prune files."""
        self._writable()
        keys = ["contig", "strand"] if name == "coverage" else ["contig"]
        order = [c for c in ("contig", "strand", "start", "pos") if c in df.columns]
        rows = df.where(F.col("sample") == sample).drop("sample").repartition(*keys).sortWithinPartitions(*order)
        rows.write.options(**profile(self.manifest["compression"])).mode("overwrite").partitionBy(*keys).parquet(f"{self.path}/{name}/sample={sample}")

    def commit(self, sample: str, total_reads: int | None = None, digest: str | None = None, **metadata: str) -> None:
        """Add the sample's row; from then on it counts as completed."""
        self._writable()
        index = self.manifest["samples"].index(sample)
        share = None
        if os.path.exists(f"{self.path}/coverage/sample={sample}"):
            one = self.spark.createDataFrame([(sample,)], "sample_id string")
            share = sparsity(self.table("coverage").where(F.col("sample") == sample), self.contigs, one).first()["sparsity"]
        row = self.spark.createDataFrame([(index, sample, True, share, digest, total_reads, self.manifest["stranded"].get(sample))], SAMPLES)
        row.withColumns({k: F.lit(v).cast("string") for k, v in metadata.items()}).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/samples/commit={sample}")

    def pending(self, requested: list[str]) -> list[str]:
        """Requested samples that have no commit yet."""
        wanted = self.spark.createDataFrame([(i, s) for i, s in enumerate(requested)], "i int, sample_id string")
        return [r["sample_id"] for r in unfinished(wanted, self.samples).orderBy("i").collect()]

    def set_metadata(self, metadata: DataFrame, merge: bool = True) -> None:
        """String columns by sample_id; ``merge``: values of other samples and columns stay."""
        self._writable()
        base = [f.split()[0] for f in SAMPLES.split(", ")]
        self._replace_samples(merged_metadata(self.samples, metadata, base, merge))

    def update_metadata(self, column: str, values) -> None:
        """A list for all samples in order, or a mapping for some."""
        names = self.manifest["samples"]
        if isinstance(values, (list, tuple)):
            if len(values) != len(names):
                raise ValueError("as many values as samples are needed")
            values = dict(zip(names, values, strict=True))
        elif not isinstance(values, dict):
            raise TypeError("values must be a list or a mapping")
        if unknown := set(values) - set(names):
            raise ValueError(f"unknown samples {sorted(unknown)}")
        self.set_metadata(self.spark.createDataFrame([(k, str(v)) for k, v in values.items()], f"sample_id string, `{column}` string"))

    def remove_columns(self, *columns: str) -> None:
        self._writable()
        self._replace_samples(self.samples.drop(*columns))

    def _replace_samples(self, df: DataFrame) -> None:
        """Write beside the old rows and swap, as they are read meanwhile."""
        fresh = f"{self.path}/.samples-{uuid.uuid4().hex}"
        df.withColumn("commit", F.col("sample_id")).coalesce(1).write.partitionBy("commit").parquet(fresh)
        shutil.rmtree(f"{self.path}/samples", ignore_errors=True)
        os.rename(fresh, f"{self.path}/samples")

    # --- reading ---------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").option("mergeSchema", "true").parquet(f"{self.path}/{name}").withColumn("sample", F.col("sample").cast("string"))

    @property
    def modalities(self) -> list[str]:
        return [m for m in MODALITIES if os.path.exists(f"{self.path}/{m}")]

    @property
    def contigs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/contigs")

    @property
    def samples(self) -> DataFrame:
        """The dimension table: committed samples, and the others as incomplete."""
        names = self.spark.createDataFrame([(i, s) for i, s in enumerate(self.manifest["samples"])], "sample_idx int, sample_id string")
        if not os.path.exists(f"{self.path}/samples"):
            empty = names.select("*", F.lit(False).alias("completed"))
            return empty.withColumns({"sparsity": F.lit(None).cast("double"), "sample_hash": F.lit(None).cast("string"), "total_reads": F.lit(None).cast("bigint"), "stranded": F.lit(None).cast("string")})
        done = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/samples").drop("sample_idx", "commit")
        return names.join(F.broadcast(done), "sample_id", "left").withColumn("completed", F.coalesce("completed", F.lit(False)))

    def metadata(self) -> DataFrame:
        """Samples in order, empty strings as null, the assay in front."""
        found = self.samples.orderBy("sample_idx")
        texts = [f.name for f in found.schema if f.dataType.simpleString() == "string" and f.name != "sample_id"]
        found = found.withColumns({c: F.nullif(c, F.lit("")) for c in texts})
        rest = [c for c in found.columns if c not in ("sample_id", "assay")]
        return found.select("sample_id", *(["assay"] if "assay" in found.columns else []), *rest)

    def export_metadata(self, path, kind: str = "csv") -> None:
        frame = self.metadata().toPandas()  # one row per sample
        if kind == "csv":
            frame.to_csv(path, index=False)
        elif kind == "json":
            frame.to_json(path, orient="records")
        else:
            raise ValueError(f"{kind!r} is neither csv nor json")


def publish(staged, target, overwrite: bool = False) -> None:
    """Put a finished store in place: copied beside the target, then renamed."""
    staged, target = os.fspath(staged), os.fspath(target)
    if os.path.exists(target) and not overwrite:
        raise FileExistsError(target)
    beside = f"{target}.{uuid.uuid4().hex}"
    try:
        shutil.copytree(staged, beside)
        shutil.rmtree(target, ignore_errors=True)
        os.rename(beside, target)
    finally:
        shutil.rmtree(beside, ignore_errors=True)


def records_per_file(contig_length: int, total_length: int, network: bool = False) -> int:
    """Rows per file from the byte target of the file system and a file limit.

    Starts at the target in whole kibi-rows, doubles until the files fit the
    limit, and stays within the longest contig.
    """
    target = (128 if network else 4) << 20
    limit = 10_000 if network else 100_000
    size = max(1024, target // 4 // 1024 * 1024)
    while -(-total_length // size) > limit:
        size *= 2
    return max(1, min(size, contig_length))


def combined_metadata(parts: dict[str, DataFrame]) -> DataFrame:
    """Samples of several modalities: the first row of each, and where it occurs."""
    frames = [df.withColumns({"_m": F.lit(i), "_name": F.lit(name)}) for i, (name, df) in enumerate(parts.items())]
    whole = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    columns = [c for c in whole.columns if c not in ("sample_id", "_m", "_name")]
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_m", "_name"))), lambda x: x["_name"]), ",").alias("modalities")
    firsts = [F.min_by(F.col(c), F.col("_m")).alias(c) for c in columns]
    return whole.groupBy("sample_id").agg(*firsts, names)
