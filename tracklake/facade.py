"""One object over a store: the analyses with their tables filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import counts, normalise, peaks, profiles, ranges, signal, sites, stats
from .operators.intervals import numbered
from .plans.store import Store
from .schema import FILL


class Dataset:
    """Analyses of a store's completed samples."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    @classmethod
    def open(cls, spark: SparkSession, path, read_only: bool = True) -> Dataset:
        return cls(Store(spark, path, read_only))

    @property
    def modalities(self) -> list[str]:
        return self.store.modalities

    @property
    def sample_names(self) -> list[str]:
        return list(self.store.manifest["samples"])

    @property
    def contigs(self) -> DataFrame:
        return self.store.contigs

    @property
    def n_completed(self) -> int:
        return self.store.samples.where("completed").count()

    def _table(self, name: str) -> DataFrame:
        if name not in self.modalities:
            raise RuntimeError(f"the store has no {name}")
        return self.store.table(name)

    def samples(self, names: list[str] | None = None, include_incomplete: bool = False) -> DataFrame:
        """Chosen samples; ValueError for unknown names or if none is left."""
        if names is not None and (unknown := set(names) - set(self.sample_names)):
            raise ValueError(f"unknown samples {sorted(unknown)}")
        found = self.store.samples if include_incomplete else self.store.samples.where("completed")
        found = found if names is None else found.where(F.col("sample_id").isin(list(names)))
        if found.isEmpty():
            raise ValueError("no completed sample")
        return found

    def _ranges(self, **source) -> DataFrame:
        found = ranges.resolve_ranges(self.spark, **source)
        if "range_index" not in found.columns:
            found = numbered(found, "range_index")
        if found.join(F.broadcast(self.contigs), "contig", "left_semi").isEmpty():
            raise ValueError("no range lies on a contig of the store")
        return found

    def reduce(self, reductions: list[str] | None = None, samples: list[str] | None = None, strand_mode=None, min_count: int = 1, **source) -> DataFrame:
        return signal.reduce_ranges(self._table("coverage"), self._ranges(**source), self.contigs, self.samples(samples), reductions, strand_mode, min_count)

    def extract(self, modality: str = "coverage", samples: list[str] | None = None, source: dict | None = None, **options) -> DataFrame:
        chosen, found = self.samples(samples), self._ranges(**(source or {}))
        if modality == "methylation":
            return sites.methylation_windows(self._table("methylation"), found, chosen, **options)
        return signal.extract_windows(self._table("coverage"), found, self.contigs, chosen, **options)

    def count_features(self, samples: list[str] | None = None, integerize: bool = False, source: dict | None = None, **options):
        return counts.count_features(self._table("coverage"), self._ranges(**(source or {})), self.contigs, self.samples(samples), integerize=integerize, **options)

    def count_methylation(self, samples: list[str] | None = None, split: bool = False, **source) -> DataFrame:
        return sites.count_methylation(self._table("methylation"), self._ranges(**source), self.samples(samples), split)

    def library_sizes(self) -> DataFrame:
        return signal.library_sizes(self.store.samples)

    def normalise(self, reduced: DataFrame, method: str) -> DataFrame:
        return normalise.normalise_reduced(reduced, self.library_sizes(), method, strict=method.lower() != "tpm")

    def region(self, region: str, samples: list[str | int] | None = None, strand: str = "*", method: str | None = None, include_incomplete: bool = False) -> DataFrame:
        """Coverage of a region, raw, or as ``cpm`` or ``rpkm`` of single bases.

        Samples by name or place; RuntimeError for an incomplete one unless
        these are asked for.
        """
        contig, start, end = ranges.parse_region(region)
        chosen = self._chosen(samples, include_incomplete)
        found = signal.region_slice(self._table("coverage"), self.contigs, contig, start, end, strand, chosen)
        if method is None:
            return found
        if method.lower() == "tpm":
            raise ValueError("a region has no TPM")
        sized = found.withColumn("value", F.col("value").cast("double")).withColumn("_length", F.lit(1))
        return normalise.normalise(sized, self.library_sizes(), method, ["value"], "_length", strict=True).drop("_length")

    def _chosen(self, samples: list[str | int] | None, include_incomplete: bool = False) -> list[str]:
        names = self.sample_names
        done = {r["sample_id"] for r in self.store.samples.where("completed").select("sample_id").collect()}
        if samples is None:
            return names if include_incomplete else [n for n in names if n in done]
        chosen = [names[s] if isinstance(s, int) else s for s in samples]
        if unknown := set(chosen) - set(names):
            raise ValueError(f"unknown samples {sorted(unknown)}")
        if not include_incomplete and (lacking := [n for n in chosen if n not in done]):
            raise RuntimeError(f"samples are not complete: {lacking}")
        return chosen

    def sites(self, modality: str, region: str | None = None, samples: list[str | int] | None = None, dense: bool = False) -> DataFrame:
        """Methylation sites or variants, of a region or all.

        ``dense``: every position of any sample for every chosen one, missing
        values filled as in FILL.  Regions of variants count from 1 and
        include their end.
        """
        chosen = self._chosen(samples)
        found = self._table(modality)
        if region is not None:
            contig, start, end = ranges.parse_region(region)
            found = found.where(F.col("contig") == contig) if end is None else sites.site_region(found, contig, start or 0, end, modality == "variants")
        if dense:
            frame = self.spark.createDataFrame([(n,) for n in chosen], "sample_id string")
            return sites.dense_sites(found, frame, FILL)
        return found.where(F.col("sample").isin(chosen))

    def positions(self, modality: str) -> DataFrame:
        return sites.positions(self._table(modality))

    def alleles(self) -> DataFrame:
        return sites.alleles(self._table("variants"), self.store.samples)

    def allele_frequency(self) -> DataFrame:
        return sites.allele_frequency(self._table("variants"))

    def whole(self, contig: str, samples: list[str | int] | None = None, strand: str = "*") -> DataFrame:
        """(sample, pos, value) of every base of a contig, lazily, with its zeros."""
        length = self.contigs.where(F.col("contig") == contig).select("length").first()
        if length is None:
            raise ValueError(f"unknown contig {contig}")
        frame = self.spark.createDataFrame([(n,) for n in self._chosen(samples)], "sample_id string")
        return signal.region_dense(self._table("coverage"), self.contigs, frame, contig, 0, length[0], strand)

    def normalise_windows(self, windows: DataFrame, method: str, bin_size: int | None = None) -> DataFrame:
        return normalise.normalise_windows(windows, self.library_sizes(), method, bin_size)

    def call_peaks(self, tile: int = 128, quantile: float = 0.98, blacklist: DataFrame | None = None, merge: bool = True) -> DataFrame:
        whole = self._table("coverage").where("strand = '*'").drop("strand")
        return peaks.call_peaks(whole, self.contigs, tile, quantile, blacklist, merge)[0]

    def heatmap(self, reduced: DataFrame, variable: str = "mean") -> DataFrame:
        return stats.heatmap_order(reduced.select(F.col("range_index").alias("feature"), "sample", F.col(variable).cast("double").alias("value")))

    def locus(self, region: str, kinds: list[str] | None = None, samples: list[str | int] | None = None) -> DataFrame:
        """Points of the tracks that the store has in a region."""
        have = {"coverage": lambda: self.region(region, samples), "methylation": lambda: self.sites("methylation", region, samples), "variants": lambda: self.sites("variants", region, samples)}
        wanted = kinds or self.modalities
        return profiles.locus({"variant" if k == "variants" else k: have[k]() for k in wanted})

    def metadata(self) -> DataFrame:
        return self.store.metadata()

    def set_metadata(self, metadata: DataFrame, merge: bool = True) -> None:
        self.store.set_metadata(metadata, merge)

    def pca(self, reduced: DataFrame, n_components: int = 10, variable: str = "mean", contigs: list[str] | None = None, **options):
        """Scores and variances, of the ranges on ``contigs`` if given."""
        if contigs is not None:
            reduced = reduced.where(F.col("contig").isin(contigs))
        matrix = reduced.select(F.col("range_index").alias("feature"), "sample", F.col(variable).cast("double").alias("value"))
        return stats.pca(matrix, n_components, **options)

    def correlate(self, reduced: DataFrame, method: str = "pearson", variable: str = "mean", log: bool = True) -> DataFrame:
        matrix = reduced.select(F.col("range_index").alias("feature"), "sample", F.col(variable).cast("double").alias("value"))
        return stats.correlate(stats.drop_constant_samples(stats.log1p(matrix) if log else matrix), method)

    def metaplot(self, windows: DataFrame, n_bins: int, oriented: bool = False, groups: DataFrame | None = None, error: str = "sem") -> DataFrame:
        return profiles.metaplot(profiles.orient(windows, n_bins, oriented), groups, error)

    def tornado(self, windows: DataFrame, n_bins: int, oriented: bool = False, **options) -> DataFrame:
        return profiles.tornado(profiles.orient(windows, n_bins, oriented), **options)
