"""Tables of the data model, enumerations, and what stands for a missing value."""

from __future__ import annotations

from enum import Enum

COVERAGE = "contig string, start bigint, end bigint, sample string, strand string, value bigint"
METHYLATION = "contig string, pos bigint, sample string, methylation_pct double, n_methylated int, n_unmethylated int, n_mc int, n_hmc int, n_c int"
VARIANTS = "contig string, pos bigint, sample string, ref string, alt string, qual double, genotype int, ad_ref int, ad_alt int"
CONTIGS = "contig string, length bigint"
SAMPLES = "sample_idx int, sample_id string, completed boolean, sparsity double, sample_hash string, total_reads bigint, stranded string"

#: What an uncovered cell reads as, by variable.
FILL: dict[str, object] = {
    "value": 0, "n_methylated": 0, "n_unmethylated": 0, "n_mc": 0, "n_hmc": 0, "n_c": 0,
    "methylation_pct": None, "qual": None, "genotype": -1, "ad_ref": 0, "ad_alt": 0,
}


class _Named(str, Enum):
    @classmethod
    def of(cls, value):
        """The member of this name; ValueError for any other."""
        if isinstance(value, cls):
            return value
        try:
            return cls(str(value).lower())
        except ValueError:
            raise ValueError(f"{value!r} is none of {[m.value for m in cls]}") from None


class FeatureType(_Named):
    GENE = "gene"
    TRANSCRIPT = "transcript"
    EXON = "exon"
    PROMOTER = "promoter"


class Reduction(_Named):
    MEAN = "mean"
    SUM = "sum"
    MAX = "max"
    MIN = "min"
    MEDIAN = "median"


class Anchor(_Named):
    MIDPOINT = "midpoint"
    START = "start"
    END = "end"
