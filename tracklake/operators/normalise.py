"""CPM, RPKM and TPM of counts, reductions and windows, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("cpm", "rpkm", "tpm")


def _method(method: str) -> str:
    name = str(method).lower()
    if name not in METHODS:
        raise ValueError(f"{method!r} is none of {METHODS}")
    return name


def with_sizes(signal: DataFrame, sizes: DataFrame, strict: bool = False) -> DataFrame:
    """``signal`` with library_size; ``strict``: ValueError if a sample has none."""
    if strict:
        lacking = signal.select("sample").distinct().join(sizes.where("library_size is not null"), "sample", "left_anti").first()
        if lacking:
            raise ValueError(f"no library size for sample {lacking[0]}")
    return signal.join(F.broadcast(sizes), "sample", "left")


def cpm(value: Column) -> Column:
    return value / (F.col("library_size") / 1e6)


def normalise(signal: DataFrame, sizes: DataFrame, method: str, variables: list[str], length: str | None = None, strict: bool = False) -> DataFrame:
    """Replace ``variables`` by their normalised values.

    ``length``: the column of lengths in bases, for RPKM and TPM.  TPM scales
    reads per kilobase to a million per sample, and needs no library size.
    """
    kind = _method(method)
    if kind != "cpm" and length is None:
        raise ValueError(f"{kind} needs lengths")
    if kind == "tpm":
        kb = F.col(length) / 1000
        # one row of totals for each sample
        totals = signal.groupBy("sample").agg(*(F.sum(F.col(v) / kb).alias(f"_total_{v}") for v in variables))
        joined = signal.join(F.broadcast(totals), "sample")
        return joined.withColumns({v: F.col(v) / kb / (F.col(f"_total_{v}") / 1e6) for v in variables}).drop(*totals.columns[1:])
    sized = with_sizes(signal, sizes, strict)
    per = F.lit(1.0) if kind == "cpm" else F.col(length) / 1000
    return sized.withColumns({v: cpm(F.col(v)) / per for v in variables}).drop("library_size")


def normalise_reduced(reduced: DataFrame, sizes: DataFrame, method: str, strict: bool = False) -> DataFrame:
    """A reduction's variables but count, by its range lengths."""
    variables = [v for v in ("sum", "mean", "max", "min", "median") if v in reduced.columns]
    return normalise(reduced, sizes, method, variables, "range_length", strict)


def normalise_windows(windows: DataFrame, sizes: DataFrame, method: str, bin_size: int | None = None) -> DataFrame:
    """A window's values; RPKM by the bin size, TPM is refused."""
    if _method(method) == "tpm":
        raise ValueError("windows have no TPM")
    return normalise(windows.withColumn("_len", F.lit(bin_size or 1)), sizes, method, ["value"], "_len").drop("_len")
