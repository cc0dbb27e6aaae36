"""Correlation, principal components and preparation of feature matrices.

Matrices are long: (feature, sample, value).  Sample by sample products come
from a self-join on the feature, aggregated before anything reaches the
driver, which only sees matrices of samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log1p(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("value", F.log1p("value"))


def drop_constant_samples(matrix: DataFrame) -> DataFrame:
    varied = matrix.groupBy("sample").agg(F.var_pop("value").alias("v")).where("v > 0").select("sample")
    return matrix.join(F.broadcast(varied), "sample", "left_semi")


def average_ranks(matrix: DataFrame) -> DataFrame:
    """Ranks within each sample; ties share their mean rank.

    Ranks come from counts per value, so equal values meet before the window.
    """
    sizes = matrix.groupBy("sample", "value").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sample").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = sizes.withColumn("rank", before + (F.col("n") + 1) / 2)
    return matrix.join(ranks.select("sample", "value", "rank"), ["sample", "value"]).select("feature", "sample", F.col("rank").cast("double").alias("value"))


def correlate(matrix: DataFrame, method: str = "pearson") -> DataFrame:
    """sample_a, sample_b, r of all pairs of samples."""
    if method == "spearman":
        matrix = average_ranks(matrix)
    elif method != "pearson":
        raise ValueError(f"{method!r} is neither pearson nor spearman")
    a = matrix.select("feature", F.col("sample").alias("sample_a"), F.col("value").alias("x"))
    b = matrix.select("feature", F.col("sample").alias("sample_b"), F.col("value").alias("y"))
    return a.join(b, "feature").groupBy("sample_a", "sample_b").agg(F.corr("x", "y").alias("r"))


def handle_missing(matrix: DataFrame, strategy: str = "drop") -> DataFrame:
    """drop: features with a null go; zero: nulls are 0; mean: features over half
    null go, and other nulls become the feature's mean."""
    if strategy == "zero":
        return matrix.na.fill(0.0, ["value"])
    if strategy not in ("drop", "mean"):
        raise ValueError(f"{strategy!r} is none of drop, zero, mean")
    lost = F.sum(F.col("value").isNull().cast("int"))
    stats = matrix.groupBy("feature").agg(lost.alias("_lost"), F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"))
    stats = stats.where("_lost = 0" if strategy == "drop" else "2 * _lost <= _n")
    joined = matrix.join(stats, "feature")
    return joined.withColumn("value", F.coalesce("value", "_mean")).drop("_lost", "_n", "_mean")


def standardise(matrix: DataFrame) -> DataFrame:
    """(value - mean) / max(population deviation, 1e-12) of each feature."""
    moments = matrix.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return matrix.join(moments, "feature").withColumn("value", (F.col("value") - F.col("_m")) / F.greatest("_s", F.lit(1e-12))).drop("_m", "_s")


def subset_features(matrix: DataFrame, size: int, strategy: str = "first", seed: int = 0) -> DataFrame:
    """``size`` features: the first, random ones, or those of highest variance."""
    features = matrix.groupBy("feature").agg(F.var_pop("value").alias("v"))
    order = {"first": [F.col("feature")], "random": [F.xxhash64("feature", F.lit(seed)), F.col("feature")], "top_variance": [F.col("v").desc(), F.col("feature")]}
    if strategy not in order:
        raise ValueError(f"{strategy!r} is none of {', '.join(order)}")
    return matrix.join(features.orderBy(*order[strategy]).limit(size).select("feature"), "feature", "left_semi")


def gram(matrix: DataFrame) -> tuple[list[str], np.ndarray]:
    """Samples and the products of their centred features, samples by samples."""
    means = matrix.groupBy("feature").agg(F.avg("value").alias("_m"))
    centred = matrix.join(means, "feature").select("feature", "sample", (F.col("value") - F.col("_m")).alias("v"))
    a = centred.select("feature", F.col("sample").alias("a"), F.col("v").alias("x"))
    b = centred.select("feature", F.col("sample").alias("b"), F.col("v").alias("y"))
    rows = a.join(b, "feature").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g")).collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows}, key=str)
    at = {s: i for i, s in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in rows:
        g[at[r["a"]], at[r["b"]]] = g[at[r["b"]], at[r["a"]]] = r["g"]
    return names, g


def pca(matrix: DataFrame, n_components: int = 2, missing: str = "drop", scale: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sample, component, score) and (component, explained_variance, ratio).

    Scores come from the eigenvectors of the Gram matrix of samples; each
    component's sign makes its largest score positive.
    """
    matrix = handle_missing(matrix, missing)
    names, g = gram(standardise(matrix) if scale else matrix)
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][:n_components]
    values_, total = np.maximum(values[order], 0), max(float(np.trace(g)), 1e-300)
    scores = vectors[:, order] * np.sqrt(values_)
    scores *= np.where(scores[np.abs(scores).argmax(0), np.arange(len(order))] < 0, -1, 1)
    spark = matrix.sparkSession
    rows = [(names[i], j + 1, float(scores[i, j])) for i in range(len(names)) for j in range(len(order))]
    kind = matrix.schema["sample"].dataType.simpleString()
    ratios = [(j + 1, float(v / max(len(names) - 1, 1)), float(v / total)) for j, v in enumerate(values_)]
    return spark.createDataFrame(rows, f"sample {kind}, component int, score double"), spark.createDataFrame(ratios, "component int, explained_variance double, ratio double")


def scree(ratios: DataFrame) -> DataFrame:
    """component, ratio and the cumulative ratio; a row for each component."""
    return ratios.select("component", "ratio", F.sum("ratio").over(Window.orderBy("component")).alias("cumulative"))


def cluster_order(distance: np.ndarray) -> list[int]:
    """Leaf order of average-linkage clustering of a small distance matrix."""
    groups = {i: [i] for i in range(len(distance))}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        keys = sorted(groups)
        sub = d[np.ix_(keys, keys)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        i, j = keys[min(i, j)], keys[max(i, j)]
        a, b = len(groups[i]), len(groups[j])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        d[i, i] = np.inf
        groups[i] += groups.pop(j)
    return next(iter(groups.values()), [])


def heatmap_order(matrix: DataFrame) -> DataFrame:
    """sample and its place in the clustered order of samples (log values)."""
    names, g = gram(drop_constant_samples(log1p(matrix)))
    square = np.diag(g)
    order = cluster_order(np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * g, 0)))
    kind = matrix.schema["sample"].dataType.simpleString()
    return matrix.sparkSession.createDataFrame([(names[i], k) for k, i in enumerate(order)], f"sample {kind}, place int")
