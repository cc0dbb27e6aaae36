"""Ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its lower-cased words, their first four and
five bytes, and tokens for the shape of its characters.  One weight vector w is shared by all grades, and
P(grade <= k) = sigmoid(theta[k] - w.x) with ordered thresholds theta.  The
model is fitted on a sample of labelled rows of bounded, documented size (the
``sample`` rows with the smallest hash of their id): features that tell the
grades apart are counted and chosen in Spark, and the penalised likelihood,
which is convex, is brought to its least on the driver over their two-byte
numbers.  Every text is scored whole.

Results for odd input: a null or empty text has shape tokens only and is
scored like any other; a null ``doc_id`` stays null; repeated rows give
repeated results and count once in the fit, as equal feature sets do; null
ratings are left out; where several ratings share an id, the lowest counts.
Without ratings of two grades all texts are kept with the top grade.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, map_batches, materialise, mix64, word_runs

BITS = 18
#: Sizes in bytes of the word beginnings that are features too.
BEGINNINGS = (4, 5)
#: Byte classes whose shares make the shape tokens.
SHAPES = {
    "symbol": b"#*$%&|<>",
    "mark": b"!?",
    "upper": bytes(range(ord("A"), ord("Z") + 1)),
    "digit": bytes(range(ord("0"), ord("9") + 1)),
    "line": b"\n",
}


def _shape_tables() -> np.ndarray:
    tables = np.zeros((len(SHAPES), 256), np.int64)
    for i, members in enumerate(SHAPES.values()):
        tables[i, list(members)] = 1
    return tables


_TABLES = _shape_tables()


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every word, word beginning and shape token.

    Shape tokens are the share of each byte class, and the share of words that
    repeat the word before, in halvings.
    """
    n = len(words.offsets) - 1
    n_words = np.diff(words.first)
    owner = np.repeat(np.arange(n), n_words)
    whole, *beginnings = words.hashes(*BEGINNINGS)
    text, hashed = [owner], [whole]
    for size, part in zip(BEGINNINGS, beginnings, strict=True):
        longer = words.end - words.start > size
        text.append(owner[longer])
        hashed.append(mix64(part[longer] + np.uint64(size)))
    shares = []
    for table in _TABLES:
        total = np.concatenate([[0], np.cumsum(table[words.data])])
        shares.append((total[words.offsets[1:]] - total[words.offsets[:-1]]) / np.maximum(np.diff(words.offsets), 1))
    again = np.zeros(len(whole), bool)
    again[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])
    shares.append(np.bincount(owner[again], minlength=n) / np.maximum(n_words, 1))
    for i, share in enumerate(shares):
        level = np.where(share > 0, np.clip(np.ceil(-np.log2(np.maximum(share, 1e-9))), 0, 12), 13)
        text.append(np.arange(n))
        hashed.append(mix64((level.astype(np.uint64) + np.uint64(64 * i + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate(text), (np.concatenate(hashed) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class OrdinalModel:
    """Weights by feature, and thresholds below each grade but the lowest."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    grades: int = 3

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        if not len(self.thresholds):
            return np.ones((len(score), self.grades - 1))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def objective(params: np.ndarray, column: np.ndarray, ends: np.ndarray, grades: np.ndarray, n_grades: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with its penalty, and the gradient.

    params: the weights, then the thresholds; ``column``: the features of all
    rows one after the other, where row i ends at ``ends[i]``.  Infinite if the
    thresholds aren't ordered.  Rows are taken in blocks, to hold few numbers.
    """
    levels, n = n_grades - 1, len(grades)
    w, theta = params[:-levels], params[-levels:]
    if levels > 1 and np.diff(theta).min() <= 0:
        return np.inf, params
    value, by_weight, by_theta = 0.0, np.zeros(len(w)), np.zeros(levels)
    for low in range(0, n, 2048):
        g = grades[low: low + 2048]
        begin = np.concatenate([[ends[low - 1] if low else 0], ends[low: low + len(g) - 1]])
        part = column[begin[0]: ends[low + len(g) - 1]]
        row = np.repeat(np.arange(len(g), dtype=np.int32), ends[low: low + len(g)] - begin)
        score = np.bincount(row, weights=w[part], minlength=len(g))
        below, above = np.maximum(g - 1, 0), np.minimum(g, levels - 1)
        upper = np.where(g < levels, _sigmoid(theta[above] - score), 1.0)
        lower = np.where(g > 0, _sigmoid(theta[below] - score), 0.0)
        p = np.maximum(upper - lower, 1e-300)
        value -= float(np.log(p).sum())
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_weight += np.bincount(part, weights=(du - dl)[row], minlength=len(w))
        by_theta += np.bincount(below, weights=dl * (g > 0), minlength=levels) - np.bincount(above, weights=du * (g < levels), minlength=levels)
    return value / n + l2 / 2 * float(w @ w), np.concatenate([by_weight / n + l2 * w, by_theta / n])


def minimise(f, x: np.ndarray, rounds: int = 200, tolerance: float = 1e-6, memory: int = 8) -> np.ndarray:
    """The least of a smooth convex function by limited-memory BFGS with halved steps."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < tolerance:
            break
        move, back = -slope, []
        for s, y in reversed(steps):
            part = float(s @ move) / float(s @ y)
            move = move - part * y
            back.append(part)
        if steps:
            s, y = steps[-1]
            move = move * (float(s @ y) / float(y @ y))
        for (s, y), part in zip(steps, reversed(back), strict=True):
            move = move + (part - float(y @ move) / float(s @ y)) * s
        size = 1.0 if steps else min(1.0, 1 / float(np.abs(slope).sum()))
        while size > 1e-12:
            tried, there = f(x + size * move)
            if tried <= value + 1e-4 * size * float(slope @ move):
                break
            size /= 2
        else:
            break
        s, y = size * move, there - slope
        if float(s @ y) > 1e-12:
            steps = [*steps[1 - memory:], (s, y)]
        x, value, slope = x + s, tried, there
    return x


def fit(used: np.ndarray, columns: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, l2: float = 1e-4) -> OrdinalModel:
    """The model of rows given by their columns, places in the features ``used``."""
    model = OrdinalModel(grades=n_grades)
    if len(columns) < 2 or len(np.unique(grades)) < 2:
        return model
    levels = n_grades - 1
    shares = np.array([np.clip((grades <= k).mean(), 1e-3, 1 - 1e-3) for k in range(levels)])
    theta = np.log(shares / (1 - shares)) + 1e-3 * np.arange(levels)
    ends = np.cumsum([len(c) for c in columns])
    column = np.concatenate(columns)
    found = minimise(lambda x: objective(x, column, ends, grades, n_grades, l2), np.concatenate([np.zeros(len(used)), theta]))
    model.features, model.weights, model.thresholds = used, found[:-levels], found[-levels:]
    return model


def feature_sets(docs: DataFrame) -> DataFrame:
    """grade and the distinct features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words in word_runs(batch.column("text")):
                text, feature = features(words)
                keys = np.unique(text << BITS | feature)
                n = len(words.first) - 1
                cuts = np.searchsorted(keys, np.arange(n + 1) << BITS).astype(np.int32)
                ids = (keys & ((1 << BITS) - 1)).astype(np.int32)
                yield pa.record_batch([batch.column("grade").slice(low, n).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))], names=["grade", "features"])

    return map_batches(docs, run, "grade int, features array<int>")


def telling(sets: DataFrame, least_z: float, least_n: int, most: int) -> np.ndarray:
    """Features that tell the top grade from the others, at most ``most``.

    One is in ``least_n`` sets, and its share among the top grade differs from
    that among the others by ``least_z`` standard errors; those that differ
    most are taken.  Counted in Spark, by feature.
    """
    top = F.col("grade") == sets.agg(F.max("grade")).first()[0]
    n, n1 = sets.agg(F.count(F.lit(1)), F.sum(top.cast("long"))).first()
    if not n or n1 == n:
        return np.zeros(0, np.int64)
    counts = sets.select(F.explode("features").alias("feature"), top.cast("long").alias("top")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("top").alias("n1"))
    share = F.col("n") / n
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / (n - n1)))
    z = F.abs(F.col("n1") / n1 - (F.col("n") - F.col("n1")) / (n - n1)) / error
    chosen = counts.where(F.col("n") >= least_n).select("feature", z.alias("z")).where(F.col("z") >= least_z)
    return np.array(sorted(r["feature"] for r in chosen.orderBy(F.col("z").desc(), "feature").limit(most).collect()), np.int64)


def design(sets: DataFrame, used: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, grades) of all sets: places in ``used``, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(1 << BITS, -1, np.int32)
        index[used] = np.arange(len(used))
        for batch in batches:
            listed = batch.column("features")
            at = index[listed.flatten().to_numpy(zero_copy_only=False)]
            ends = listed.offsets.to_numpy() - listed.offsets[0].as_py()
            held = np.concatenate([[0], np.cumsum(at >= 0)])[ends]
            raw = at[at >= 0].astype("<u2").tobytes()
            yield pa.record_batch([batch.column("grade"), pa.array([raw[2 * a: 2 * b] for a, b in zip(held[:-1], held[1:], strict=True)], pa.binary())], names=["grade", "columns"])

    # in a fixed order, so that sums of floats come out alike
    rows = map_batches(sets, run, "grade int, columns binary").orderBy("grade", "columns").toArrow()
    columns = [np.frombuffer(raw.as_buffer(), "<u2") if raw.as_buffer().size else np.zeros(0, "<u2") for raw in rows.column("columns")]
    return columns, rows.column("grade").to_numpy().astype(np.int64)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") >= 1, 1).otherwise(2)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, sample: int = 20_000, least_z: float = 5.0, least_n: int = 5, most: int = 4096, **options) -> OrdinalModel:
    """Fit on at most ``sample`` rated ids, those with the smallest hashes.

    Of texts that share an id, the one with the least hash counts.  Texts and
    their whole feature sets stay on the executors; the driver gets at most
    ``most`` features and, for each of the ``sample`` rows, the two-byte
    numbers of those that it has.
    """
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most ``sample`` rows of 12 bytes
    joined = source.join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("grade").alias("grade"))
    sets = materialise(feature_sets(one.select("text", "grade")).dropDuplicates(["grade", "features"]), "rated")
    used = telling(sets, least_z, least_n, min(most, 1 << 16))
    model = fit(used, *design(sets, used), **options)
    discard(sets, collect=True)
    return model


def _scorer(model: OrdinalModel):
    """(first text, P(grade >= k) for each k) of runs of a text column."""
    sparse = model.features, model.weights

    def run(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        weight = np.zeros(1 << BITS)
        weight[sparse[0]] = sparse[1]
        for low, words in word_runs(column):
            text, feature = features(words)
            used = weight[feature] != 0
            keys = np.unique(text[used] << BITS | feature[used])
            score = np.bincount(keys >> BITS, weights=weight[keys & ((1 << BITS) - 1)], minlength=len(words.first) - 1)
            yield low, model.tails(score)

    return run


def classify(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_top and kept (p_top >= least_tail) of every text."""
    scores = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for low, tails in scores(batch.column("text")):
                yield pa.record_batch([
                    ids.slice(low, len(tails)), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail),
                ], names=["doc_id", "expected_grade", "p_top", "kept"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, expected_grade double, p_top double, kept boolean")


def accepted(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is kept."""
    scores = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, tails in scores(batch.column("text")):
                yield batch.slice(low, len(tails)).filter(pa.array(tails[:, -1] >= least_tail))

    return map_batches(docs, run, docs.schema)
