"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is its five-word shingles, each weighing its number of occurrences
times 1 + ln((1 + N) / (1 + df)) / ln(1 + N): a rare shingle weighs up to
twice as much as one that all N texts hold.  Frequencies are exact and count
every text.

A shingle that no other text holds can't be in an intersection.  So a text can
reach the similarity only if the shingles that it shares make up that part of
its weight; other texts are done.  Texts with equal shingles are one class
from then on.  The rest get consistent weighted samples (equal with a
probability of the weighted Jaccard similarity), banded into buckets; nodes of
one bucket are verified by their exact weighted Jaccard similarity, and classes
are the components of verified links.

Every row counts by itself, whatever its id.  Nodes are numbered rows, and ids
come in last: a class is named by the smallest id in it.  If several classes
have that one, as an id stands beside different texts, or none has an id, a
negative number from the text of its first row names it.

Results for odd input: a text without words (null, empty) is alike only to
equal rows of its id; a shorter text than five words is one shingle; rows
with a null ``doc_id`` are compared as all others; repeated rows and ties fall
in one class, of which one row is kept, that with the smallest id (null ids
last); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import verified_components
from .common import discard, keyed, map_batches, materialise, mix64, release, row_key
from .shared_shingles import Shared, with_frequencies

_U = 2.0**-32


def consistent_samples(element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n samples of a weighted set, as 64-bit values.

    For sample k and element e, r and c are Gamma(2, 1) and b uniform, all
    from hashes of (e, k).  With t = floor(ln w / r + b), the sample is the
    (e, t) with the least ln c - r (t - b + 1).
    """
    log_w = np.log(weight)[:, None]
    found = np.empty(n, np.uint64)
    step = max(1, (1 << 16) // max(1, len(element)))
    half, least = np.uint64(32), np.uint64(0xFFFFFFFF)
    for low in range(0, n, step):
        k = np.arange(low, min(n, low + step), dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x2545F4914F6CDD1D)
        x = mix64(element[:, None] ^ k[None, :])
        y = mix64(x + np.uint64(0x9E6C63D0676A9A99))
        z = mix64(y + np.uint64(0x9E6C63D0676A9A99))
        u = [((part + 0.5) * _U) for part in ((x >> half).astype(np.float64), (x & least).astype(np.float64), (y >> half).astype(np.float64), (y & least).astype(np.float64))]
        r = -np.log(u[0] * u[1])
        c = np.log(-np.log(u[2] * u[3]))
        b = (z >> half).astype(np.float64) * _U
        t = np.floor(log_w / r + b)
        at = np.argmin(c - r * (t - b + 1), axis=0)
        column = np.arange(len(k))
        found[low: low + len(k)] = mix64(element[at] ^ mix64(t[at, column].astype(np.int64).view(np.uint64) + k))
    return found


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket for each band of samples."""
    rows = samples.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for j in range(rows.shape[1]):
        key = mix64(key ^ rows[:, j])
    return key


def weighted_jaccard(a: bytes, b: bytes, weight_a: float, weight_b: float) -> float:
    """Of two sets given as sorted (hash, weight) of shared shingles and total weights."""
    x, y = np.frombuffer(a, _ITEM), np.frombuffer(b, _ITEM)
    at = np.searchsorted(x["hash"], y["hash"])
    at[at == len(x)] = 0
    same = x["hash"][at] == y["hash"] if len(x) else np.zeros(len(y), bool)
    common = float(np.minimum(x["weight"][at[same]], y["weight"][same]).sum(dtype=np.float64))
    return common / (weight_a + weight_b - common)


_ITEM = np.dtype([("hash", "<u8"), ("weight", "<f4")])
_FOUND = "doc_id long, text_low long, text_high long, low long, high long, total double, shared double, items binary, bands array<long>"


def _signatures(n_docs: int, similarity: float, bands: int, rows: int):
    scale = np.log1p(n_docs)

    def run(texts: Shared) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(texts.counts)
        begins = ends - texts.counts
        idf = 1 + np.log((1 + n_docs) / (1 + np.minimum(texts.frequency, n_docs))) / scale if scale else np.ones(len(texts.hashes))
        idf = idf.astype(np.float32).astype(np.float64)
        shared = texts.frequency > 1
        sums = np.concatenate([[0], np.cumsum(idf)])
        part = np.concatenate([[0], np.cumsum(np.where(shared, idf, 0))])
        total, common = sums[ends] - sums[begins], part[ends] - part[begins]
        able = (texts.counts > 0) & (common >= (similarity - 1e-6) * total)
        # a text's name: two sums of hashes of its shingles; without any, its own digest and id
        key = []
        for seed in (0, 0x5851F42D4C957F2D):
            running = np.concatenate([[np.uint64(0)], np.cumsum(mix64(texts.hashes ^ np.uint64(seed)), dtype=np.uint64)])
            key.append(running[ends] - running[begins])
        bare = texts.counts == 0
        if bare.any():
            ids, low, high = (texts.rows.column(c).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("doc_id", "text_low", "text_high"))
            nameless = texts.rows.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
            key[0][bare] = mix64(mix64(ids + nameless) ^ low)[bare]
            key[1][bare] = mix64(mix64(ids ^ (nameless << np.uint64(17))) + high)[bare]
        names = [k.view(np.int64) for k in key]
        described: list[tuple] = []
        seen: set[tuple[int, int]] = set()
        for i, ok in enumerate(able.tolist()):
            if not ok or (name := (int(names[0][i]), int(names[1][i]))) in seen:  # the set stands with its first text of the run
                described.append((None,) * 4)
                continue
            seen.add(name)
            at = slice(int(begins[i]), int(ends[i]))
            element, where, times = np.unique(texts.hashes[at], return_index=True, return_counts=True)
            weight = (times * idf[at][where]).astype(np.float32)
            items = np.empty(len(element), _ITEM)
            items["hash"], items["weight"] = element, weight
            items = items[shared[at][where]]
            buckets = band_keys(consistent_samples(element, weight.astype(np.float64), bands * rows), bands)
            described.append((float(weight.sum(dtype=np.float64)), float(items["weight"].sum(dtype=np.float64)), items.tobytes(), buckets.view(np.int64).tolist()))
        columns = list(zip(*described, strict=True)) or [()] * 4
        kinds = [pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
        own = [texts.rows.column(c).combine_chunks().cast(pa.int64()) for c in ("doc_id", "text_low", "text_high")]
        yield pa.record_batch(
            [*own, *map(pa.array, names), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "text_low", "text_high", "low", "high", "total", "shared", "items", "bands"],
        )

    return run


def _verifier(similarity: float):
    """Pairs (a, b) of nodes whose weighted Jaccard similarity holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            values = zip(*(batch.column(c) for c in ("items_a", "items_b", "total_a", "total_b")), strict=True)
            holds = [i for i, (x, y, p, q) in enumerate(values) if weighted_jaccard(x.as_py(), y.as_py(), p.as_py(), q.as_py()) >= similarity]
            yield pa.record_batch([pa.array([a[i] for i in holds], pa.int64()), pa.array([b[i] for i in holds], pa.int64())], names=["a", "b"])

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        first = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"), F.col("total").alias("total_a"))
        second = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"), F.col("total").alias("total_b"))
        return map_batches(pairs.join(first, "a").join(second, "b").select("a", "b", "items_a", "items_b", "total_a", "total_b"), run, "a long, b long")

    return verify


def classified(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 20, rows: int = 5) -> DataFrame:
    """doc_id, text_low, text_high (the text's digest), class_id, class_size and kept of every row.

    A pair at the similarity shares a bucket with 1 - (1 - 0.8**5)**20, that
    is 99.97 %, and classes are found along any chain of links.
    """
    source = keyed(docs)
    n_docs = source.count()
    found = with_frequencies(source, _signatures(n_docs, similarity, bands, rows), _FOUND, width)
    # numbers of rows, fixed as they are written
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "signatures")
    release(docs.sparkSession)  # the texts' shuffle
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "text_low")).alias("first")
    describing = F.min(F.when(F.col("bands").isNotNull(), F.col("row"))).alias("describing")
    sets = materialise(found.groupBy("low", "high").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n"), first, describing), "sets")
    chosen = sets.where("describing is not null").select(F.col("describing").alias("row"), "node")
    nodes = materialise(found.where("bands is not null").join(chosen, "row").select("node", "total", "shared", "items", "bands"), "nodes")
    placed = materialise(found.select("row", "doc_id", "text_low", "text_high", "low", "high"), "rows")
    discard(found, collect=True)
    members = nodes.select("node", "total", "shared", F.explode("bands").alias("bucket"))
    linked = verified_components(members, nodes.select("node", "items", "total"), similarity, _verifier(similarity))
    discard(nodes, collect=True)
    sets = sets.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = sets.groupBy("component").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"))
    # of the classes with one smallest id, one is named by it
    named = classes.where("not first.nameless").groupBy(F.col("first.doc_id").alias("id")).agg(F.min(F.struct("first.text_low", "component")).alias("by"))
    named = named.select(F.col("by.component").alias("component"), F.col("id").alias("class_id"))
    other = -1 - F.shiftrightunsigned(F.col("first.text_low"), 1)
    classes = classes.join(named, "component", "left").select("component", "class_size", F.col("first.row").alias("keep"), F.coalesce("class_id", other).alias("class_id"))
    by_set = sets.select("low", "high", "component").join(classes, "component").drop("component")
    return placed.join(by_set, ["low", "high"]).select(
        "doc_id", "text_low", "text_high", "class_id", "class_size", (F.col("row") == F.col("keep")).alias("kept")
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size (rows) and kept of every row; one row of a class is kept."""
    return classified(docs, **options).select("doc_id", "class_id", "class_size", "kept")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of ``docs`` with all their columns.

    Rows are told by id and text together, so that neither a null id nor one
    that stands beside different texts loses a row.  Of rows equal in both,
    any one stays if one is kept.
    """
    found = classified(docs, **options).groupBy("doc_id", "text_low", "text_high").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("keep"))
    changed = found.where("keep < n").select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "text_low", "text_high", "keep")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_key(docs))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "text_low", "text_high")]
    marked = rows.join(changed, same[0] & same[1] & same[2], "left")
    place = F.row_number().over(Window.partitionBy("doc_id", "text_low", "text_high").orderBy(F.lit(0)))
    one = marked.where("_keep > 0").withColumn("_place", place).where("_place <= _keep")
    return marked.where("_keep is null").select("_row").union(one.select("_row")).select("_row.*")
