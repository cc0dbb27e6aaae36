"""Shared parts: materialised intermediates, vectorised words, shingles."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# --------------------------------------------------------------------------
# Intermediates
# --------------------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Only a local session, where everything
    runs on one machine, may leave it unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as its object."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Folder of each session, which goes when the session's process ends.
_SESSIONS: dict[str, str] = {}
#: Folder of each table that materialise() wrote.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Whether Spark deletes a write's shuffle files as soon as it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session_dir(spark: SparkSession) -> str:
    """This session's folder in the shared one; it is deleted when the driver's process ends."""
    base = shared_dir(spark)
    own = f"{base}/corpus-{spark.sparkContext.applicationId}"
    if _SESSIONS.get(base) != own:
        system, at = _file_system(spark, own)
        system.mkdirs(at)
        system.deleteOnExit(at)
        _SESSIONS[base] = own
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it ran,
    and readers prune columns.  The write's shuffle files go with its end, not
    when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    return found


def discard(*tables: DataFrame, collect: bool = False) -> None:
    """Delete what materialise() wrote for these tables; no later plan may read them.

    ``collect``: let the driver's JVM collect its garbage too, upon which Spark
    drops the shuffle files of the steps behind these tables.
    """
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path is not None:
            system, at = _file_system(table.sparkSession, path)
            system.delete(at, True)
    if collect and tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, upon which Spark drops the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


# --------------------------------------------------------------------------
# Python steps
# --------------------------------------------------------------------------

#: Bytes of a batch that goes to a Python worker, whatever the number of its rows.
BATCH = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Batches of this session go by bytes: ten thousand long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def give_back() -> None:
    """Return freed memory to the system, which an idle worker would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, whose worker gives its memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(whole, schema)


def row_key(docs: DataFrame) -> list[Column]:
    """What tells a row: doc_id, and text_low and text_high, 128 bits of hash of its text."""
    text = F.col("text").cast("string")
    # a null text differs from an empty one
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, text.isNull()).alias("text_low"), F.xxhash64(F.lit("high"), text.isNull(), text).alias("text_high")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_low, text_high and text of every row."""
    return docs.select(*row_key(docs), F.col("text").cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------
# Hashes
# --------------------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so equal outputs mean equal inputs."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


# --------------------------------------------------------------------------
# Words
# --------------------------------------------------------------------------

def _byte_table() -> np.ndarray:
    """Lower-cased byte for a byte inside a word, 0 for one between words.

    A word is a run of ``0-9``, ``a-z`` (after lower-casing ``A-Z``) and
    characters outside ASCII.
    """
    table = np.zeros(256, dtype=np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for first, last in (("0", "9"), ("a", "z")):
        table[ord(first): ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    table[ord("A"): ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


_WORD_BYTE = _byte_table()


class Words:
    """Words of a run of texts, as arrays over the concatenated UTF-8 bytes.

    ``start`` and ``end`` are byte offsets into ``data``; ``first[i]`` is the
    index of text ``i``'s first word (one more entry closes the last text).
    """

    __slots__ = ("data", "offsets", "start", "end", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = _WORD_BYTE[data] != 0
        n = len(inside)
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            before[edges] = False
            after[edges - 1] = False
        # runs are far below 2**31 bytes, but for a single text that is longer
        kind = np.int32 if n < 1 << 31 else np.int64
        self.start = np.flatnonzero(inside & ~before).astype(kind)
        self.end = np.flatnonzero(inside & ~after).astype(kind) + kind(1)
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def _sums(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, dtype=U64)
        term = _WORD_BYTE[self.data].astype(U64)
        term *= _powers(_BASE, n)
        np.cumsum(term, out=total[1:])
        return total

    def hashes(self, *prefixes: int) -> np.ndarray | list[np.ndarray]:
        """One 64-bit hash per word: a polynomial over its lower-cased bytes.

        With ``prefixes``, also one list each for the words' first bytes.
        """
        total = self._sums()
        scale = _powers(_INVERSE, len(self.data) + 1)[self.start]
        found = []
        for most in (None, *prefixes):
            end = self.end if most is None else np.minimum(self.end, self.start + most)
            value = (total[end] - total[self.start]) * scale
            found.append(mix64(value + (end - self.start).astype(U64) * U64(0xA24BAED4963EE407)))
        return found if prefixes else found[0]

    def text(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i]: self.offsets[i + 1]]


def sequence_hashes(hashed: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each run [begin, end) of word hashes: a polynomial over them."""
    total = np.zeros(len(hashed) + 1, U64)
    np.cumsum(hashed * _powers(_BASE, len(hashed)), out=total[1:])
    value = (total[end] - total[begin]) * _powers(_INVERSE, len(hashed) + 1)[begin]
    return mix64(value + (end - begin).astype(U64) * U64(0x8CB92BA72F3D8DD7))


def word_hash(word: str) -> int:
    """The hash that :class:`Words` gives one word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Words(data, np.array([0, len(data)])).hashes()[0])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset: column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``most`` bytes each (or one longer text)."""
    n = len(offsets) - 1
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def word_runs(column: pa.Array | pa.ChunkedArray, most: int = 1 << 19) -> Iterator[tuple[int, Words]]:
    """Words of a text column, a bounded number of bytes at a time."""
    data, offsets = utf8(column)
    for low, high in runs(offsets, most):
        at = offsets[low: high + 1]
        yield low, Words(data[at[0]: at[-1]], at - at[0])


# --------------------------------------------------------------------------
# Shingles
# --------------------------------------------------------------------------

def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per group: group of each item, and its index in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return group, np.arange(int(counts.sum())) - np.repeat(begin, counts)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows, and their number per text.

    A text shorter than ``width`` has one shingle, of all its words; a text
    without words has none.
    """
    hashed = words.hashes()
    n_words = np.diff(words.first)
    counts = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    text, index = spans(counts)
    at = words.first[:-1][text] + index
    padded = np.concatenate([hashed, np.zeros(width, U64)])
    total = np.zeros(len(at), U64)
    left = n_words[text] - index
    for j in range(width):
        factor = U64((_BASE * (2 * j + 3) + 0x1D8E4E27C47D124F * j) & 0xFFFFFFFFFFFFFFFF | 1)
        part = padded[at + j]
        part[left <= j] = 0
        total += part * factor
    return mix64(total), counts
