"""Best-two-fit packing of tokenised documents into sequences.

Pieces of one length are interchangeable, so the packing is planned on the
histogram of lengths, which has at most ``size`` entries however large the
input is.  A bin is filled greedily with the longest piece that fits; then its
smallest piece is replaced by two unpacked ones if these fit the gap that it
leaves more tightly.  The same bin is repeated while the histogram allows it.
Spark then numbers the pieces of each length and gives each its planned place.

Results for odd input: a null or empty text is one piece with the end id
alone; a null ``doc_id`` stays null; repeated rows are packed each; an empty
table gives an empty result.  Texts of any length are cut, never truncated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise

#: A text of these characters only is split into words here, and each word is
#: encoded by the library once; any other text is encoded by the library whole.
_LETTER = "a-zß-öø-įı-ňŊ-ž"
_PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-įı-ňŊ-ž]*")
#: The splitting pattern, a fixed value of the vocabulary, for plain lower-case texts.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\t\n\r {_LETTER}0-9]+")

#: A length class is numbered in this many parts, as it may hold most rows.
SHARDS = 4096


class WordEncoder(dict):
    """Little-endian ids of words and texts, as the library gives them."""

    def __init__(self, path: str, remembered: int = 200_000):
        from tokenizers import Tokenizer

        self.library, self.remembered = Tokenizer.from_file(path), remembered
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        return self.whole(word)

    def learn(self, words: list[str]) -> None:
        """Encode words in one call; each ends with the only symbol that ends one."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            self.update((w, self.whole(w)) for w in words)
            return
        raw = ids.tobytes()
        self.update((w, raw[a:b]) for w, a, b in zip(words, [0, *ends], ends, strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_SPLIT.findall(t.lower()) if _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        if len(self) >= self.remembered:
            self.clear()
        new = [w for w in set().union(*filter(None, split)).difference(self) if len(w) <= 64]
        for low in range(0, len(new), 4096):
            self.learn(new[low: low + 4096])
        return [self.whole(t) if words is None else b"".join(map(self.__getitem__, words)) for t, words in zip(texts, split, strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32) of each piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                part = whole.slice(low, 256)
                rows = []
                coded = encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coded, strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc_id, i, at, min(size, n - at), ids[4 * at: 4 * (at + size)]) for i, at in enumerate(range(0, n, size))]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order, how often), by best-two-fit on a histogram."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= size:
            raise ValueError(f"a piece of length {length} doesn't fit {size}")
        left[length] = n
    numbers = np.arange(size + 1)

    def floors() -> np.ndarray:
        """The longest unpacked length of at most x, for each x."""
        return np.maximum.accumulate(np.where(left > 0, numbers, 0))

    bins = []
    while True:
        floor = floors()
        if not floor[size]:
            return bins
        held: list[int] = []
        gap = size
        while gap and floor[gap]:
            length = int(floor[gap])
            held.append(length)
            left[length] -= 1
            gap -= length
            if not left[length]:
                floor = floors()
        if gap and len(held) > 1:
            smallest = min(held)
            room = gap + smallest
            one = np.flatnonzero(left[:room] > 0)
            two = floor[room - one]
            alone = (two == one) & (left[one] < 2)
            two = np.where(alone, floor[np.maximum(one - 1, 0)], two)
            total = np.where(two > 0, one + two, 0)
            if len(total) and total.max() > smallest:
                best = int(total.argmax())
                held.remove(smallest)
                left[smallest] += 1
                for length in (int(one[best]), int(two[best])):
                    held.append(length)
                    left[length] -= 1
        times = Counter(held)
        more = min(left[length] // n for length, n in times.items())
        for length, n in times.items():
            left[length] -= n * more
        bins.append((sorted(held, reverse=True), int(more) + 1))


def places(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, number in a bin, offset).

    The pieces of one length are handed out by rank, bin by bin.
    """
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for held, times in bins:
        offset = 0
        for length, n in sorted(Counter(held).items(), reverse=True):
            rows.append((length, taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``pieces`` with its rank (from 0) among those of its length.

    A length is numbered in SHARDS parts by hash, whose sizes are summed up
    before: no task holds a whole length.
    """
    parts = pieces.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(SHARDS)).cast("int"))
    sizes = parts.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_shard").orderBy(*order)
    numbered = parts.withColumn("_rank", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_shard", "_before")


def pack(pieces: DataFrame, size: int = 4096, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length``.

    The driver gets the histogram of lengths (at most ``size`` rows) and makes
    the plan, of some bins for each length; nothing there grows with the rows.
    """
    pieces = materialise(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan(counts, size))
    columns = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for (length, rank): ranks stay below 2**49
        keys = where[:, 0] << 49 | where[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = where[np.searchsorted(keys, length << 49 | rank, side="right") - 1]
            bin_, slot = np.divmod(rank - row[:, 1], np.maximum(row[:, 3], 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(row[:, 2] + bin_), pa.array(row[:, 4] + slot * length)],
                names=[*columns, "sequence_id", "offset"],
            )

    if not len(where):
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    return map_batches(ranked(pieces, list(order)).select(*columns, "_rank"), run, f"{fields}, sequence_id long, offset long")
