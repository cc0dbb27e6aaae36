"""Exact document frequencies of word shingles, brought back to the texts.

Texts are dealt to buckets by a hash of the row.  Each bucket sends the
distinct hashes of its shingles, with the number of its texts that hold them,
to parts of the hash space as packed arrays; a part sums them up and sends the
frequencies of those in two or more texts back to the buckets, as marks in the
order of the bucket's own hashes.  There, a function gets the bucket's texts, their shingles and their frequencies.

A frequent shingle is one entry per bucket, so no part gathers a row for each
text that holds it, and neither buckets nor parts grow if shuffle partitions
grow with the input.  Shingles are compared by 40 bits of hash and the bits of
their part, which grow with the partitions.  Two that agree there by chance
(some in a million) count as one: a frequency is never too low, so that what
others share stays an upper bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, give_back, shingles, shuffle_partitions, word_runs

LOW = 40


@dataclass
class Shared:
    """A run of a bucket's texts: words, shingles, and texts that hold each."""

    rows: pa.Table  #: the texts' rows
    words: Words
    hashes: np.ndarray  #: of each shingle, in order
    counts: np.ndarray  #: shingles of each text
    frequency: np.ndarray  #: texts that hold each shingle (at least 1)


def _packed(values: np.ndarray) -> bytes:
    """The low 40 bits of each value."""
    return np.ascontiguousarray((values & np.uint64((1 << LOW) - 1)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : LOW // 8].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    whole = np.zeros((len(raw) // (LOW // 8), 8), np.uint8)
    whole[:, : LOW // 8] = np.frombuffer(raw, np.uint8).reshape(-1, LOW // 8)
    return whole.view("<u8").ravel()


def _binary(table: pa.Table, column: str) -> list[bytes]:
    return table.column(column).to_pylist()


def with_frequencies(docs: DataFrame, fn: Callable[[Shared], Iterator[pa.RecordBatch]], schema: str, width: int = 5, spread: int = 2) -> DataFrame:
    """Apply ``fn`` to all rows of ``docs`` (doc_id, text and any others).

    ``spread`` times as many buckets and parts are used as shuffle partitions.
    """
    n = spread * shuffle_partitions(docs.sparkSession)
    bits = max(1, (n - 1).bit_length())
    # beyond 2**24 parts, all 64 bits of hash are used
    kept = min(LOW, 64 - bits)
    shift = np.uint64(64 - kept - bits)

    bound_batches(docs.sparkSession)
    dealt = docs.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def count(bucket: pa.Table) -> pa.Table:
        found = []
        for _, words in word_runs(bucket.column("text")):
            hashed, counts = shingles(words, width)
            hashed >>= shift
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(hashed, kind="stable")
            hashed, owner = hashed[order], owner[order]
            if not len(hashed):
                continue
            new = np.ones(len(hashed), bool)
            new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
            first = np.ones(len(hashed), bool)
            first[1:] = hashed[1:] != hashed[:-1]
            at = np.flatnonzero(first)
            found.append((hashed[at], np.add.reduceat(new.astype(np.int64), at)))
        parts, packs, totals = [], [], []
        if found:
            value = np.concatenate([f[0] for f in found])
            total = np.concatenate([f[1] for f in found])
            if len(found) > 1:
                value, back = np.unique(value, return_inverse=True)
                total = np.bincount(back, weights=total).astype(np.int64)
            part = (value >> np.uint64(kept)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[p], cuts[p + 1]
                parts.append(p)
                packs.append(_packed(value[a:b]))
                totals.append(total[a:b].astype("<u4").tobytes())
        b = bucket.column("_bucket")[0].as_py()
        give_back()
        return pa.table({"part": pa.array(parts, pa.int32()), "bucket": pa.array([b] * len(parts), pa.int32()), "packed": pa.array(packs, pa.binary()), "texts": pa.array(totals, pa.binary())})

    def add(part: pa.Table) -> pa.Table:
        values = [_unpacked(x) for x in _binary(part, "packed")]
        texts = np.concatenate([np.frombuffer(x, "<u4") for x in _binary(part, "texts")]).astype(np.int64)
        sizes = [len(v) for v in values]
        value = np.concatenate(values)
        del values
        order = np.argsort(value, kind="stable")
        ordered = value[order]
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(texts[order], at)
        total = np.empty(len(value), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(at, len(value))))
        ends = np.cumsum(sizes)
        buckets, packs, totals = [], [], []
        for b, low, high in zip(part.column("bucket").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            shared = total[low:high] > 1
            if shared.any():
                buckets.append(b)
                packs.append(np.packbits(shared).tobytes())
                totals.append(np.minimum(total[low:high][shared], 0xFFFFFFFF).astype("<u4").tobytes())
        p = part.column("part")[0].as_py()
        give_back()
        return pa.table({"_bucket": pa.array(buckets, pa.int32()), "part": pa.array([p] * len(buckets), pa.int32()), "packed": pa.array(packs, pa.binary()), "texts": pa.array(totals, pa.binary())})

    def give(texts: pa.Table, sums: pa.Table) -> pa.Table:
        # the bucket's distinct hashes in the order in which count() sent them
        read = [(low, words, *shingles(words, width)) for low, words in word_runs(texts.column("text"))]
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(hashed >> shift for _, _, hashed, _ in read)]))
        frequency = np.ones(len(known), np.uint32)
        cuts = np.searchsorted(known >> np.uint64(kept), np.arange((1 << bits) + 1, dtype=np.uint64))
        for p, marks, totals in zip(sums.column("part").to_pylist(), _binary(sums, "packed"), _binary(sums, "texts"), strict=True):
            size = int(cuts[p + 1] - cuts[p])
            shared = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8), count=size))
            frequency[cuts[p] + shared] = np.frombuffer(totals, "<u4")
        done = []
        for low, words, hashed, counts in read:
            number = frequency[np.searchsorted(known, hashed >> shift)].astype(np.int64)
            done += fn(Shared(texts.slice(low, len(counts)), words, hashed, counts, number))
        del read, known, frequency
        give_back()
        return pa.Table.from_batches(done)

    columns = "part int, bucket int, packed binary, texts binary"
    counted = dealt.groupBy("_bucket").applyInArrow(count, columns)
    summed = counted.groupBy("part").applyInArrow(add, "_bucket int, part int, packed binary, texts binary")
    return dealt.groupBy("_bucket").cogroup(summed.groupBy("_bucket")).applyInArrow(give, schema)
