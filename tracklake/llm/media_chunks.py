"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash of its last 16 bytes has its
masked bits at zero.  Cuts move with the content, so equal stretches of
different payloads make equal chunks.  Chunks are kept once per digest,
deflated; a payload is an ordered list of digests (its recipe).  Recipes are
written out; payloads are built again by joining them with the chunk store and
checking every digest.  A payload's stored form is a head, its recipe, and the
deflated chunks as they were read from the store, in order.

Results for odd input: a null text counts as empty; an empty text is one
chunk of 64 zero bytes; a null ``doc_id`` stays null; repeated rows give
repeated results; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, mix64, utf8

PAD = 64
WINDOW = 16
MAGIC = b"GCDC"


def _gear() -> np.ndarray:
    return (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(48)).astype(np.uint16)


_GEAR = _gear()


def cut_points(payload: np.ndarray, least: int, bits: int, most: int) -> list[int]:
    """Ends of the chunks of one payload, the last one its length.

    The hash after byte i is the sum of gear[byte i-k] << k for k in 0..15, in
    16 bits; it is built in four doubling steps.  A cut follows byte i if the
    top ``bits`` bits are zero, at ``least`` bytes from the cut before, and
    after ``most`` bytes in any case.
    """
    n = len(payload)
    if n <= least:
        return [n]
    h = _GEAR[payload]
    step = 1
    while step < WINDOW:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step)
        h = h + shifted
        step *= 2
    marks = (np.flatnonzero((h >> np.uint16(16 - bits)) == 0) + 1).tolist()
    ends, last = [], 0
    for mark in marks:
        while mark - last > most:
            last += most
            ends.append(last)
        if mark - last >= least and mark < n:
            ends.append(mark)
            last = mark
    while n - last > most:
        last += most
        ends.append(last)
    ends.append(n)
    return ends


def pad(text: bytes) -> bytes:
    size = max(PAD, -(-len(text) // PAD) * PAD)
    return text + bytes(size - len(text))


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("recipe_id", pa.binary()), ("recipe", pa.binary())])
_PIECE = pa.schema([("digest", pa.binary()), ("stored", pa.binary())])


def _cutter(least: int, bits: int, most: int, pieces: bool):
    """A mapper over (doc_id, text): recipes of payloads, or their chunks."""

    def payloads(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[tuple[bytes, bytes]]]]:
        data, offsets = utf8(batch.column("text"))
        for i in range(batch.num_rows):
            text = data[offsets[i]: offsets[i + 1]].tobytes()
            payload = pad(text)
            begin, chunks = 0, []
            for end in cut_points(np.frombuffer(payload, np.uint8), least, bits, most):
                chunk = payload[begin:end]
                chunks.append((hashlib.sha256(chunk).digest(), chunk))
                begin = end
            yield i, text, chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                if pieces:
                    seen = {}
                    for _, _, chunks in payloads(batch):
                        for digest, chunk in chunks:
                            if digest not in seen:
                                seen[digest] = zlib.compress(chunk, 6)
                    yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], schema=_PIECE)
                    continue
                sizes, ids, recipes = [], [], []
                for _, text, chunks in payloads(batch):
                    recipe = b"".join(digest + struct.pack("<I", len(chunk)) for digest, chunk in chunks)
                    sizes.append(len(text))
                    recipes.append(recipe)
                    ids.append(hashlib.sha256(recipe).digest())
                yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(recipes, pa.binary())], schema=_CUT)

    return run


def cut(docs: DataFrame, least: int = 2048, bits: int = 12, most: int = 65536) -> tuple[DataFrame, DataFrame]:
    """(recipes, chunk store) of a table with ``doc_id`` and ``text``.

    recipes: doc_id, n_bytes (unpadded), recipe_id, recipe (36 bytes a chunk:
    digest and length).  store: digest, stored (the chunk, deflated), one row
    for each distinct digest; map tasks drop repeats before the shuffle.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = map_batches(source, _cutter(least, bits, most, False), "doc_id long, n_bytes long, recipe_id binary, recipe binary")
    chunks = map_batches(source.select("doc_id", "text"), _cutter(least, bits, most, True), "digest binary, stored binary")
    return materialise(recipes, "recipes"), chunks.groupBy("digest").agg(F.first("stored").alias("stored"))


class _Reader:
    """Checks and measures one payload while its chunks pass by."""

    def __init__(self) -> None:
        self.sha, self.media, self.tail = hashlib.sha256(), hashlib.sha256(), b""
        self.n = self.chunks = self.stored = 0
        self.histogram = np.zeros(256, np.int64)
        self.digests: set[bytes] = set()

    def header(self, recipe: bytes) -> None:
        """The stored form is: magic, number of chunks, recipe, stored chunks."""
        head = MAGIC + struct.pack("<I", len(recipe) // 36) + recipe
        self.expected, self.stored = len(recipe) // 36, len(head)
        self.media.update(head)

    def add(self, seq: int, digest: bytes, stored: bytes) -> None:
        chunk = zlib.decompress(stored)
        if not self.stored or seq != self.chunks or hashlib.sha256(chunk).digest() != digest:
            raise ValueError("a chunk is missing, repeated or damaged")
        self.sha.update(chunk)
        self.media.update(stored)
        self.stored += len(stored)
        self.tail = (self.tail + chunk)[-PAD:]
        self.n += len(chunk)
        self.chunks += 1
        self.histogram += np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)
        self.digests.add(digest)

    def row(self) -> tuple:
        if self.chunks != self.expected:
            raise ValueError("a payload lacks chunks")
        p = self.histogram[self.histogram > 0] / self.n
        mean = float(self.histogram @ np.arange(256)) / self.n
        entropy = abs(float((p * np.log2(p)).sum()))
        feature = f"chunks={self.chunks};distinct={len(self.digests)};mean={mean:.4f};entropy={entropy:.4f}"
        return self.n, self.sha.hexdigest(), zlib.crc32(self.tail), self.stored, self.media.hexdigest(), feature


_MEASURED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEASURED_ARROW = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_STEP = f"recipe_id binary, seq int, digest binary, recipe binary, stored binary, {_MEASURED}"
_STEP_ARROW = pa.schema([("recipe_id", pa.binary()), ("seq", pa.int32()), ("digest", pa.binary()), ("recipe", pa.binary()), ("stored", pa.binary()), *_MEASURED_ARROW])
_FEATURES = f"recipe_id binary, {_MEASURED}"
_FEATURES_ARROW = pa.schema([("recipe_id", pa.binary()), *_MEASURED_ARROW])


def _measured(chunks: Iterator[tuple[int, bytes, bytes | None, bytes | None]]) -> tuple:
    """Features of one payload from its (seq, digest, recipe, stored) in order."""
    reader = _Reader()
    for seq, digest, recipe, stored in chunks:
        if seq == 0:
            reader.header(recipe)
        if stored is None:
            raise ValueError("a recipe names a chunk that the store lacks")
        reader.add(seq, digest, stored)
    return reader.row()


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _steps(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            yield from zip(*(batch.slice(low, 256).column(c).to_pylist() for c in names), strict=True)


def _grouped(rows: Iterator[tuple], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    found = []
    for row in rows:
        found.append(row)
        if len(found) >= size:
            yield _rows(found, schema)
            found = []
    yield _rows(found, schema)


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measures the payloads that are whole beside their first chunk, whose bytes need not move any more."""

    def rows() -> Iterator[tuple]:
        for recipe_id, seq, digest, recipe, stored in _steps(batches, _STEP_ARROW.names[:5]):
            if seq == 0 and len(recipe) == 36:
                yield recipe_id, seq, None, None, None, *_measured(iter([(seq, digest, recipe, stored)]))
            else:
                yield recipe_id, seq, digest, recipe, stored, *[None] * len(_MEASURED_ARROW)

    return _grouped(rows(), 256, _STEP_ARROW)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (recipe_id, seq); one payload's state is held."""

    def rows() -> Iterator[tuple]:
        for recipe_id, steps in itertools.groupby(_steps(batches, _STEP_ARROW.names), key=lambda r: r[0]):
            first = next(steps)
            yield recipe_id, *(first[5:] if first[5] is not None else _measured(r[1:5] for r in itertools.chain([first], steps)))

    return _grouped(rows(), 1024, _FEATURES_ARROW)


def read_back(recipes: DataFrame, store: DataFrame) -> DataFrame:
    """Features of every distinct recipe's payload, rebuilt from the store.

    Equal payloads have equal recipes and are rebuilt once.  A recipe that
    lacks a chunk, or a chunk that doesn't match its digest, is an error.
    """
    distinct = recipes.groupBy("recipe_id").agg(F.first("recipe").alias("recipe"))
    steps = distinct.select(
        "recipe_id", "recipe",
        F.explode(F.sequence(F.lit(0), (F.length("recipe") / 36).cast("int") - 1)).alias("seq"),
    ).select(
        "recipe_id", "seq",
        F.expr("substring(recipe, seq * 36 + 1, 32)").alias("digest"),
        F.expr("if(seq = 0, recipe, null)").alias("recipe"),
    )
    joined = steps.join(store, "digest", "left").select("recipe_id", "seq", "digest", "recipe", "stored")
    placed = map_batches(joined, _begin, _STEP).repartition("recipe_id").sortWithinPartitions("recipe_id", "seq")
    return map_batches(placed, _finish, _FEATURES)


def media_features(docs: DataFrame, **cuts: int) -> DataFrame:
    """One row per row of ``docs``: sizes, checksums and features as read back."""
    recipes, store = cut(docs, **cuts)
    features = read_back(recipes, store)
    return recipes.select("doc_id", "n_bytes", "recipe_id").join(features, "recipe_id").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
