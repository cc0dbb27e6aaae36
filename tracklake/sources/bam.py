"""Alignment files as a Python data source: ``spark.read.format("bam")``.

A BAM file is a run of gzip members (BGZF).  Each file is one partition, whose
records are read block by block, so memory holds one block and an open record.
Rows are the stretches of reference bases that a read covers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "contig string, start bigint, end bigint, flag int, mapq int, name string, part int"
#: Bits of the flag field, fixed by the format.
PAIRED, UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x40, 0x80, 0x100, 0x400, 0x800
#: CIGAR operations that cover the reference with bases: M, =, X; and those that skip it: D, N.
COVERS, SKIPS = frozenset((0, 7, 8)), frozenset((2, 3))


def blocks(f, at: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the BGZF blocks that begin in [at, stop)."""
    while stop is None or at < stop:
        f.seek(at)
        head = f.read(18)
        if len(head) < 18:
            return
        size = struct.unpack("<H", head[16:18])[0] + 1
        f.seek(at)
        raw = f.read(size)
        yield at, zlib.decompress(raw[18:-8], wbits=-15)
        at += size


def read_header(data: bytes) -> tuple[list[tuple[str, int]], int] | None:
    """References and the offset of the first record; None if ``data`` is too short."""
    try:
        if data[:4] != b"BAM\x01":
            raise ValueError("not an alignment file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n = struct.unpack_from("<i", data, at)[0]
        at += 4
        found = []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            name = data[at + 4: at + 3 + size]
            if len(name) < size - 1:
                return None
            found.append((name.decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
            at += 8 + size
    except struct.error:
        return None
    return found, at


def header(path: str) -> list[tuple[str, int]]:
    """Reference names and lengths of a file."""
    with open(path, "rb") as f:
        data = b""
        for _, block in blocks(f, 0):
            data += block
            if found := read_header(data):
                return found[0]
    raise ValueError(f"{path} has no complete header")


def aligned_blocks(data: bytes, at: int, names: list[str]) -> list[tuple]:
    """Rows of the reference blocks that one record covers, numbered from 0; one without a place if there is none."""
    ref, pos, name_size, mapq, _, n_ops, flag = struct.unpack_from("<iiBBHHH", data, at)
    name = data[at + 32: at + 31 + name_size].decode(errors="replace")
    spans, low, high = [], pos, pos
    if ref >= 0 and not flag & UNMAPPED:
        for op in struct.unpack_from(f"<{n_ops}I", data, at + 32 + name_size):
            size, kind = op >> 4, op & 15
            if kind in COVERS:
                high += size
            elif kind in SKIPS:
                if high > low:
                    spans.append((low, high))
                low = high = high + size
        if high > low:
            spans.append((low, high))
    if not spans:
        return [(None, None, None, flag, mapq, name, 0)]
    return [(names[ref], low, high, flag, mapq, name, i) for i, (low, high) in enumerate(spans)]


class BamPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]
        if not self.paths:
            raise ValueError("give the path of an alignment file")

    def partitions(self):
        return [BamPartition(p) for p in self.paths]

    def read(self, partition):
        schema = pa.schema([("contig", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("flag", pa.int32()), ("mapq", pa.int32()), ("name", pa.string()), ("part", pa.int32())])

        def batch(rows):
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        with open(partition.path, "rb") as f:
            data, names, rows = b"", None, []
            for _, block in blocks(f, 0):
                data += block
                if names is None:
                    found = read_header(data)
                    if not found:
                        continue
                    names, data = [n for n, _ in found[0]], data[found[1]:]
                at = 0
                while at + 4 <= len(data) and at + 4 + (size := struct.unpack_from("<i", data, at)[0]) <= len(data):
                    rows += aligned_blocks(data, at + 4, names)
                    at += 4 + size
                data = data[at:]
                if len(rows) >= 8192:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class BamSource(DataSource):
    """Reads ``path`` (or several, comma-separated): one partition per file."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").load(path)


def mapped_reads(alignments: DataFrame) -> DataFrame:
    """total_reads: all records that are mapped, secondary and supplementary ones too."""
    return alignments.where((F.col("part") == 0) & (F.col("flag").bitwiseAND(UNMAPPED) == 0)).agg(F.count(F.lit(1)).alias("total_reads"))


def strand_of(library: str):
    """The strand of a read by library type: U as aligned, R and F by mate."""
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    if library == "U":
        return F.when(reverse, "-").otherwise("+")
    if library not in ("R", "F"):
        raise ValueError(f"{library!r} is none of U, R, F")
    paired, second = F.col("flag").bitwiseAND(PAIRED) != 0, F.col("flag").bitwiseAND(SECOND) != 0
    # R: the first mate is antisense, so its reverse is the sense strand
    sense = F.when(paired & second, ~reverse).otherwise(reverse)
    return F.when(sense if library == "R" else ~sense, "+").otherwise("-")


def coverage_blocks(alignments: DataFrame, sample: str, library: str | None = None) -> DataFrame:
    """Blocks for the sweep: strand * of all mapped reads, and + and - of primary ones."""
    mapped = alignments.where("contig is not null")
    total = mapped.select("contig", "start", "end", F.lit(sample).alias("sample"), F.lit("*").alias("strand"))
    if library is None:
        return total
    primary = mapped.where(F.col("flag").bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0)
    return total.union(primary.select("contig", "start", "end", F.lit(sample).alias("sample"), strand_of(library).alias("strand")))
