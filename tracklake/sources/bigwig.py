"""bigWig files as a Python data source: ``spark.read.format("bigwig")``.

Every partition is a run of data blocks that the file's R-tree lists; rows are
(contig, start, end, value) segments.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Numbers that mark the parts of a file, fixed by the format.
FILE_MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BLOCKS_PER_PARTITION = 512


def _unpack(f, fmt: str, at: int | None = None) -> tuple:
    if at is not None:
        f.seek(at)
    return struct.unpack("<" + fmt, f.read(struct.calcsize("<" + fmt)))


def contigs(f) -> dict[int, tuple[str, int]]:
    """Names and lengths by number, from the file's B+ tree."""
    magic, _, _, tree = _unpack(f, "IHHQ", 0)
    if magic != FILE_MAGIC:
        raise ValueError("not a little-endian bigWig file")
    mark, _, key, _, _, _ = _unpack(f, "IIIIQQ", tree)
    if mark != TREE_MAGIC:
        raise ValueError("the contig tree is damaged")
    found, todo = {}, [tree + 32]
    while todo:
        leaf, _, n = _unpack(f, "BBH", todo.pop())
        for _ in range(n):
            name = f.read(key)
            if leaf:
                number, length = _unpack(f, "II")
                found[number] = (name.rstrip(b"\0").decode(), length)
            else:
                todo.append(_unpack(f, "Q")[0])
    return found


def data_blocks(f) -> list[tuple[int, int]]:
    """(offset, size) of all data blocks, from the R-tree."""
    (index,) = _unpack(f, "Q", 24)
    if _unpack(f, "I", index)[0] != INDEX_MAGIC:
        raise ValueError("the index is damaged")
    found, todo = [], [index + 48]
    while todo:
        leaf, _, n = _unpack(f, "BBH", todo.pop())
        for _ in range(n):
            f.read(16)
            if leaf:
                found.append(_unpack(f, "QQ"))
            else:
                todo.append(_unpack(f, "Q")[0])
    return sorted(found)


def segments(raw: bytes) -> list[tuple[int, int, int, float]]:
    """(contig number, start, end, value) of one inflated block."""
    number, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", raw)
    if kind == 1:
        return [(number, s, e, v) for s, e, v in struct.iter_unpack("<IIf", raw[24: 24 + 12 * n])]
    if kind == 2:
        return [(number, s, s + span, v) for s, v in struct.iter_unpack("<If", raw[24: 24 + 8 * n])]
    if kind == 3:
        return [(number, start + i * step, start + i * step + span, v) for i, (v,) in enumerate(struct.iter_unpack("<f", raw[24: 24 + 4 * n]))]
    raise ValueError(f"unknown kind of block {kind}")


class BigWigPartition(InputPartition):
    def __init__(self, path: str, listed: list[tuple[int, int]]):
        super().__init__(path)
        self.path, self.listed = path, listed


class BigWigReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("give the path of a bigWig file")

    def partitions(self):
        with open(self.path, "rb") as f:
            listed = data_blocks(f)
        return [BigWigPartition(self.path, listed[i: i + BLOCKS_PER_PARTITION]) for i in range(0, len(listed), BLOCKS_PER_PARTITION)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            names = contigs(f)
            (packed,) = _unpack(f, "I", 52)
            for at, size in partition.listed:
                f.seek(at)
                raw = f.read(size)
                for number, start, end, value in segments(zlib.decompress(raw) if packed else raw):
                    yield names[number][0], start, end, float(value)


class BigWigSource(DataSource):
    @classmethod
    def name(cls):
        return "bigwig"

    def schema(self):
        return "contig string, start bigint, end bigint, value double"

    def reader(self, schema):
        return BigWigReader(self.options)


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BigWigSource)
    return spark.read.format("bigwig").load(path)
