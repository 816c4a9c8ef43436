"""Files as blocks of bytes: a Python data source, and the candidate scan on it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.gear import OVERLAP, candidates
from ..session import register

BLOCK = 4 << 20
#: Bytes that a partition reads; a block counts as so many more, for what opening its file and a scan cost at least.
PARTITION, OPENING = 4 << 20, 1 << 14


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_range(path: str, start: int, size: int) -> bytes:
    """Bytes of a file."""
    system, name = _at(path)
    with system.open_input_file(name) as f:
        return f.read_at(size, start) if size else b""


def length(path: str) -> int:
    system, name = _at(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def dealt(paths: Sequence[str], block: int = BLOCK) -> list[list[tuple[int, str, int, int]]]:
    """For each partition its blocks as (file_idx, path, start, size): some 4 MB of them, or one that is larger."""
    out, room = [], 0
    for i, p in enumerate(paths):
        n = length(p)
        for a in range(0, max(n, 1), block):
            size = min(block, n - a)
            if room < size + OPENING:
                out.append([])
                room = max(PARTITION, size + OPENING)
            out[-1].append((i, p, a, size))
            room -= size + OPENING
    return out


def _block(path: str, start: int, size: int) -> tuple[bytes, bytes]:
    """The bytes of context before a block, and the block's."""
    lead = min(OVERLAP, start)
    data = open_range(path, start - lead, size + lead)
    return data[:lead], data[lead:]


class _Blocks(InputPartition):
    """Blocks as (file_idx, path, start, size)."""

    def __init__(self, blocks: list[tuple[int, str, int, int]]):
        self.blocks = blocks


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [options[f"path{i}"] for i in range(int(options["paths"]))]
        self.block = int(options.get("block", BLOCK))

    def partitions(self) -> list[_Blocks]:
        return [_Blocks(x) for x in dealt(self.paths, self.block)]

    def read(self, part: _Blocks) -> Iterator[pa.RecordBatch]:
        for file_idx, path, start, size in part.blocks:
            before, data = _block(path, start, size)
            yield pa.RecordBatch.from_arrays([pa.array([file_idx], pa.int64()), pa.array([path]), pa.array([start], pa.int64()), pa.array([before], pa.binary()), pa.array([data], pa.binary())], ["file_idx", "path", "start", "before", "bytes"])


class ByteBlocks(DataSource):
    """format("byte_blocks"): file_idx, path, start, before (bytes of context), bytes; a partition has blocks of some 4 MB, a larger block is one of its own."""

    @classmethod
    def name(cls) -> str:
        return "byte_blocks"

    def schema(self) -> str:
        return "file_idx long, path string, start long, before binary, bytes binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def byte_blocks(spark: SparkSession, paths: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The files' blocks; file_idx is a path's place among paths."""
    register(spark, ByteBlocks)
    return spark.read.format("byte_blocks").options(paths=str(len(paths)), block=str(block), **{f"path{i}": str(p) for i, p in enumerate(paths)}).load()


def file_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file_idx, path, length."""
    return spark.createDataFrame([(i, str(p), length(str(p))) for i, p in enumerate(paths)], "file_idx long, path string, length long")


def block_candidates(spark: SparkSession, paths: Sequence[str], mask_bits: int, block: int = BLOCK) -> DataFrame:
    """file_idx, cut: candidate boundaries as offsets in their file.

    The tasks are the data source's partitions, but read their blocks themselves: planning a Python data source starts
    Python workers beside the driver, in its memory, several for each query that is planned at once.
    """
    blocks = dealt([str(p) for p in paths], block)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for idx, path, start, size in blocks[i]:
                    before, data = _block(path, start, size)
                    cut = candidates(data, before, mask_bits) + start
                    yield pa.RecordBatch.from_arrays([pa.array([idx] * len(cut), pa.int64()), pa.array(cut, pa.int64())], ["file_idx", "cut"])

    return spark.range(0, len(blocks), 1, max(1, len(blocks))).mapInArrow(work, "file_idx long, cut long")
