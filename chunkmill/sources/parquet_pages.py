"""Page layout of Parquet files, from the Thrift headers of their pages; no external tool."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import register

#: Page types of the Parquet format.
PAGE_TYPES = {0: "data_page", 1: "index_page", 2: "dictionary_page", 3: "data_page_v2"}
_HEAD = 1 << 16
CHUNKS = "path string, row_group int, column string, first long, end long"
PAGES = "path string, row_group int, column string, page_ord int, page_type string, uncompressed_bytes long, num_values long"


class Compact:
    """As much of Thrift's compact protocol as page headers need: a struct as {field: value}."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.byte()
            n = self.varint() if head >> 4 == 15 else head >> 4
            return [self.byte() == 1 if head & 15 in (1, 2) else self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"unknown Thrift type {kind}")

    def struct(self) -> dict[int, object]:
        out, field = {}, 0
        while head := self.byte():
            field = field + (head >> 4) if head >> 4 else self.zigzag()
            out[field] = self.value(head & 15)
        return out


def column_chunks(path: str) -> Iterator[tuple]:
    """(row_group, column, first, end) of one file's column chunks: where their bytes lie, by its footer."""
    with pq.ParquetFile(path) as f:
        meta = f.metadata
    for g in range(meta.num_row_groups):
        for c in range(meta.row_group(g).num_columns):
            col = meta.row_group(g).column(c)
            at = min(x for x in (col.dictionary_page_offset, col.data_page_offset) if x is not None)
            yield g, col.path_in_schema, at, at + col.total_compressed_size


def pages(path: str, at: int, end: int) -> Iterator[tuple]:
    """(page_ord, page_type, uncompressed_bytes, num_values) of the column chunk between two places of a file."""
    from .byte_blocks import open_range

    n = 0
    while at < end:
        size = _HEAD
        while True:
            head = Compact(open_range(path, at, min(size, end - at)))
            try:
                h = head.struct()
                break
            except IndexError:
                if size >= end - at:
                    raise
                size *= 4
        body = h.get(5) or h.get(7) or h.get(8) or {}
        yield n, PAGE_TYPES.get(h[1], "unknown"), h[2], body.get(1)
        at += head.at + h[3]
        n += 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a schema of ints, longs and strings."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(cols, kinds, strict=True)], list(names))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [options[f"path{i}"] for i in range(int(options["paths"]))]

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        yield _batch([(part.path, *r) for r in column_chunks(part.path)], CHUNKS)


class ParquetColumnChunks(DataSource):
    """format("parquet_column_chunks"): one row a column chunk, from the footers."""

    @classmethod
    def name(cls) -> str:
        return "parquet_column_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def parquet_pages(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row a page of the files; no files give no rows.

    Footers are read by a task for each file; then the column chunks, which are few and short rows, are dealt over tasks
    that walk through their pages, so that a large file is no bottleneck.
    """
    register(spark, ParquetColumnChunks)
    if not paths:
        return spark.createDataFrame([], PAGES)
    chunks = spark.read.format("parquet_column_chunks").options(paths=str(len(paths)), **{f"path{i}": str(p) for i, p in enumerate(paths)}).load()

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, group, column, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch([(path, group, column, *r) for r in pages(path, first, end)], PAGES)

    return chunks.repartition(spark.sparkContext.defaultParallelism, "path", "row_group", "column").mapInArrow(walk, PAGES)


def data_page_sizes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """uncompressed_bytes and num_values of data pages."""
    return parquet_pages(spark, paths).where(F.col("page_type").startswith("data")).select("uncompressed_bytes", "num_values")


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """bin (from 1), low, high, n: at most `bins` equal bins from the least to the greatest value; bins without a value have no row."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 1).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width) + 1, F.lit(bins))).cast("int")
    return df.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "lo", width.alias("w")).agg(F.count("*").alias("n")).select("bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("low"), (F.col("lo") + F.col("bin") * F.col("w")).alias("high"), "n")
