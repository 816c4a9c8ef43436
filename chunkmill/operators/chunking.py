"""Chunk occurrences of columns and files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import PIECE_BYTES, digest, lz4_size, measured
from ..functions.gear import OPEN, Profile, boundaries, char_candidates, chunks
from ..sources.byte_blocks import block_candidates, file_table, open_range


def fixed_chunks(df: DataFrame, column: str, *keys: str, size: int = 64) -> DataFrame:
    """keys..., ord, hash (MD5), size (bytes): blocks of `size` characters of a text, cut in one pass over it; an empty or null text has none."""
    parts = F.regexp_extract_all(F.col(column), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    each = df.select(*keys, F.posexplode(parts).alias("ord", "_t")).select(*keys, F.col("ord").cast("long").alias("ord"), F.encode("_t", "UTF-8").alias("_b"))
    return each.select(*keys, "ord", F.md5("_b").alias("hash"), F.octet_length("_b").cast("long").alias("size"))


def char_chunks(df: DataFrame, column: str, *keys: str, limit: int = 1 << 26, min_len: int = 48, max_len: int | None = None) -> DataFrame:
    """keys..., ord, start, n_chars, size (bytes), hash (MD5): content-defined chunks of a text's characters, by the 32-bit gear hash."""
    schema = df.select(*keys).schema.add("ord", "long").add("start", "long").add("n_chars", "long").add("size", "long").add("hash", "string")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                if t is None:
                    continue
                start = 0
                for n, end in enumerate(boundaries(char_candidates(t, limit), len(t), min_len, max_len)):
                    data = t[start:end].encode()
                    rows.append(i)
                    out.append((n, start, end - start, len(data), digest(data, "md5")))
                    start = end
            cols = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
            made = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(m, k) for m, k in zip(made, kinds, strict=True)], [f.name for f in schema])

    return df.select(*keys, column).mapInArrow(work, schema)


def char_candidate_counts(df: DataFrame, column: str, *keys: str, limit: int = 1 << 26) -> DataFrame:
    """keys..., n: candidate boundaries of each text."""
    schema = df.select(*keys).schema.add("n", "long")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(char_candidates(t or "", limit)) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(n, pa.int64())], [f.name for f in schema])

    return df.select(*keys, column).mapInArrow(work, schema)


def column_chunks(df: DataFrame, column: str, *keys: str, profile: Profile = OPEN, store_data: bool = False) -> DataFrame:
    """keys..., ord, start, size, hash, lz4_size (and data): content-defined chunks of a text or binary column's bytes; an empty value has one empty chunk, a null none."""
    schema = df.select(*keys).schema.add("ord", "long").add("start", "long").add("size", "long").add("hash", "string").add("lz4_size", "long")
    if store_data:
        schema = schema.add("data", "binary")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, b in enumerate(batch.column(len(keys)).to_pylist()):
                for n, (start, size) in enumerate(chunks(b, profile) if b is not None else []):
                    data = b[start : start + size]
                    rows.append(i)
                    out.append((n, start, size, digest(data, profile.digest), lz4_size(data)) + ((data,) if store_data else ()))
            cols = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64()] + ([pa.binary()] if store_data else [])
            made = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(cols + [pa.array(m, k) for m, k in zip(made, kinds, strict=True)], [f.name for f in schema])

    return df.select(*keys, F.col(column).cast("binary")).mapInArrow(work, schema)


def file_chunks(spark: SparkSession, paths: Sequence[str], profile: Profile = OPEN, store_data: bool = False, block: int = 4 << 20, piece: int = PIECE_BYTES) -> DataFrame:
    """file_idx, path, ord, start, size, hash, lz4_size (and data) of whole files; file_idx is a path's place in the argument, so a path given twice is two files.

    Blocks of all files are scanned in parallel for candidates, each with the bytes before it; a file's few candidates meet
    for the least-length rule; then chunks are read by their byte ranges, digested and compressed. A file larger than a
    task is no bottleneck. A chunk of more than `piece` bytes, which a profile without a maximum may give where bytes do
    not vary, is read and compressed in pieces of so many; only its data, if stored, is held whole.
    """
    if not paths:
        raise ValueError("no files")
    files = file_table(spark, paths)
    found = block_candidates(spark, paths, profile.mask_bits, block)
    cuts = found.groupBy("file_idx").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    per_file = files.join(cuts.hint("merge"), "file_idx", "left")  # the scan's size is estimated as its range's, so all cuts would be sent to the driver

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, path, length, cuts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                e = np.array(boundaries(np.array(cuts or [], np.int64), length, profile.min_len, profile.max_len), np.int64)
                start = np.concatenate([[0], e[:-1]])
                n = len(e)
                yield pa.RecordBatch.from_arrays([pa.array([idx] * n, pa.int64()), pa.array([path] * n, pa.string()), pa.array(np.arange(n)), pa.array(start), pa.array(e - start)], ["file_idx", "path", "ord", "start", "size"])

    ranges = per_file.select("file_idx", "path", "length", "cuts").mapInArrow(ends, "file_idx long, path string, ord long, start long, size long")
    ddl = "file_idx long, path string, ord long, start long, size long, hash string, lz4_size long" + (", data binary" if store_data else "")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part, made, whole = batch.slice(a, 64), [], []
                for path, start, size in zip(*(part.column(c).to_pylist() for c in ("path", "start", "size")), strict=True):
                    places = range(start, start + max(size, 1), piece)
                    pieces = (open_range(path, at, min(piece, start + size - at)) for at in places)
                    if store_data:
                        pieces = list(pieces)
                        whole.append(b"".join(pieces))
                    made.append(measured(pieces, profile.digest))
                hashes, sizes = zip(*made, strict=True)
                more = [pa.array(hashes, pa.string()), pa.array(sizes, pa.int64())] + ([pa.array(whole, pa.binary())] if store_data else [])
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [x.split()[0] for x in ddl.split(", ")])

    return ranges.repartition(spark.sparkContext.defaultParallelism, "file_idx", "ord").mapInArrow(read, ddl)
