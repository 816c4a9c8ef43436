"""Deduplication over chunk occurrences: rows with file_idx, ord, hash, size and perhaps lz4_size.

An occurrence is one chunk of one file; repeats count. All results shuffle on the hash alone and combine before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def merge(occurrences: DataFrame, *more: str) -> DataFrame:
    """The distinct chunks: hash, size, first_seen_in (least file), seen_in (ascending files, each once), n (occurrences); more: columns of which the first value is kept."""
    return occurrences.groupBy("hash").agg(
        F.first("size").alias("size"), F.min("file_idx").alias("first_seen_in"), F.array_sort(F.collect_set("file_idx")).alias("seen_in"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in more]
    )


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, null where whole is 0."""
    r = F.try_divide(part.cast("double"), whole.cast("double"))
    return r if digits is None else F.round(r, digits)


def stats(occurrences: DataFrame, *by: str, compressed: bool = False, digits: int | None = 6) -> DataFrame:
    """by..., total_len, chunk_bytes, dedup_ratio (and compressed_chunk_bytes, compressed_dedup_ratio): bytes of all occurrences, and of distinct chunks, two aggregations with one shuffle on the hash."""
    each = [F.first("size").alias("size"), F.sum("size").alias("all")] + ([F.first("lz4_size").alias("lz4")] if compressed else [])
    out = occurrences.groupBy(*by, "hash").agg(*each).groupBy(*by).agg(
        F.coalesce(F.sum("all"), F.lit(0)).cast("long").alias("total_len"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("chunk_bytes"),
        *([F.coalesce(F.sum("lz4"), F.lit(0)).cast("long").alias("compressed_chunk_bytes")] if compressed else []),
    )
    out = out.withColumn("dedup_ratio", ratio(F.col("chunk_bytes"), F.col("total_len"), digits))
    return out.withColumn("compressed_dedup_ratio", ratio(F.col("compressed_chunk_bytes"), F.col("total_len"), digits)) if compressed else out


def segments(occurrences: DataFrame) -> DataFrame:
    """file_idx, ord, first_seen_in: for each occurrence the first file that has its chunk; a join with the distinct chunks, so a chunk with very many occurrences is not gathered. Occurrences are computed once and kept."""
    occurrences = cut(occurrences.select("file_idx", "ord", "hash"))
    first = occurrences.groupBy("hash").agg(F.min("file_idx").alias("first_seen_in"))
    return occurrences.join(first, "hash").select("file_idx", "ord", "first_seen_in")


def listing(occurrences: DataFrame, *more: str) -> DataFrame:
    """file_idx, ord, hash and the chunk's row, for every occurrence. Occurrences are computed once and kept."""
    occurrences = cut(occurrences)
    return occurrences.select("file_idx", "ord", "hash").join(merge(occurrences, *more), "hash")


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """One row a chunk: the first by file, then place."""
    best = occurrences.groupBy("hash").agg(F.min(F.struct("file_idx", "ord", "size")).alias("b"))
    return best.select("hash", "b.*")


def new_bytes(occurrences: DataFrame) -> DataFrame:
    """file_idx, total_len, new_bytes: what each file adds to those before it. Occurrences are computed once and kept."""
    occurrences = cut(occurrences.select("file_idx", "ord", "hash", "size"))
    own = occurrences.groupBy("file_idx").agg(F.sum("size").cast("long").alias("total_len"))
    new = first_occurrences(occurrences).groupBy("file_idx").agg(F.sum("size").cast("long").alias("new_bytes"))
    return own.join(new, "file_idx", "left").select("file_idx", "total_len", F.coalesce("new_bytes", F.lit(0)).alias("new_bytes"))


def missing(occurrences: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct chunks that a table of known hashes does not have: what must be uploaded."""
    return merge(occurrences).join(known.select("hash").distinct(), "hash", "left_anti")


def shared_bytes(occurrences: DataFrame) -> DataFrame:
    """a, b, shared: bytes of distinct chunks that two files have both, for files that share any; a <= b.

    Pairs come from each chunk's set of files, counted once for each different set, so a chunk that all files have costs
    one row a pair of files, not one a pair of occurrences.
    """
    sets = merge(occurrences).groupBy("seen_in").agg(F.sum("size").alias("size"))
    return sets.select(F.posexplode("seen_in").alias("i", "a"), "seen_in", "size").select("a", F.explode(F.expr("slice(seen_in, i + 1, size(seen_in))")).alias("b"), "size").groupBy("a", "b").agg(F.sum("size").cast("long").alias("shared"))


def file_index(df: DataFrame, name: str) -> DataFrame:
    """The rows with file_idx, the rank from 0 of the named column in its order; the distinct names are few beside the rows."""
    names = df.select(name).distinct().select(F.col(name).alias("_f"), (F.dense_rank().over(Window.orderBy(name)) - 1).cast("long").alias("file_idx"))
    return df.join(names, F.col(name).eqNullSafe(F.col("_f"))).drop("_f")


def approximate_stats(occurrences: DataFrame, *by: str) -> DataFrame:
    """by..., total_len, n_chunks, chunk_bytes by a HyperLogLog sketch of hashes: bytes are the distinct count times the mean size. One small row for each task is shuffled instead of hashes; sketches of parts can be merged."""
    rows = occurrences.groupBy(*by).agg(F.sum("size").cast("long").alias("total_len"), F.hll_sketch_estimate(F.hll_sketch_agg("hash")).alias("n_chunks"), F.avg("size").alias("_mean"))
    return rows.withColumn("chunk_bytes", F.least(F.round(F.col("n_chunks") * F.col("_mean")).cast("long"), F.col("total_len"))).drop("_mean")
