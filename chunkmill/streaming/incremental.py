"""Incremental deduplication: which chunks of arriving rows are new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import fixed_chunks


def new_chunks(stream: DataFrame, column: str, *keys: str, size: int = 64, delay: str | None = None, time: str | None = None) -> DataFrame:
    """A stream of the chunks that come for the first time; with a time column and delay, state older than that goes."""
    if time and delay:
        stream = stream.withWatermark(time, delay)
        return fixed_chunks(stream, column, *keys, time, size=size).dropDuplicatesWithinWatermark(["hash"])
    return fixed_chunks(stream, column, *keys, size=size).dropDuplicates(["hash"])


def new_bytes(stream: DataFrame, column: str, *keys: str, size: int = 64) -> DataFrame:
    """keys..., new_bytes, new_chunks so far; a complete-mode aggregate."""
    out = new_chunks(stream, column, *keys, size=size)
    return out.groupBy(*keys).agg(F.sum("size").alias("new_bytes"), F.count("*").alias("new_chunks"))
