"""A table against its edits, over compressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .experiment import compare_formats_tables
from .formats import ParquetFormat
from .report import table_text


def visualize(spark: SparkSession, original: DataFrame, tables: Mapping[str, DataFrame], directory: str | Path = ".", with_cdc: bool = False, compressions: Sequence[str] = ("none", "snappy"), **options) -> tuple[DataFrame, str]:
    """Results and their text table for each compression, without and, if asked for, with content-defined pages."""
    formats = [ParquetFormat(c, use_cdc=cdc, **options) for cdc in ((False, True) if with_cdc else (False,)) for c in compressions]
    results = compare_formats_tables(spark, formats, {name: {"original": original, name: t} for name, t in tables.items()}, directory)
    return results, table_text(results)
