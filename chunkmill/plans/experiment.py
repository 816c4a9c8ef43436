"""Estimates of files, and experiments over formats and variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gear import BOUNDED, OPEN
from ..operators import dedup
from ..operators.chunking import file_chunks
from ..session import cut
from .formats import FileFormat

RESULT = "group string, format string, params string, numfiles int, total_len long, chunk_bytes long, compressed_chunk_bytes long, dedup_ratio double, compressed_dedup_ratio double, bounded_bytes long, bounded_dedup_ratio double"


@dataclass(frozen=True)
class Estimate:
    """What files need after chunk-level deduplication; ratios are None where there are no bytes. bounded_bytes: by the second, bounded profile."""

    numfiles: int
    total_len: int
    chunk_bytes: int
    compressed_chunk_bytes: int
    dedup_ratio: float | None
    compressed_dedup_ratio: float | None
    bounded_bytes: int
    bounded_dedup_ratio: float | None


def chunks(spark: SparkSession, paths: Sequence[str | Path], store_data: bool = False) -> DataFrame:
    """Every chunk occurrence of the files in order (file_idx, ord), with its chunk's size, lz4_size, first_seen_in, seen_in and perhaps data."""
    occ = file_chunks(spark, [str(p) for p in paths], OPEN, store_data)
    return dedup.listing(occ, "lz4_size", *(["data"] if store_data else [])).orderBy("file_idx", "ord")


def estimate(spark: SparkSession, paths: Sequence[str | Path], images: bool = False) -> Estimate:
    """Estimate files together; images: also draw a heat map beside each file and merged.png beside the last."""
    paths = [str(p) for p in paths]
    occ = file_chunks(spark, paths, OPEN)
    if images:
        occ = cut(occ)
        from .render import draw_files

        draw_files(occ, paths)
    s = dedup.stats(occ, compressed=True, digits=None).first()
    x = dedup.stats(file_chunks(spark, paths, BOUNDED), digits=None).first()
    return Estimate(len(paths), s["total_len"], s["chunk_bytes"], s["compressed_chunk_bytes"], s["dedup_ratio"], s["compressed_dedup_ratio"], x["chunk_bytes"], x["dedup_ratio"])


def _row(group: str, fmt: FileFormat, e: Estimate) -> tuple:
    return group, fmt.name, fmt.paramstem, e.numfiles, e.total_len, e.chunk_bytes, e.compressed_chunk_bytes, e.dedup_ratio, e.compressed_dedup_ratio, e.bounded_bytes, e.bounded_dedup_ratio


def compare_formats_tables(spark: SparkSession, formats: Sequence[FileFormat], tables: Mapping[str, Mapping[str, DataFrame | str | Path]], directory: str | Path, workers: int = 4, sanity_check: bool = True) -> DataFrame:
    """One result row for each group and format over the files that the group's tables make in it.

    A group's files go to directory/group/format name/. A table that several groups share (an original beside each of its
    edits) is written once for each format and linked. Writes and estimates of different formats run as concurrent jobs.
    """
    directory = Path(directory)
    with ThreadPoolExecutor(workers) as pool:
        written: dict[tuple, object] = {}
        futures = {}
        for group, members in tables.items():
            for fmt in formats:
                for name, src in members.items():
                    key = fmt, name, id(src)
                    place = directory / group / fmt.name
                    if key not in written:
                        written[key] = pool.submit(fmt.write, name, src, place, sanity_check)
                    futures.setdefault((group, fmt), []).append((written[key], place))

        def linked(done, place: Path) -> Path:
            path, place = done.result(), place / done.result().name
            if path != place:
                place.parent.mkdir(parents=True, exist_ok=True)
                place.unlink(missing_ok=True)
                place.hardlink_to(path)
            return place

        paths = {k: [linked(f, place) for f, place in v] for k, v in futures.items()}
        estimates = list(pool.map(lambda p: estimate(spark, p), paths.values()))
    return spark.createDataFrame([_row(group, fmt, e) for (group, fmt), e in zip(paths, estimates, strict=True)], RESULT)


def compare_formats(spark: SparkSession, baseline: FileFormat, contenders: Mapping[str, FileFormat], table: DataFrame, directory: str | Path, workers: int = 4) -> DataFrame:
    """One result row for each contender, over the table in the baseline format and in the contender's; group param-impact."""
    with ThreadPoolExecutor(workers) as pool:
        first = pool.submit(baseline.write, "baseline", table, directory)
        others = {name: pool.submit(fmt.write, name, table, directory) for name, fmt in contenders.items()}
        estimates = list(pool.map(lambda f: estimate(spark, [first.result(), f.result()]), others.values()))
    return spark.createDataFrame([_row("param-impact", fmt, e) for fmt, e in zip(contenders.values(), estimates, strict=True)], RESULT)


def best_of(results: DataFrame) -> DataFrame:
    """The results with best: whether a row's ratio, to two places, is its group's least."""
    from pyspark.sql import Window

    r = F.round("dedup_ratio", 2)
    return results.withColumn("best", r == F.min(r).over(Window.partitionBy("group")))
