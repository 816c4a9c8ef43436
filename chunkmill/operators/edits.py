"""Edits of tables with explicit positions (_pos from 0): delete, insert, append, update, slices and shards.

Fresh rows come from a function of how many are wanted, giving rows with _pos from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import renumbered
from .synthetic import Generator

Fresh = Callable[[int], DataFrame]


def spread_points(n: int) -> list[float]:
    """n edit points in the middles of n equal parts."""
    return [float(x) for x in np.linspace(0.5 / n, 1 - 0.5 / n, n)]


def places(points: Sequence[float], rows: int) -> list[int]:
    """Row indexes of edit points."""
    return [int(p * rows) for p in points]


def _shifted(table: DataFrame, moves: list[tuple[int, int]]) -> DataFrame:
    """Rows at or after each place moved by so many."""
    by = F.lit(0)
    for at, n in moves:
        by = by + F.when(F.col("_pos") >= at, n).otherwise(0)
    return table.withColumn("_pos", (F.col("_pos") + by).cast("long"))


def delete_rows(table: DataFrame, points: Sequence[float], edit_size: int = 10, rows: int | None = None) -> DataFrame:
    """Without the edit_size rows just before each edit point; a segment shorter than that goes whole."""
    rows = table.count() if rows is None else rows
    at = places(points, rows)
    gone = [(max(a, b - edit_size), b) for a, b in zip([0, *at[:-1]], at, strict=True)] if at else []
    keep = table
    for a, b in gone:
        keep = keep.where(~F.col("_pos").between(a, b - 1))
    return _shifted(keep, [(b, a - b) for a, b in gone if b > a])


def insert_rows(table: DataFrame, points: Sequence[float], fresh: Fresh, edit_size: int = 10, rows: int | None = None) -> DataFrame:
    """With edit_size fresh rows at each edit point, a batch for each."""
    rows = table.count() if rows is None else rows
    at = places(points, rows)
    out = _shifted(table, [(a, edit_size) for a in at])
    for i, a in enumerate(at):
        out = out.unionByName(fresh(edit_size).withColumn("_pos", F.col("_pos") + (a + i * edit_size)))
    return out


def append_rows(table: DataFrame, ratio: float, fresh: Fresh, rows: int | None = None) -> DataFrame:
    """With int(ratio * rows) fresh rows at the end."""
    rows = table.count() if rows is None else rows
    n = int(ratio * rows)
    return table.unionByName(fresh(n).withColumn("_pos", F.col("_pos") + rows)) if n else table


def update_rows(table: DataFrame, points: Sequence[float], fresh: Fresh, edit_size: int = 10, rows: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """With one row replaced at each edit point: the last of its edit_size fresh ones, drawn in one batch. columns: replace these alone."""
    rows = table.count() if rows is None else rows
    at = places(points, rows)
    names = [c for c in table.columns if c != "_pos"]
    batch = fresh(len(at) * edit_size)
    target = F.lit(None).cast("long")
    for i, a in enumerate(at):
        target = F.when(F.col("_pos") == (i + 1) * edit_size - 1, a).otherwise(target)
    edit = batch.withColumn("_at", target).where("_at is not null").select("_at", F.struct(*names).alias("_new"))
    new = {c: F.when(F.col("_at").isNull(), F.col(c)).otherwise(F.col("_new")[c]) for c in (columns or names)}
    return table.join(F.broadcast(edit), F.col("_pos") == F.col("_at"), "left").select("_pos", *[new.get(c, F.col(c)).alias(c) for c in names])


def variants(gen: Generator, rows: int, points: Sequence[float] = (0.5,), append_ratio: float = 0.05, update_columns: Sequence[str] = (), edit_size: int = 10) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A generated table and its edits: deleted, inserted, appended, updated, and updated_<column> for each column asked for, which share one second draw."""
    points = list(points)
    table = gen.table(rows)
    out = {
        "deleted": delete_rows(table, points, edit_size, rows),
        "inserted": insert_rows(table, points, gen.table, edit_size, rows),
        "appended": append_rows(table, append_ratio, gen.table, rows),
        "updated": update_rows(table, points, gen.table, edit_size, rows),
    }
    if update_columns:
        batch = gen.table(len(points) * edit_size)
        for c in update_columns:
            out[f"updated_{c}"] = update_rows(table, points, lambda n: batch, edit_size, rows, [c])
    return table, out


def slice_rows(table: DataFrame, start: int, length: int) -> DataFrame:
    """Rows start .. start + length - 1, numbered anew."""
    return table.where(F.col("_pos").between(start, start + length - 1)).withColumn("_pos", F.col("_pos") - start)


def shard(table: DataFrame, shards: int, rows: int | None = None) -> DataFrame:
    """With the column shard: contiguous, near-equal parts."""
    rows = table.count() if rows is None else rows
    return table.withColumn("shard", F.floor(F.col("_pos") * shards / max(rows, 1)).cast("long"))


def shuffled(table: DataFrame, seed: int = 40) -> DataFrame:
    """Rows in an order drawn by MD5 of seed and position, numbered anew."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_pos").cast("string")).cast("binary"))
    return renumbered(table.withColumn("_order", key), "_order")


def filter_nested(table: DataFrame, column: str, below: int) -> DataFrame:
    """Rows whose list has fewer than so many elements."""
    return table.where(F.size(column) < below)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have equal schemas (names and types) and equal rows, repeats counted."""
    if [(f.name, f.dataType.simpleString()) for f in a.schema] != [(f.name, f.dataType.simpleString()) for f in b.schema]:
        return False
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
