"""Explicit row positions and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Positions that one window of a running sum covers.
BLOCK = 1 << 16
#: Blocks whose sums one window of a running sum covers.
TOP = 1 << 12


def with_positions(df: DataFrame, *order: str, name: str = "_pos") -> DataFrame:
    """Number the rows from 0 in this order.

    Rows are range-partitioned and sorted once and kept; each partition's beginning is the number of rows before it, of
    which there is one for each partition. Ties of the order are numbered in the order they come.
    """
    rows = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return rows.join(F.broadcast(before), part == F.col("_part")).withColumn(name, F.col("_before") + place).drop("_id", "_part", "_before")


def running_sum(df: DataFrame, value: Column, name: str, pos: str = "_pos", exclusive: bool = False, block: int = BLOCK, by: tuple[str, ...] = (), top: int = TOP) -> DataFrame:
    """Sum of value over the rows up to each position (before it, if exclusive), of each value of `by` on its own.

    Sums inside blocks of positions, of the blocks before inside `top` blocks, and of the tops before: no window is longer
    than that, but the last, which has a row for each block * top rows.
    """
    rows = df.withColumn("_block", F.floor(F.col(pos) / block)).withColumn("_v", value)
    sums = rows.groupBy(*by, "_block").agg(F.sum("_v").alias("_s")).withColumn("_top", F.floor(F.col("_block") / top))
    tops = sums.groupBy(*by, "_top").agg(F.sum("_s").alias("_t"))
    upto = lambda v, *part, order: F.sum(v).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(v)
    renamed = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    same = lambda t, k: [t[c].eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [t[k] == F.col("_k")]
    tops = tops.select(*renamed, F.col("_top").alias("_k"), upto("_t", *by, order="_top").alias("_far"))
    near = sums.withColumn("_near", upto("_s", *by, "_top", order="_block"))
    before = near.join(tops, same(near, "_top")).select(*renamed, F.col("_block").alias("_kb"), (F.col("_near") + F.col("_far")).alias("_before")).withColumnRenamed("_kb", "_k")
    inside = F.sum("_v").over(Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_inside", inside - F.col("_v") if exclusive else inside)
    summed = rows.join(before, same(rows, "_block"))
    return summed.withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


def renumbered(df: DataFrame, *order: str, pos: str = "_pos") -> DataFrame:
    """Positions anew from 0, in this order."""
    return with_positions(df, *order, name="_new").drop(pos, *[c for c in order if c != pos]).withColumnRenamed("_new", pos)
