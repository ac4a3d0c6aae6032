"""Consecutive numbers and running totals over a whole, distributed table.

Both work the same way: every partition counts for itself, the partition
totals (one row each) are summed up in order, and every row adds the offset of
its partition. Where there are many totals themselves (a table of many files), they
are summed up in the same way. No global window, so no task sees a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import BROADCAST_ROWS, cut_lineage, partitions_for

# Totals that one task sums up; more are dealt in parts of half as many.
WINDOW_ROWS = 100_000

# monotonically_increasing_id() holds the partition above bit 33, the row below.
_ROW_BITS = 33


def offsets(totals: DataFrame, order: list[str], value: str, offset: str, size: int) -> DataFrame:
    """Sum of ``value`` over the rows before each row.

    ``totals`` is metadata, ``size`` rows, one per partition or file split. Up to
    ``WINDOW_ROWS`` of them go through one task, more are summed in parts.
    """
    if size > WINDOW_ROWS:
        parts = -(-size // max(1, WINDOW_ROWS // 2))
        # Under other names, as those of a running total may be in the table.
        own = {name: f"of{name}" for name in totals.columns}
        summed = running_total(totals.withColumnsRenamed(own), [own[c] for c in order], own[value], "until", parts)
        summed = summed.withColumnsRenamed({new: old for old, new in own.items()})
        return summed.withColumn(offset, (F.col("until") - F.col(value)).cast("long")).drop("until")
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(
        offset, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long")
    )


def join_metadata(rows: DataFrame, small: DataFrame, on: list[str], size: int) -> DataFrame:
    """Join per-partition metadata to rows; broadcast only if its row count allows."""
    return rows.join(F.broadcast(small) if size <= BROADCAST_ROWS else small, on)


def number_rows(
    df: DataFrame,
    order: list[str | Column],
    name: str = "id",
    start: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    return counted_rows(df, order, name, start, partitions)[0]


def counted_rows(
    df: DataFrame,
    order: list[str | Column],
    name: str = "id",
    start: int = 1,
    partitions: int | None = None,
) -> tuple[DataFrame, int]:
    """The rows numbered, and how many there are.

    Numbers the rows ``start, start + 1, ...`` along ``order``, a unique key.

    Range partitioning samples the key, and two runs of one plan may draw other
    borders; the sorted rows are therefore stored once, and both the totals and
    the numbers come from the stored rows.
    """
    count = partitions or partitions_for(df)
    placed = (
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    total = totals.agg(F.sum("_rows")).first()[0] or 0
    shifts = offsets(totals, ["_part"], "_rows", "_shift", count).select("_part", "_shift")
    row = F.col("_at") - F.shiftleft("_part", _ROW_BITS)
    numbered = (
        join_metadata(placed, shifts, ["_part"], count)
        .withColumn(name, F.col("_shift") + row + F.lit(start).cast("long"))
        .drop("_at", "_part", "_shift")
    )
    return numbered, total


def running_total(
    df: DataFrame,
    order: list[str | Column],
    value: str,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over all rows up to and including each row along ``order``."""
    count = partitions or partitions_for(df)
    placed = df.repartitionByRange(count, *order).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(placed)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    shifts = offsets(totals, ["_part"], "_sum", "_shift", count).select("_part", "_shift")
    inside = (
        Window.partitionBy("_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        join_metadata(placed, shifts, ["_part"], count)
        .withColumn(name, F.col("_shift") + F.sum(value).over(inside))
        .drop("_part", "_shift")
    )


def assign_ids(
    df: DataFrame, order: list[str | Column], start: int = 1, partitions: int | None = None
) -> DataFrame:
    """Unique ids that follow ``order``; the same input and start give the same ids."""
    return number_rows(df, order, "id", start, partitions)


def number_split_rows(rows: DataFrame, split: list[str], at: str) -> tuple[DataFrame, int]:
    """Number rows that still lie in the file splits they were read from.

    ``at`` is ``monotonically_increasing_id()`` taken over exactly these rows,
    so inside a split it counts up by one; ``split`` names the split in reading
    order. No row is moved, and how splits are packed into tasks does not matter.
    Returns the rows with ``number`` = 0, 1, ... and how many there are.
    """
    totals = rows.groupBy(*split).agg(
        F.min(at).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    size, total = totals.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    shifts = offsets(totals, split, "_rows", "_shift", size).drop("_rows")
    numbered = (
        join_metadata(rows, shifts, split, size)
        .withColumn("number", F.col("_shift") + F.col(at) - F.col("_first"))
        .drop("_first", "_shift")
    )
    return numbered, total or 0


def split_offsets(
    rows: DataFrame, split: list[str], at: str, count: str
) -> tuple[DataFrame, int, int, int]:
    """Per file split, where its rows and the items in them begin; from one pass over ``rows``.

    ``at`` is ``monotonically_increasing_id()`` over the rows, ``count`` how many items
    each holds. Gives per split ``first_row`` (its least ``at``), ``first_item`` (the
    same for the items, were they numbered so after an explode) and ``shift`` (items in
    splits before it), and the number of splits, of items and of tasks.
    """
    totals = rows.groupBy(*split).agg(F.min(at).alias("first_row"), F.sum(count).alias("_items"))
    totals = totals.withColumn("_task", F.shiftright("first_row", _ROW_BITS))
    size, total, tasks = totals.agg(F.count(F.lit(1)), F.sum("_items"), F.max("_task") + 1).first()
    earlier = Window.partitionBy("_task").orderBy("first_row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_items").over(earlier), F.lit(0))
    totals = totals.withColumn("first_item", F.shiftleft("_task", _ROW_BITS) + before)
    shifts = offsets(totals, split, "_items", "shift", size)
    return shifts.select(*split, "first_row", "first_item", "shift"), size, total or 0, tasks or 0
