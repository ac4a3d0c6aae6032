"""How rows lie in the files of the store."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_FILE = 5_000_000
LEAST_ROWS_PER_TASK = 50_000
# Time is cut into so many slices at most, which get longer beyond that.
MOST_SLICES = 500
# Above this many files (tasks times days) a batch is brought together before the write.
MAX_BATCH_FILES = 2_000


def read_layout() -> list[Column]:
    """Order of rows in the files of a batch: narrow ranges of day, service and time each."""
    return [F.col("day"), F.col("service"), F.desc("timestamp"), F.desc("id")]


def clustered(rows: DataFrame, order: list[Column], files: int) -> DataFrame:
    """Sorted files of even size; a hot day or service is spread over several."""
    return rows.repartitionByRange(max(files, 1), *order).sortWithinPartitions(*order)


def interleaved(rows: DataFrame, files: int, days: int) -> DataFrame:
    """Files that serve both newest-first searches and those of one service.

    Time is cut at quantiles of the rows into about as many slices a day as files lie in
    each slice, and a slice is laid out by service. A search for the newest logs reads
    the files of one slice, a search of a service one file of each slice.
    """
    slices = max(1, round(math.sqrt(files / max(days, 1))) * days)
    slices = min(slices, MOST_SLICES)
    points = [i / slices for i in range(1, slices)]
    moment = F.unix_micros("timestamp")
    borders = sorted(set(rows.agg(F.percentile_approx(moment, points, 20 * slices)).first()[0] or [])) if points else []
    later = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= moment)) if borders else F.lit(0)
    order = [F.col("day"), F.col("_slice"), *read_layout()[1:]]
    return clustered(rows.withColumn("_slice", later), order, files).drop("_slice")


def compacted_files(rows: int, rows_per_file: int, cores: int) -> int:
    """Files of a compaction: as many as the rows fill, or one per core if each still has a fair share."""
    return max(-(-rows // rows_per_file), min(cores, -(-rows // LEAST_ROWS_PER_TASK)))


def rollup_layout(rollups: DataFrame) -> DataFrame:
    """Rollup rows sorted and brought together by day; adaptive execution sets the file count."""
    keys = ["day", "bucket_start", "service", "level"]
    return rollups.repartitionByRange(*keys).sortWithinPartitions(*keys)


def batch_layout(logs: DataFrame, tasks: int, days: dict[str, int]) -> DataFrame:
    """Logs of a batch as they are written.

    Each task writes a file per day it holds. Live batches touch a day or two
    and stay where they are; a backlog of many days would end in very many
    small files and is shuffled once instead.
    """
    if tasks * len(days) <= MAX_BATCH_FILES:
        return logs
    return clustered(logs, read_layout(), max(-(-sum(days.values()) // ROWS_PER_FILE), tasks // 8))
