"""Time-bucket counts, from raw logs or from the minute rollup."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timeutil import bucket, ceil_minute, day_of, floor_minute
from tidelog.operators.filters import Scan, apply_filters, equals, matching, scan_of, time_range
from tidelog.plans.params import AggregateQuery
from tidelog.schema import GROUPS

ROLLUP_KEYS = ("bucket_start", "service", "level")


class RangeSplit(NamedTuple):
    """A time range cut into whole minutes and what is left at its two ends."""

    interior: tuple[datetime, datetime] | None
    edges: list[tuple[datetime, datetime]]


def can_use_rollup(query: AggregateQuery) -> bool:
    """The rollup keeps neither message nor attributes."""
    return query.q is None and not query.attributes


def split_range(since: datetime, until: datetime) -> RangeSplit:
    start, end = ceil_minute(since), floor_minute(until)
    if start >= end:
        return RangeSplit(None, [(since, until)])
    edges = [(since, start), (end, until)]
    return RangeSplit((start, end), [(a, b) for a, b in edges if a < b])


def aggregate_raw(logs: DataFrame | Scan, query: AggregateQuery) -> DataFrame:
    """Counts per bucket (and group) straight from the logs."""
    rows = matching(scan_of(logs)(query.since, query.until), query)
    return _bucketed(rows, "timestamp", query, F.count(F.lit(1)))


def aggregate_rollup(
    rollups: DataFrame | Scan, logs: DataFrame | Scan, query: AggregateQuery
) -> DataFrame:
    """Counts per bucket from whole minutes of the rollup and raw rows at the edges.

    Unmerged deltas may hold one key several times: summing covers both that
    and the step from minutes to buckets. Each edge is under a minute long and
    is read with its own range, so it touches one day.
    """
    if not can_use_rollup(query):
        raise ValueError("the rollup cannot answer a query with q or attributes")
    interior, edges = split_range(query.since, query.until)
    named = equals(query.service, query.level)
    parts = []
    if interior is not None:
        minutes = scan_of(rollups)(*interior)
        whole = time_range(minutes, *interior, column="bucket_start")
        parts.append(
            apply_filters(minutes, whole + named).select(
                F.col("bucket_start").alias("at"), "service", "level", "count"
            )
        )
    for since, until in edges:
        rows = scan_of(logs)(since, until)
        parts.append(
            apply_filters(rows, time_range(rows, since, until) + named).select(
                F.col("timestamp").alias("at"), "service", "level",
                F.lit(1).cast("long").alias("count"),
            )
        )
    source = parts[0]
    for part in parts[1:]:
        source = source.unionByName(part)
    return _bucketed(source, "at", query, F.sum("count").cast("long"))


def aggregate(
    logs: DataFrame | Scan, rollups: DataFrame | Scan, query: AggregateQuery
) -> DataFrame:
    """Counts per bucket, from the rollup wherever it can answer."""
    if can_use_rollup(query):
        return aggregate_rollup(rollups, logs, query)
    return aggregate_raw(logs, query)


def minute_rollup(logs: DataFrame) -> DataFrame:
    """Counts per minute, service and level."""
    return logs.groupBy(
        bucket(F.col("timestamp"), "1m").alias("bucket_start"), "service", "level"
    ).agg(F.count(F.lit(1)).alias("count"))


def merge_rollups(rollups: DataFrame) -> DataFrame:
    """One row per rollup key; counts of the same key are added up."""
    total = F.sum("count").cast("long")
    checked = F.when(total >= 0, total).otherwise(
        F.raise_error(F.lit("rollup count must not be negative")).cast("long")
    )
    return rollups.groupBy(*ROLLUP_KEYS).agg(checked.alias("count"))


def with_day(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("day", day_of(df, column))


def _bucketed(rows: DataFrame, at: str, query: AggregateQuery, count: Column) -> DataFrame:
    keys = [bucket(F.col(at), query.bucket).alias("bucket_start")]
    if query.group_by is not None:
        keys.append(F.col(GROUPS[query.group_by]).alias("group_value"))
    counted = rows.groupBy(*keys).agg(count.alias("count"))
    if query.group_by is None:
        counted = counted.withColumn("group_value", F.lit(None).cast("string"))
    return counted.select("bucket_start", "group_value", "count").orderBy(
        "bucket_start", "group_value"
    )
