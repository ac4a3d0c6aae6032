"""Counts over a stream of logs, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timeutil import bucket


def live_rollup(logs: DataFrame, width: str = "1m") -> DataFrame:
    """Counts per bucket, service and level for the update or complete output mode.

    There is no watermark, so that a late log still counts; the state then
    holds every bucket ever seen. The stored minute deltas do not have that
    cost and are the way to count at scale.
    """
    return logs.groupBy(
        bucket(F.col("timestamp"), width).alias("bucket_start"), "service", "level"
    ).agg(F.count(F.lit(1)).alias("count"))
