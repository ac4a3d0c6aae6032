"""Results in the shape clients see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timeutil import iso_text


def render_logs(logs: DataFrame) -> DataFrame:
    """Id as text, timestamp as ISO-8601 UTC text, attributes as a VARIANT object."""
    return logs.select(
        F.col("id").cast("string").alias("id"),
        iso_text(logs, "timestamp").alias("timestamp"),
        "level", "service", "message",
        F.parse_json(F.coalesce("attributes", F.lit("{}"))).alias("attributes"),
    )


def render_logs_json(logs: DataFrame) -> DataFrame:
    """One JSON document per log."""
    shown = render_logs(logs)
    return shown.select(F.to_json(F.struct(*shown.columns)).alias("log"))


def render_buckets(buckets: DataFrame) -> DataFrame:
    """Bucket start as ISO-8601 UTC text, nullable group, count."""
    return buckets.select(
        iso_text(buckets, "bucket_start").alias("start"),
        F.col("group_value").alias("group"),
        F.col("count").cast("long").alias("count"),
    )
