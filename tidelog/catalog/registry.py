"""The registry, and log tables derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.timeutil import whole_quotient

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The log table behind most queries: the same view in both engines.
LOGS_SQL = """logs AS (
  SELECT event_id AS id, ts AS timestamp,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
                         WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
         concat('svc-', CAST(user_id % 8 AS VARCHAR(20))) AS service,
         concat('User ', CAST(user_id AS VARCHAR(20)), ' did ', event_type) AS message,
         props AS attributes
  FROM events)"""
COLUMNS_SQL = "id, timestamp, level, service, message, attributes"


def query(name: str, sql: str | None = None):
    """Register a function under ``name``, with its SQL twin."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_logs(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """The ``events`` table (or a stream of it) as a log table."""
    kind = F.col("event_type")
    events = table(spark, folder, "events") if events is None else events
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.when(kind == "error", "error")
        .when(kind == "purchase", "warn")
        .when(kind == "view", "debug")
        .otherwise("info")
        .alias("level"),
        F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("service"),
        F.concat(F.lit("User "), F.col("user_id"), F.lit(" did "), kind).alias("message"),
        F.col("props").alias("attributes"),
    )


def div(column: str, by: int) -> Column:
    return whole_quotient(F.col(column), F.lit(by))
