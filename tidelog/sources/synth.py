"""Deterministic synthetic logs, for load runs and scale checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.timeutil import time_literal
from tidelog.schema import LEVELS

# The cycle lengths of the generated columns.
SPREAD_SECONDS = 600
MESSAGES = 100
REGIONS = 4
WORKERS = 16
SERVICES = 20


def synthetic_columns(
    index: Column, base: Column, services: int = SERVICES, prefix: str = "unit"
) -> dict[str, Column]:
    """Log columns as a function of a row index; ``base`` is the latest timestamp."""

    def cycle(length: int) -> Column:
        return index % F.lit(length)

    zero = F.lit(0)
    age = F.make_dt_interval(zero, zero, zero, cycle(SPREAD_SECONDS).cast("decimal(18,6)"))
    levels = F.array(*(F.lit(level) for level in LEVELS))
    return {
        "timestamp": base - age,
        "level": F.element_at(levels, (cycle(len(LEVELS)) + 1).cast("int")),
        "service": F.concat_ws("-", F.lit(prefix), cycle(services)),
        "message": F.concat_ws(" ", F.lit("sample entry"), cycle(MESSAGES)),
        "attributes": F.to_json(
            F.struct(
                F.concat_ws("-", F.lit("region"), cycle(REGIONS)).alias("region"),
                cycle(WORKERS).alias("worker"),
                (cycle(2) == 0).alias("sampled"),
            )
        ),
    }


def generate_logs(
    spark: SparkSession, rows: int, services: int = SERVICES, base: datetime | None = None
) -> DataFrame:
    """``rows`` synthetic logs, row ``i`` with id ``i``."""
    latest = F.current_timestamp() if base is None else time_literal(base)
    ids = spark.range(rows)
    return ids.select("id", *_named(synthetic_columns(F.col("id"), latest, services)))


def generate_stream(spark: SparkSession, rows_per_second: int, services: int = SERVICES) -> DataFrame:
    """Synthetic logs as an endless stream, each as old as its place in the cycle."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    columns = synthetic_columns(F.col("value"), F.col("timestamp"), services)
    return ticks.select(F.col("value").alias("id"), *_named(columns))


def log_requests(logs: DataFrame, request: Column, order: Column, timestamp: Column) -> DataFrame:
    """Pack logs into ingest request bodies, one per value of ``request``."""
    entry = F.struct(
        timestamp.alias("timestamp"), "level", "service", "message",
        F.parse_json("attributes").alias("attributes"),
    )
    numbered = F.struct(order.alias("order"), F.to_json(entry).alias("entry"))
    return (
        logs.select(request.alias("request"), numbered.alias("numbered"))
        .groupBy("request")
        .agg(F.sort_array(F.collect_list("numbered")).alias("entries"))
        .select(
            "request",
            F.concat(
                F.lit('{"logs":['), F.array_join(F.col("entries.entry"), ","), F.lit("]}")
            ).alias("body"),
        )
    )


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]
