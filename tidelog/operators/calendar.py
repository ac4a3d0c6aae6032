"""UTC days of a log table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timeutil import day_of


def days_present(logs: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Distinct UTC days; the ``day`` column is used where the table has one."""
    day = F.col("day") if "day" in logs.columns else day_of(logs, timestamp)
    return logs.select(day.alias("day")).distinct()


def day_series(logs: DataFrame, first: date, last: date) -> DataFrame:
    """Every day from ``first`` to ``last``."""
    step = F.expr("INTERVAL 1 DAY")
    days = F.explode(F.sequence(F.lit(first), F.lit(last), step)).alias("day")
    return logs.sparkSession.range(1).select(days)


def day_calendar(
    logs: DataFrame, first: date, last: date, timestamp: str = "timestamp"
) -> DataFrame:
    """The days of the data and every day of a range, each once."""
    return days_present(logs, timestamp).union(day_series(logs, first, last)).distinct()
