"""Time-bucket counts, rollups and calendar queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog.registry import LOGS_SQL, event_logs, query, table
from tidelog.catalog.searches import RANGE_SQL, SINCE, UNTIL
from tidelog.functions.timeutil import UTC, day_of, partition_day, partition_name
from tidelog.operators.aggregate import (
    aggregate_raw,
    aggregate_rollup,
    merge_rollups,
    minute_rollup,
)
from tidelog.operators.calendar import day_calendar, days_present
from tidelog.operators.filters import apply_filters, time_range
from tidelog.operators.maintain import kept_rows
from tidelog.operators.numbering import assign_ids
from tidelog.operators.render import render_buckets
from tidelog.plans.params import AggregateQuery

WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def bucket_sql(width: str) -> str:
    return f"time_bucket(INTERVAL '{WIDTHS[width]}', timestamp, TIMESTAMP '1970-01-01')"


def count_sql(width: str, group: str | None, condition: str, logs: str = LOGS_SQL) -> str:
    value = group or "CAST(NULL AS VARCHAR)"
    return (
        f"WITH {logs} SELECT {bucket_sql(width)} AS bucket_start, {value} AS group_value, "
        f"count(*) AS count FROM logs WHERE {condition} GROUP BY 1, 2"
    )


WHOLE = {"since": "2024-01-01T00:00:00Z", "until": "2024-03-01T00:00:00Z"}
WHOLE_SQL = "timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-03-01'"


def _raw(name: str, width: str, group: str | None = None, condition: str = "TRUE", **filters):
    sql = count_sql(width, group, f"{WHOLE_SQL} AND {condition}")

    @query(name, sql)
    def build(spark: SparkSession, folder: str) -> DataFrame:
        wanted = AggregateQuery(**WHOLE, bucket=width, group_by=group, **filters)
        return aggregate_raw(event_logs(spark, folder), wanted)


def _rollup(name: str, width: str, group: str | None = None, condition: str = "TRUE", **filters):
    """The rollup path over a range that starts and ends inside a minute."""
    sql = count_sql(width, group, f"{RANGE_SQL} AND {condition}")

    @query(name, sql)
    def build(spark: SparkSession, folder: str) -> DataFrame:
        logs = event_logs(spark, folder)
        wanted = AggregateQuery(since=SINCE, until=UNTIL, bucket=width, group_by=group, **filters)
        return aggregate_rollup(
            lambda since, until: minute_rollup(apply_filters(logs, time_range(logs, since, until))),
            logs, wanted,
        )


for _width in WIDTHS:
    _raw(f"agg_{_width}", _width)
    _rollup(f"agg_rollup_{_width}", _width)
_raw("agg_by_service", "1h", "service")
_raw("agg_by_level", "1h", "level")
_raw("agg_one_service", "1d", "level", "service = 'svc-2'", service="svc-2")
_raw("agg_one_level", "1d", "service", "level = 'warn'", level="warn")
_raw("agg_text_raw", "1h", "level", "message ILIKE '%PURCHASE%'", q="PURCHASE")
_raw("agg_attr_raw", "1h", None, "attributes::JSON ->> 'k' = '69'", attributes={"k": "69"})
_rollup("agg_rollup_partial_minutes", "5m", "level")
_rollup("agg_rollup_by_service", "1h", "service")
_rollup("agg_rollup_filtered", "1d", "service", "level = 'error'", level="error")

LINE_LOGS_SQL = """logs AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_shipdate AS timestamp,
         CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warn' ELSE 'info' END AS level,
         concat('line-', l_linestatus) AS service FROM lineitem)"""


def line_logs(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").alias("timestamp"),
        F.when(flag == "R", "error").when(flag == "A", "warn").otherwise("info").alias("level"),
        F.concat(F.lit("line-"), "l_linestatus").alias("service"),
    )


@query("agg_lineitem_days", count_sql("1d", "level", "TRUE", LINE_LOGS_SQL))
def agg_lineitem_days(spark: SparkSession, folder: str) -> DataFrame:
    wanted = AggregateQuery("1900-01-01T00:00:00Z", "2100-01-01T00:00:00Z", "1d", "level")
    return aggregate_raw(line_logs(spark, folder), wanted)


@query(
    "agg_orders_days",
    "SELECT time_bucket(INTERVAL '1 day', o_orderdate, TIMESTAMP '1970-01-01') AS bucket_start, "
    "o_orderpriority AS group_value, count(*) AS count FROM orders GROUP BY 1, 2",
)
def agg_orders_days(spark: SparkSession, folder: str) -> DataFrame:
    logs = table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("service"),
        F.lit("info").alias("level"),
    )
    wanted = AggregateQuery("1900-01-01T00:00:00Z", "2100-01-01T00:00:00Z", "1d", "service")
    return aggregate_raw(logs, wanted)


@query(
    "render_buckets",
    f"""WITH {LOGS_SQL} SELECT
      concat(left(strftime({bucket_sql("1h")}, '%Y-%m-%dT%H:%M:%S.%f'), 23), 'Z') AS start,
      level AS "group", count(*) AS count FROM logs GROUP BY 1, 2""",
)
def rendered_buckets(spark: SparkSession, folder: str) -> DataFrame:
    wanted = AggregateQuery(**WHOLE, bucket="1h", group_by="level")
    return render_buckets(aggregate_raw(event_logs(spark, folder), wanted))


ROLLUP_SQL = (
    f"WITH {LOGS_SQL} SELECT {bucket_sql('1m')} AS bucket_start, service, level, "
    "count(*) AS count FROM logs GROUP BY 1, 2, 3"
)


@query("rollup_minute", ROLLUP_SQL)
def rollup_minute(spark: SparkSession, folder: str) -> DataFrame:
    return minute_rollup(event_logs(spark, folder))


@query("rollup_minute_lineitem", ROLLUP_SQL.replace(LOGS_SQL, LINE_LOGS_SQL))
def rollup_minute_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return minute_rollup(line_logs(spark, folder))


@query("rollup_delta_merge", ROLLUP_SQL)
def rollup_delta_merge(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(spark, folder)
    odd = F.col("id") % 2 == 1
    deltas = minute_rollup(logs.filter(odd)).unionByName(minute_rollup(logs.filter(~odd)))
    return merge_rollups(deltas)


@query(
    "assign_ids",
    f"""WITH {LOGS_SQL} SELECT 1000 + row_number() OVER (ORDER BY timestamp, id) AS id,
      id AS source_id, timestamp FROM logs""",
)
def assigned_ids(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(spark, folder).select(F.col("id").alias("source_id"), "timestamp")
    return assign_ids(logs, [F.col("timestamp"), F.col("source_id")], 1001)


@query("days_present", f"WITH {LOGS_SQL} SELECT DISTINCT CAST(timestamp AS DATE) AS day FROM logs")
def present_days(spark: SparkSession, folder: str) -> DataFrame:
    return days_present(event_logs(spark, folder))


@query(
    "day_calendar",
    f"""WITH {LOGS_SQL} SELECT CAST(timestamp AS DATE) AS day FROM logs UNION
      SELECT CAST(unnest(generate_series(DATE '2024-01-20', DATE '2024-02-10',
                                         INTERVAL 1 DAY)) AS DATE) AS day""",
)
def calendar(spark: SparkSession, folder: str) -> DataFrame:
    return day_calendar(event_logs(spark, folder), date(2024, 1, 20), date(2024, 2, 10))


@query(
    "partition_names",
    f"""WITH {LOGS_SQL} SELECT strftime(CAST(timestamp AS DATE), 'logs_%Y%m%d') AS name,
      CAST(timestamp AS DATE) AS day, count(*) AS rows FROM logs GROUP BY 1, 2""",
)
def partition_names(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(spark, folder)
    name = partition_name(day_of(logs, "timestamp"))
    counted = logs.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("name", partition_day(F.col("name")).alias("day"), "rows")


NOW = datetime(2024, 1, 31, 12, 0, tzinfo=UTC)


def _kept(name: str, days: int, exact: bool, bound: str) -> None:
    @query(
        name,
        f"WITH {LOGS_SQL} SELECT id, timestamp FROM logs WHERE timestamp >= TIMESTAMP '{bound}'",
    )
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return kept_rows(event_logs(spark, folder), NOW, days, exact).select("id", "timestamp")


_kept("retention_kept_rows", 15, False, "2024-01-16 00:00:00")
_kept("retention_kept_exact", 15, True, "2024-01-16 12:00:00")


@query(
    "retention_rollup",
    ROLLUP_SQL.replace("FROM logs", "FROM logs WHERE timestamp >= TIMESTAMP '2024-01-16'"),
)
def retention_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rollup = minute_rollup(event_logs(spark, folder))
    return kept_rows(rollup, NOW, 15, column="bucket_start")
