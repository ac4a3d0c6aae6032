"""Search, paging, cursor and rendering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog.registry import COLUMNS_SQL, LOGS_SQL, event_logs, query, table
from tidelog.functions.attributes import number_text
from tidelog.functions.cursor import cursor_position, cursor_token, decode_cursor
from tidelog.functions.timeutil import utc_wall_clock
from tidelog.operators.render import render_logs
from tidelog.operators.search import paged_export, search, search_page
from tidelog.plans.params import LogQuery

NEWEST = "ORDER BY timestamp DESC, id DESC"


def _search_sql(condition: str = "TRUE", limit: int = 1000, logs: str = LOGS_SQL) -> str:
    return f"WITH {logs} SELECT {COLUMNS_SQL} FROM logs WHERE {condition} {NEWEST} LIMIT {limit}"


@query("search_all", _search_sql(limit=100))
def search_all(spark: SparkSession, folder: str) -> DataFrame:
    return search(event_logs(spark, folder), LogQuery())


@query("search_service", _search_sql("service = 'svc-3'"))
def search_service(spark: SparkSession, folder: str) -> DataFrame:
    return search(event_logs(spark, folder), LogQuery(service="svc-3", limit=1000))


@query("search_level", _search_sql("level = 'error'"))
def search_level(spark: SparkSession, folder: str) -> DataFrame:
    return search(event_logs(spark, folder), LogQuery(level="error", limit=1000))


SINCE, UNTIL = "2024-01-03T10:00:37.000500Z", "2024-01-09T11:00:22.250Z"
RANGE_SQL = (
    "timestamp >= TIMESTAMP '2024-01-03 10:00:37.000500' "
    "AND timestamp < TIMESTAMP '2024-01-09 11:00:22.25'"
)


@query("search_time_range", _search_sql(RANGE_SQL))
def search_time_range(spark: SparkSession, folder: str) -> DataFrame:
    return search(event_logs(spark, folder), LogQuery(since=SINCE, until=UNTIL, limit=1000))


@query("search_attr", _search_sql("attributes::JSON ->> 'k' = '69'"))
def search_attr(spark: SparkSession, folder: str) -> DataFrame:
    return search(event_logs(spark, folder), LogQuery(attributes={"k": "69"}, limit=1000))


@query("search_text", _search_sql("message ILIKE '%did purch%'"))
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    return search(event_logs(spark, folder), LogQuery(q="DID Purch", limit=1000))


@query(
    "search_text_metachars",
    _search_sql(
        "contains(lower(message), '5_0%!')",
        logs=LOGS_SQL.replace(
            "concat('User ', CAST(user_id AS VARCHAR(20)), ' did ', event_type) AS message",
            "concat(CASE event_id % 4 WHEN 0 THEN 'A5_0%!b ' WHEN 1 THEN 'a5x0%! ' "
            "WHEN 2 THEN 'a5_0x! ' ELSE 'a5_0%x ' END, event_type) AS message",
        ),
    ),
)
def search_text_metachars(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("id") % 4
    start = (
        F.when(kind == 0, "A5_0%!b ").when(kind == 1, "a5x0%! ").when(kind == 2, "a5_0x! ")
        .otherwise("a5_0%x ")
    )
    event = F.regexp_extract("message", r"(\w+)$", 1)
    logs = event_logs(spark, folder).withColumn("message", F.concat(start, event))
    return search(logs, LogQuery(q="5_0%!", limit=1000))


@query(
    "search_combined",
    _search_sql(
        f"service = 'svc-5' AND level = 'info' AND message ILIKE '%click%' AND {RANGE_SQL} "
        "AND CAST(attributes::JSON ->> 'k' AS INTEGER) = 42"
    ),
)
def search_combined(spark: SparkSession, folder: str) -> DataFrame:
    wanted = LogQuery(
        service="svc-5", level="info", since=SINCE, until=UNTIL, q="click",
        attributes={"k": "42"}, limit=1000,
    )
    return search(event_logs(spark, folder), wanted)


@query(
    "search_page2_cursor",
    f"WITH {LOGS_SQL} SELECT {COLUMNS_SQL} FROM logs WHERE level = 'info' "
    f"{NEWEST} LIMIT 100 OFFSET 100",
)
def search_page2_cursor(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(spark, folder)
    first = search_page(logs, LogQuery(level="info", limit=100))
    if first.next_cursor is None:
        return logs.limit(0)
    cursor = decode_cursor(first.next_cursor)
    return search(logs, LogQuery(level="info", limit=100, cursor=cursor))


DENSE_SQL = LOGS_SQL.replace(
    "ts AS timestamp",
    "TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(event_id) AS timestamp",
)
CURSOR_SQL = """replace(replace(rtrim(to_base64(encode(concat(
         '{"timestamp":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","id":"',
         CAST(id AS VARCHAR), '"}'))), '='), '+', '-'), '/', '_')"""


def dense_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Logs one microsecond apart, many inside each millisecond."""
    logs = event_logs(spark, folder)
    zero = F.lit(0)
    after = F.make_dt_interval(zero, zero, zero, (F.col("id") / 1e6).cast("decimal(18,6)"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return logs.withColumn("timestamp", start + after)


@query(
    "search_all_pages",
    f"""WITH {DENSE_SQL}, ranked AS (
      SELECT *, row_number() OVER ({NEWEST}) - 1 AS r, count(*) OVER () AS n FROM logs)
    SELECT r // 700 AS page, {COLUMNS_SQL},
           CASE WHEN r % 700 = 699 AND r < n - 1 THEN {CURSOR_SQL} END AS next_cursor
    FROM ranked""",
)
def search_all_pages(spark: SparkSession, folder: str) -> DataFrame:
    return paged_export(dense_logs(spark, folder), LogQuery(limit=700))


@query("cursor_tokens", f"WITH {LOGS_SQL} SELECT id, {CURSOR_SQL} AS token FROM logs")
def cursor_tokens(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(spark, folder)
    return logs.select("id", cursor_token(logs).alias("token"))


@query(
    "cursor_decoded",
    f"""WITH {LOGS_SQL} SELECT id AS row_id,
      CASE WHEN id % 5 <> 0 THEN timestamp END AS timestamp,
      CASE WHEN id % 5 <> 0 THEN id END AS id FROM logs""",
)
def cursor_decoded(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(spark, folder)
    token = F.when(F.col("id") % 5 != 0, cursor_token(logs)).otherwise(
        F.concat(F.lit("not-a-cursor"), "id")
    )
    place = logs.select(F.col("id").alias("row_id"), cursor_position(token).alias("p"))
    flat = place.select("row_id", "p.timestamp", "p.id")
    return flat.select("row_id", utc_wall_clock(flat, "timestamp").alias("timestamp"), "id")


@query(
    "render_logs",
    f"""WITH {LOGS_SQL} SELECT CAST(id AS VARCHAR) AS id,
      concat(left(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), 23), 'Z') AS timestamp,
      level, service, message, replace(attributes, ' ', '') AS attributes FROM logs""",
)
def rendered_logs(spark: SparkSession, folder: str) -> DataFrame:
    shown = render_logs(event_logs(spark, folder))
    return shown.withColumn("attributes", F.to_json("attributes"))


@query(
    "number_texts",
    """SELECT event_id, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS plain,
      regexp_replace(CAST(value * 1048576.0 AS VARCHAR), '\\.0$', '') AS large FROM events""",
)
def number_texts(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value")
    return table(spark, folder, "events").select(
        "event_id", number_text(value).alias("plain"), number_text(value * 1048576.0).alias("large")
    )
