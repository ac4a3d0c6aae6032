"""Request parsing, validation and synthetic log queries.

The test tables hold no JSON requests, so every event becomes a log entry, with
a fault that depends on its id, and every fifty entries become one request.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog.registry import LOGS_SQL, div, event_logs, query, table
from tidelog.functions.timeutil import UTC, iso_text, time_literal, utc_wall_clock
from tidelog.operators.validate import accepted_logs, check_requests, rejected_entries, request_outcomes, to_records
from tidelog.session import partitions_for
from tidelog.sources.requests import explode_requests
from tidelog.sources.synth import synthetic_columns

AS_OF = datetime(2024, 2, 15, tzinfo=UTC)

REASON_SQL = """CASE id % 10
    WHEN 1 THEN 'invalid timestamp'
    WHEN 2 THEN 'timestamp must not be more than five minutes in the future'
    WHEN 3 THEN 'invalid level'
    WHEN 4 THEN 'service must not be empty'
    WHEN 5 THEN 'message must not be empty'
    WHEN 6 THEN 'attributes must be a flat object'
    WHEN 7 THEN 'attributes must contain only string, number, or boolean values'
    WHEN 8 THEN 'log must be an object' END"""
# Requests 0, 7, 14, ... do not parse; of the others 0, 11, 22, ... have no entries.
GOOD_REQUEST_SQL = "(id // 50) % 7 <> 0 AND (id // 50) % 11 <> 0"


def entry_text(logs: DataFrame) -> Column:
    """JSON text of a log entry with the fault of its id."""
    fault = F.col("id") % 10
    stamp = (
        F.when(fault == 1, "2024-02-30T00:00:00Z")
        .when(fault == 2, "2024-02-15T00:05:00.001Z")
        .when(F.col("id") % 20 == 0, "2024-02-15T00:05:00Z")
        .otherwise(iso_text(logs, "timestamp", 6))
    )
    flat = F.struct(
        stamp.alias("timestamp"),
        F.when(fault == 3, "critical").otherwise(F.col("level")).alias("level"),
        F.when(fault.isin(3, 4), "").otherwise(F.col("service")).alias("service"),
        F.when(fault.isin(4, 5), "").otherwise(F.col("message")).alias("message"),
        F.lit(1).alias("unknown"),
    )
    attributes = (
        F.when(fault == 6, "null")
        .when(fault == 7, '{"a":{"b":1}}')
        .when(fault != 9, F.col("attributes"))
    )
    body = F.to_json(flat)
    with_attributes = F.concat(
        F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"attributes":'), attributes,
        F.lit("}"),
    )
    return F.when(fault == 8, F.lit("5")).otherwise(F.coalesce(with_attributes, body))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(spark, folder)
    entry = F.struct("id", entry_text(logs).alias("text"))
    numbered = logs.withColumn("request_id", div("id", 50))
    # Parsing takes long for its bytes: fixed partitions keep the shuffle from being coalesced.
    spread = numbered.repartition(partitions_for(logs), "request_id")
    packed = spread.groupBy("request_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    number = F.col("request_id")
    body = (
        F.when(number % 7 == 0, '{"logs": [')
        .when(number % 11 == 0, '{"logs": []}')
        .otherwise(
            F.concat(F.lit('{"logs":['), F.array_join(F.col("entries.text"), ","), F.lit("]}"))
        )
    )
    return packed.select("request_id", body.alias("body"))


@query(
    "parse_requests",
    f"""WITH {LOGS_SQL} SELECT id // 50 AS request_id, CAST(id % 50 AS INTEGER) AS index
      FROM logs WHERE {GOOD_REQUEST_SQL}""",
)
def parse_requests(spark: SparkSession, folder: str) -> DataFrame:
    entries, _ = explode_requests(requests(spark, folder))
    return entries.select("request_id", "index")


@query(
    "bad_requests",
    f"""WITH {LOGS_SQL} SELECT DISTINCT id // 50 AS request_id FROM logs
      WHERE NOT ({GOOD_REQUEST_SQL})""",
)
def bad_requests(spark: SparkSession, folder: str) -> DataFrame:
    return explode_requests(requests(spark, folder))[1]


@query(
    "to_records",
    f"""WITH {LOGS_SQL} SELECT id // 50 AS request_id, CAST(id % 50 AS INTEGER) AS index,
      CASE WHEN id % 10 IN (1, 8) THEN NULL WHEN id % 10 = 2 THEN TIMESTAMP '2024-02-15 00:05:00.001'
        WHEN id % 20 = 0 THEN TIMESTAMP '2024-02-15 00:05:00' ELSE timestamp END AS timestamp,
      CASE WHEN id % 10 = 8 THEN NULL WHEN id % 10 = 3 THEN 'critical' ELSE level END AS level,
      CASE WHEN id % 10 = 8 THEN NULL WHEN id % 10 IN (3, 4) THEN '' ELSE service END AS service,
      CASE WHEN id % 10 = 8 THEN NULL WHEN id % 10 IN (4, 5) THEN '' ELSE message END AS message,
      CASE WHEN id % 10 IN (6, 7) THEN NULL WHEN id % 10 IN (8, 9) THEN '{{}}' ELSE replace(attributes, ' ', '') END AS attributes,
      CASE WHEN id % 10 NOT IN (6, 7, 8, 9) THEN attributes::JSON ->> 'k' END AS k
      FROM logs WHERE {GOOD_REQUEST_SQL}""",
)
def records(spark: SparkSession, folder: str) -> DataFrame:
    entries, _ = explode_requests(requests(spark, folder))
    found = to_records(entries)
    return found.select(
        "request_id", "index", utc_wall_clock(found, "timestamp").alias("timestamp"), "level", "service", "message",
        "attributes", F.try_element_at("attr_text", F.lit("k")).alias("k"),
    )


@query(
    "validate_reasons",
    f"""WITH {LOGS_SQL} SELECT id // 50 AS request_id, CAST(id % 50 AS INTEGER) AS index,
      {REASON_SQL} AS reason FROM logs
      WHERE {GOOD_REQUEST_SQL} AND {REASON_SQL} IS NOT NULL""",
)
def validate_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_entries(check_requests(requests(spark, folder), AS_OF))


@query(
    "validate_accepted",
    f"""WITH {LOGS_SQL} SELECT id // 50 AS request_id, CAST(id % 50 AS INTEGER) AS index,
      CASE WHEN id % 20 = 0 THEN TIMESTAMP '2024-02-15 00:05:00' ELSE timestamp END AS timestamp,
      level, service, message,
      CASE WHEN id % 10 = 9 THEN '{{}}' ELSE replace(attributes, ' ', '') END AS attributes,
      CASE WHEN id % 10 <> 9 THEN attributes::JSON ->> 'k' END AS k
      FROM logs WHERE {GOOD_REQUEST_SQL} AND {REASON_SQL} IS NULL""",
)
def validate_accepted(spark: SparkSession, folder: str) -> DataFrame:
    valid = accepted_logs(check_requests(requests(spark, folder), AS_OF))
    return valid.select(
        "request_id", "index", utc_wall_clock(valid, "timestamp").alias("timestamp"),
        "level", "service", "message", "attributes",
        F.try_element_at("attr_text", F.lit("k")).alias("k"),
    )


@query(
    "request_outcomes",
    f"""WITH {LOGS_SQL}, checked AS (
      SELECT id, id // 50 AS request_id, {GOOD_REQUEST_SQL} AS good, {REASON_SQL} AS reason
      FROM logs)
    SELECT request_id, count(*) FILTER (good AND reason IS NULL) AS accepted,
      CAST(coalesce(to_json(list({{'index': id % 50, 'reason': reason}} ORDER BY id)
        FILTER (good AND reason IS NOT NULL)), '[]') AS VARCHAR) AS rejected,
      CAST(CASE WHEN count(*) FILTER (good AND reason IS NULL) > 0 THEN 200 ELSE 400 END
        AS INTEGER) AS status,
      CASE WHEN NOT bool_or(good)
        THEN 'request body must contain a non-empty logs array' END AS error
    FROM checked GROUP BY request_id""",
)
def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return request_outcomes(check_requests(requests(spark, folder), AS_OF)).withColumn("rejected", F.to_json("rejected"))


@query(
    "generate_logs",
    """SELECT event_id AS id,
      TIMESTAMP '2024-02-15' - to_seconds(event_id % 600) AS timestamp,
      CASE event_id % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn'
        ELSE 'error' END AS level,
      concat('unit-', event_id % 20) AS service,
      concat('sample entry ', event_id % 100) AS message,
      concat('{"region":"region-', event_id % 4, '","worker":', event_id % 16,
        ',"sampled":', event_id % 2 = 0, '}') AS attributes
    FROM events""",
)
def generated(spark: SparkSession, folder: str) -> DataFrame:
    index = F.col("event_id")
    columns = synthetic_columns(index, time_literal(AS_OF, ntz=True))
    return table(spark, folder, "events").select(
        index.alias("id"), *(column.alias(name) for name, column in columns.items())
    )
