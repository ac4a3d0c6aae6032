"""Report queries; event values stand for latencies in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog.registry import LOGS_SQL, div, event_logs, query, table
from tidelog.operators.report import (
    failed_checks,
    latency_summary,
    long_metrics,
    reconcile,
    status_summary,
    throughput,
    visibility_lag,
)

RESULTS_SQL = """results AS (
  SELECT event_type AS endpoint, value AS latency_ms,
         CASE WHEN event_type = 'error' AND value > 100 THEN 503 WHEN value > 200 THEN 0
              WHEN value > 150 THEN 429 ELSE 200 END AS status FROM events)"""
LATENCY_SQL = """SELECT endpoint, count(*) AS samples, round(avg(latency_ms), 6) AS avg,
  min(latency_ms) AS min, max(latency_ms) AS max,
  round(quantile_cont(latency_ms, 0.5), 6) AS med, round(quantile_cont(latency_ms, 0.9), 6) AS p90,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99
  FROM results GROUP BY endpoint"""
STATUS_SQL = """SELECT endpoint, count(*) AS requests,
  count(*) FILTER (status = 200) AS responses_200, count(*) FILTER (status = 429) AS responses_429,
  count(*) FILTER (status = 503) AS responses_503, count(*) FILTER (status = 0) AS timeouts,
  round(avg(CASE WHEN status = 200 THEN 1.0 ELSE 0.0 END), 6) AS success_rate
  FROM results GROUP BY endpoint"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, folder, "events").select(
        kind.alias("endpoint"),
        value.alias("latency_ms"),
        F.when((kind == "error") & (value > 100), 503)
        .when(value > 200, 0)
        .when(value > 150, 429)
        .otherwise(200)
        .alias("status"),
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


@query("latency_summary", f"WITH {RESULTS_SQL} {LATENCY_SQL}")
def latency(spark: SparkSession, folder: str) -> DataFrame:
    summary = latency_summary(results(spark, folder))
    return rounded(summary, "avg", "med", "p90", "p95", "p99")


@query("status_summary", f"WITH {RESULTS_SQL} {STATUS_SQL}")
def statuses(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(status_summary(results(spark, folder)), "success_rate")


RULES = [
    (f"{endpoint}.{metric}", op, bound)
    for endpoint in ("click", "error", "purchase", "signup", "view")
    for metric, op, bound in (
        ("p95", "<", 150.0), ("max", "<", 500.0), ("timeouts", "==", 0.0), ("success_rate", ">=", 0.9),
    )
]
RULES_SQL = ", ".join(f"('{metric}', '{op}', CAST({bound} AS DOUBLE))" for metric, op, bound in RULES)


@query(
    "failed_checks",
    f"""WITH {RESULTS_SQL}, latency AS ({LATENCY_SQL}), statuses AS ({STATUS_SQL}), metrics AS (
      SELECT concat(endpoint, '.p95') AS metric, p95 AS value FROM latency
      UNION ALL SELECT concat(endpoint, '.max'), max FROM latency
      UNION ALL SELECT concat(endpoint, '.timeouts'), CAST(timeouts AS DOUBLE) FROM statuses
      UNION ALL SELECT concat(endpoint, '.success_rate'), CAST(success_rate AS DOUBLE) FROM statuses)
    SELECT metric, op, bound, value FROM (VALUES {RULES_SQL}) AS rules (metric, op, bound)
      LEFT JOIN metrics USING (metric)
    WHERE NOT coalesce(CASE op WHEN '<' THEN value < bound WHEN '>=' THEN value >= bound
      ELSE value = bound END, FALSE)""",
)
def broken_rules(spark: SparkSession, folder: str) -> DataFrame:
    metrics = long_metrics(latency(spark, folder), "endpoint", ["p95", "max"]).unionByName(
        long_metrics(statuses(spark, folder), "endpoint", ["timeouts", "success_rate"])
    )
    rules = spark.createDataFrame(RULES, "metric string, op string, bound double")
    return failed_checks(metrics, rules)


@query(
    "reconcile_gaps",
    f"""WITH {LOGS_SQL}, a AS (SELECT service, count(*) AS accepted FROM logs GROUP BY 1),
      p AS (SELECT concat('svc-', o_custkey % 9) AS service, count(*) AS persisted
            FROM orders GROUP BY 1),
      sides AS (SELECT service, coalesce(accepted, 0) AS accepted, coalesce(persisted, 0) AS persisted
                FROM a FULL OUTER JOIN p USING (service))
    SELECT service, accepted, persisted,
      CASE WHEN accepted = persisted THEN 'CONSISTENT'
           WHEN accepted > persisted THEN concat('MISSING ', accepted - persisted)
           ELSE concat('EXCESS ', persisted - accepted) END AS status FROM sides""",
)
def reconcile_gaps(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("svc-"), F.col("o_custkey") % 9).alias("service")
    )
    return reconcile(event_logs(spark, folder), orders)


@query(
    "throughput",
    """SELECT count(*) AS accepted, round(count(*) / 2592000.0, 9) AS logs_per_second,
      CASE WHEN count(*) = 12000 THEN 'MET TARGET'
           WHEN count(*) > 12000 THEN concat('EXCEEDED TARGET BY ', count(*) - 12000)
           ELSE concat('BELOW TARGET BY ', 12000 - count(*)) END AS status FROM events""",
)
def accepted_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a month, taken as commits of up to 500 rows."""
    events = table(spark, folder, "events")
    commits = events.groupBy(div("event_id", 500)).agg(F.count(F.lit(1)).alias("rows"))
    report = throughput(commits, 30 * 86400, 12000)
    return report.withColumn("logs_per_second", F.round("logs_per_second", 9))


@query(
    "visibility_lag",
    f"""WITH {LOGS_SQL}, spans AS (
      SELECT id // 10 AS segment, count(*) AS logs, min(timestamp) AS oldest,
             max(timestamp) AS newest,
             quantile_cont(CAST(epoch_us(timestamp) // 1000 AS DOUBLE), [0.5, 0.05, 0.01]) AS ages
      FROM logs GROUP BY 1)
    SELECT segment, logs,
      round((epoch_us(newest) + 7000000 - epoch_us(oldest)) / 1e6, 6) AS max_lag_s,
      round(((epoch_us(newest) + 7000000) // 1000 - ages[1]) / 1e3, 6) AS p50_lag_s,
      round(((epoch_us(newest) + 7000000) // 1000 - ages[2]) / 1e3, 6) AS p95_lag_s,
      round(((epoch_us(newest) + 7000000) // 1000 - ages[3]) / 1e3, 6) AS p99_lag_s,
      round(7.0::DOUBLE, 6) AS min_lag_s,
      (epoch_us(newest) + 7000000 - epoch_us(oldest)) / 1e6 <= 3600 AS within_bound FROM spans""",
)
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Ten events make a segment, committed seven seconds after its newest event."""
    logs = event_logs(spark, folder).withColumn("segment", div("id", 10))
    commits = logs.groupBy("segment").agg(
        (F.max("timestamp") + F.expr("INTERVAL 7 SECONDS")).alias("committed_at")
    )
    return rounded(visibility_lag(logs, commits, 3600), "max_lag_s", "p50_lag_s", "p95_lag_s", "p99_lag_s", "min_lag_s")
