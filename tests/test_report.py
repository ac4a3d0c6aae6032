from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelog.operators.calendar import day_calendar, days_present
from tidelog.operators.report import (
    failed_checks,
    latency_summary,
    long_metrics,
    reconcile,
    status_summary,
    throughput,
    visibility_lag,
)
from tidelog.sources.synth import generate_logs, generate_stream


def results(spark, rows):
    return spark.createDataFrame(rows, "endpoint string, latency_ms double, status int")


def test_percentiles_interpolate(spark):
    rows = [("a", float(v), 200) for v in range(1, 11)] + [("b", 7.0, 200)] * 5
    rows += [("c", None, 0), ("c", 3.0, 200), (None, 1.0, 200), (None, 2.0, 200)]
    found = {r["endpoint"]: r for r in latency_summary(results(spark, rows)).collect()}
    a = found["a"]
    assert (a["samples"], a["avg"], a["min"], a["max"], a["med"]) == (10, 5.5, 1.0, 10.0, 5.5)
    assert (a["p90"], a["p95"], a["p99"]) == pytest.approx((9.1, 9.55, 9.91))
    assert [found["b"][p] for p in ("med", "p90", "p99")] == [7.0] * 3
    assert (found["c"]["samples"], found["c"]["med"]) == (1, 3.0)
    assert found[None]["med"] == 1.5


def test_percentiles_of_one_hot_group(spark):
    values = spark.range(20000).select(
        F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("endpoint"),
        ((F.col("id") * 7919) % 20011 / 7).alias("latency_ms"), F.lit(200).alias("status"),
    )
    exact = {r["endpoint"]: r for r in latency_summary(values).collect()}
    plain = values.groupBy("endpoint").agg(
        *(F.percentile("latency_ms", p).alias(n) for n, p in (("med", 0.5), ("p95", 0.95), ("p99", 0.99)))
    )
    for row in plain.collect():
        for name in ("med", "p95", "p99"):
            assert exact[row["endpoint"]][name] == pytest.approx(row[name], abs=1e-9)
    rough = {r["endpoint"]: r for r in latency_summary(values, accuracy=1000).collect()}
    assert rough["hot"]["p95"] == pytest.approx(exact["hot"]["p95"], rel=0.01)


def test_statuses_and_rules(spark):
    rows = [("a", 1.0, 200)] * 8 + [("a", 1.0, 0), ("a", 1.0, 429), ("b", 1.0, 503)]
    summary = status_summary(results(spark, rows))
    a = {r["endpoint"]: r for r in summary.collect()}["a"]
    assert tuple(a)[1:] == (10, 8, 1, 0, 1, 0.8)
    metrics = long_metrics(summary, "endpoint", ["success_rate", "timeouts"])
    rules = spark.createDataFrame(
        [("a.success_rate", ">=", 0.8), ("a.timeouts", "==", 0.0), ("b.timeouts", "<=", 0.0),
         ("b.success_rate", ">", 0.5), ("z.any", "<", 1.0)],
        "metric string, op string, bound double",
    )
    broken = {r["metric"]: r["value"] for r in failed_checks(metrics, rules).collect()}
    assert broken == {"a.timeouts": 1.0, "b.success_rate": 0.0, "z.any": None}


def test_reconcile(spark):
    sent = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2 + [("w",)], "service string")
    kept = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 4), ("w", 0)], "service string, count long")
    status = {r["service"]: r["status"] for r in reconcile(sent, kept).collect()}
    assert status == {"x": "CONSISTENT", "y": "MISSING 1", "z": "EXCESS 4", "w": "MISSING 1"}


@pytest.mark.parametrize(
    "target, status",
    [(300, "MET TARGET"), (200, "EXCEEDED TARGET BY 100"), (310, "BELOW TARGET BY 10")],
)
def test_throughput(spark, target, status):
    commits = spark.createDataFrame([(100,), (200,)], "rows long")
    assert tuple(throughput(commits, 60, target).first()) == (300, 5.0, status)


def test_throughput_counts_ingest_only(spark):
    rows = [("ingest", 100), ("compact_logs", 100), ("expire", -30), ("ingest", 50), ("backfill", 7)]
    assert throughput(spark.createDataFrame(rows, "kind string, rows long"), 10, 150).first()["status"] == "MET TARGET"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_visibility_lag(new_york, kind):
    logs = new_york.createDataFrame(
        [("s1", "2024-03-10 01:59:50"), ("s1", "2024-03-10 03:00:00")], "segment string, t string"
    ).select("segment", F.col("t").cast(kind).alias("timestamp"))
    commits = new_york.createDataFrame([("s1", "2024-03-10 03:00:05")], "segment string, t string").select(
        "segment", F.col("t").cast(kind).alias("committed_at")
    )
    row = visibility_lag(logs, commits).first()
    gap = 15.0 if kind == "timestamp" else 3615.0
    usual = [pytest.approx(5 + p * (gap - 5)) for p in (0.5, 0.95, 0.99)]
    assert tuple(row) == ("s1", 2, gap, *usual, 5.0, gap <= 20)


def test_calendar(spark):
    logs = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-03 23:59:59' AS timestamp UNION ALL SELECT TIMESTAMP_NTZ '2024-01-03 00:00:00'")
    assert [r[0] for r in days_present(logs).collect()] == [date(2024, 1, 3)]
    days = [r[0] for r in day_calendar(logs, date(2024, 1, 2), date(2024, 1, 4)).orderBy("day").collect()]
    assert days == [date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 4)]


def test_generator(spark):
    logs = generate_logs(spark, 2000, services=7)
    assert logs.count() == 2000
    assert logs.groupBy("service").count().count() == 7
    assert logs.select("attributes").distinct().count() == 16
    row = logs.filter("id = 1203").first()
    assert (row["level"], row["service"], row["message"]) == ("error", "unit-6", "sample entry 3")
    assert row["attributes"] == '{"region":"region-3","worker":3,"sampled":false}'
    assert generate_stream(spark, 10).isStreaming
