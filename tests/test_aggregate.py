import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.functions.timeutil import time_literal
from tidelog.operators.aggregate import (
    aggregate,
    aggregate_raw,
    aggregate_rollup,
    can_use_rollup,
    merge_rollups,
    minute_rollup,
    split_range,
    with_day,
)
from tidelog.plans.params import AggregateQuery

UTC = timezone.utc
FIRST = datetime(2027, 2, 28, 23, 58, 41, tzinfo=UTC)
# One log every 17.000003 seconds, over the end of a month; the hours hold different services.
LOGS = [
    (FIRST + n * timedelta(seconds=17, microseconds=3), "error" if n % 7 == 2 else "info", f"pump{n % 4 + n // 150}", f"flow {n % 13}", n % 6)
    for n in range(400)
]
RANGE = {"since": "2027-02-28T23:59:07.5Z", "until": "2027-03-01T01:40:33Z"}
WIDTHS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def logs(spark, request):
    rows = [(t.replace(tzinfo=None).isoformat(" "), level, service, message, f'{{"valve": {valve}.0}}') for t, level, service, message, valve in LOGS]
    df = spark.createDataFrame(rows, "timestamp string, level string, service string, message string, attributes string")
    return df.withColumn("timestamp", F.col("timestamp").cast(request.param)).cache()


def expected(bucket, group=None, keep=lambda *log: True):
    """Counts by bucket and group, of the logs inside the range that are kept."""
    since, until = (datetime.fromisoformat(RANGE[end]) for end in ("since", "until"))
    counts = Counter()
    for log in LOGS:
        if since <= log[0] < until and keep(*log):
            start = int(log[0].timestamp()) // WIDTHS[bucket] * WIDTHS[bucket]
            value = {"level": log[1], "service": log[2], None: None}[group]
            counts[datetime.fromtimestamp(start, UTC).replace(tzinfo=None), value] += 1
    return counts


def counted(rows):
    found = Counter({(r["bucket_start"], r["group_value"]): r["count"] for r in rows.collect()})
    return Counter({(start if start.tzinfo is None else start.astimezone(UTC).replace(tzinfo=None), value): n for (start, value), n in found.items()})


def test_minute_rollup(logs):
    keys = {(t.replace(second=0, microsecond=0), service, level) for t, level, service, _, _ in LOGS}
    rolled = minute_rollup(logs)
    assert rolled.count() == len(keys) and rolled.agg(F.sum("count")).first()[0] == len(LOGS)


@pytest.mark.parametrize("bucket", list(WIDTHS))
@pytest.mark.parametrize("group", [None, "level", "service"])
def test_counts_by_bucket_and_group(logs, bucket, group):
    query = AggregateQuery(**RANGE, bucket=bucket, group_by=group)
    for rows in (aggregate_raw(logs, query), aggregate(logs, minute_rollup(logs), query)):
        assert counted(rows) == expected(bucket, group)


def test_counts_of_one_level_and_service(logs):
    query = AggregateQuery(**RANGE, bucket="5m", level="error", service="pump2")
    for rows in (aggregate_raw(logs, query), aggregate(logs, minute_rollup(logs), query)):
        assert counted(rows) == expected("5m", None, lambda t, level, service, m, v: (level, service) == ("error", "pump2"))


@pytest.mark.parametrize(
    "filters, keep",
    [({"q": "FLOW 1"}, lambda t, level, s, message, v: "flow 1" in message), ({"attributes": {"valve": "4"}}, lambda t, level, s, m, valve: valve == 4)],
)
def test_text_and_attributes_go_to_the_raw_path(logs, filters, keep):
    empty = minute_rollup(logs).limit(0)
    query = AggregateQuery(**RANGE, bucket="1h", **filters)
    assert not can_use_rollup(query)
    assert counted(aggregate(logs, empty, query)) == expected("1h", None, keep)
    with pytest.raises(ValueError):
        aggregate_rollup(empty, logs, query)


def at(text):
    return datetime.fromisoformat(f"2031-03-04T{text}+00:00")


@pytest.mark.parametrize(
    "since, until, interior, edges",
    [
        ("10:00:37", "11:00:22", ("10:01:00", "11:00:00"),
         [("10:00:37", "10:01:00"), ("11:00:00", "11:00:22")]),
        ("10:00:00", "11:00:00", ("10:00:00", "11:00:00"), []),
        ("10:00:00.000500", "10:02:00", ("10:01:00", "10:02:00"), [("10:00:00.000500", "10:01:00")]),
        ("10:00:10", "10:00:50", None, [("10:00:10", "10:00:50")]),
        ("10:00:10", "10:01:50", None, [("10:00:10", "10:01:50")]),
    ],
)
def test_split_range(since, until, interior, edges):
    split = split_range(at(since), at(until))
    assert split.interior == (interior and tuple(map(at, interior)))
    assert split.edges == [tuple(map(at, edge)) for edge in edges]


@pytest.fixture(scope="module")
def month(spark):
    """Logs with many rows at and around minute borders, also before 1970."""
    i = F.col("id")
    start = F.when(i % 3 == 0, -90_000_000_000).otherwise(1_704_067_200_000_000)
    micros = start + (i * 7_919_000_017) % 172_800_000_000
    micros = F.when(i % 5 == 0, F.floor(micros / 60_000_000) * 60_000_000 + i % 3).otherwise(micros)
    logs = spark.range(4000).select(
        F.timestamp_micros(micros.cast("long")).alias("timestamp"),
        F.concat(F.lit("s"), i % 4).alias("service"),
        F.when(i % 2 == 0, "info").otherwise("error").alias("level"),
    ).cache()
    halves = minute_rollup(logs.filter(F.col("level") == "info")).unionByName(minute_rollup(logs))
    deltas = halves.unionByName(minute_rollup(logs.filter(F.col("level") == "info")).withColumn("count", -F.col("count")))
    return logs, minute_rollup(logs).cache(), deltas.cache()


@pytest.mark.parametrize("seed", range(12))
def test_rollup_path_equals_raw_path(month, seed):
    logs, rollups, deltas = month
    rng = random.Random(seed)
    base = rng.choice([datetime(1969, 12, 30, 20, tzinfo=UTC), datetime(2024, 1, 1, tzinfo=UTC)])
    offsets = [rng.randrange(0, 172_800_000_000) for _ in range(2)]
    if seed % 3 == 0:
        offsets = [o // 60_000_000 * 60_000_000 for o in offsets]
    if seed % 4 == 0:
        offsets[1] = offsets[0] + rng.randrange(1, 60_000_000)
    since, until = (base + timedelta(microseconds=o) for o in sorted(offsets))
    query = AggregateQuery(
        since, until + timedelta(microseconds=1), rng.choice(["1m", "5m", "1h", "1d"]),
        rng.choice([None, "service", "level"]),
        service=rng.choice([None, "s1"]), level=rng.choice([None, "error"]),
    )
    raw = [tuple(r) for r in aggregate_raw(logs, query).collect()]
    assert [tuple(r) for r in aggregate_rollup(rollups, logs, query).collect()] == raw
    if query.level is None:
        summed = [tuple(r) for r in aggregate_rollup(deltas, logs, query).collect()]
        assert [r for r in summed if r[2]] == raw


def test_merge_adds_counts_and_refuses_negative_ones(spark, month):
    logs, rollups, deltas = month
    merged = merge_rollups(rollups.unionByName(rollups))
    assert merged.count() == rollups.count()
    assert merged.agg(F.sum("count")).first()[0] == 2 * 4000
    with pytest.raises(Exception, match="must not be negative"):
        merge_rollups(rollups.withColumn("count", -F.col("count"))).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_prunes_days_and_columns(spark, tmp_path, month):
    logs = month[0]
    wide = with_day(logs, "timestamp").withColumn("message", F.lit("m")).withColumn("attributes", F.lit("{}"))
    wide.write.partitionBy("day").parquet(str(tmp_path / "logs"))
    stored = spark.read.parquet(str(tmp_path / "logs"))
    query = AggregateQuery("2024-01-01T10:00:00Z", "2024-01-02T00:00:00Z", "1h", "level", service="s1")
    df = aggregate_raw(stored, query)
    plan = plan_of(df)
    scan = plan[plan.index("FileScan"):]
    assert "day#" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert "EqualTo(service,s1)" in scan and "GreaterThanOrEqual(timestamp" in scan
    schema = scan[scan.index("ReadSchema"):]
    assert "message" not in schema and "attributes" not in schema
    assert sum(r["count"] for r in df.collect()) == logs.filter(
        "service = 's1' AND timestamp >= '2024-01-01 10:00:00' AND timestamp < '2024-01-02'"
    ).count() > 0
