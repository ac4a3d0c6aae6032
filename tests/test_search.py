import json
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.functions.cursor import LogCursor
from tidelog.functions.timeutil import format_iso, parse_iso, time_literal
from tidelog.operators.search import paged_export, search, search_page, search_pages, time_slices
from tidelog.plans.params import LogQuery

UTC = timezone.utc
FIRST = datetime(2029, 11, 5, 23, 47, tzinfo=UTC)
LEVELS = ("warn", "debug", "error", "info")
# Seven logs share each moment, and the moments lie 11 minutes and a bit apart, over a midnight.
LOGS = [
    {
        "id": 900 - 3 * n,
        "timestamp": FIRST + timedelta(minutes=11, microseconds=1) * (n * n % 12),
        "level": LEVELS[n * 5 % 4],
        "service": ("ship", "dock", "Ship")[n % 3],
        "message": f"crate {n % 9} of {'Grain' if n % 4 else 'timber'}",
        "attributes": {"bay": str(n % 5), "cold": "true" if n % 2 else "false"} if n % 6 else {},
    }
    for n in range(84)
]


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def logs(spark, request):
    rows = [
        (r["id"], format_iso(r["timestamp"])[:-1], r["level"], r["service"], r["message"], json.dumps(r["attributes"]))
        for r in LOGS
    ]
    names = "id long, timestamp string, level string, service string, message string, attributes string"
    df = spark.createDataFrame(rows, names)
    return df.withColumn("timestamp", F.col("timestamp").cast(request.param)).cache()


def expected(**wanted):
    """Ids of the logs a query finds, newest first, those of one moment by falling id."""

    def fits(log):
        return (
            all(log[name] == wanted[name] for name in ("level", "service") if name in wanted)
            and wanted.get("q", "").lower() in log["message"].lower()
            and all(log["attributes"].get(k) == v for k, v in wanted.get("attributes", {}).items())
            and ("since" not in wanted or log["timestamp"] >= parse_iso(wanted["since"]))
            and ("until" not in wanted or log["timestamp"] < parse_iso(wanted["until"]))
        )

    return [log["id"] for log in sorted(LOGS, key=lambda r: (r["timestamp"], r["id"]), reverse=True) if fits(log)]


# A moment that logs have, to the microsecond, and the one after it.
SEEN = format_iso(FIRST + 4 * timedelta(minutes=11, microseconds=1))
LATER = format_iso(FIRST + 9 * timedelta(minutes=11, microseconds=1))


@pytest.mark.parametrize(
    "wanted",
    [
        {},
        {"service": "ship"},
        {"level": "error"},
        {"q": "gRAIN"},
        {"q": "5 of"},
        {"attributes": {"bay": "3"}},
        {"attributes": {"bay": "3", "cold": "true"}, "q": "crate", "level": "warn"},
        {"since": SEEN},
        {"until": SEEN},
        {"since": SEEN, "until": LATER, "service": "Ship"},
        {"level": "debug", "service": "dock", "q": "timber", "until": LATER},
    ],
)
def test_filters_and_order(logs, wanted):
    ids = expected(**wanted)
    assert [r["id"] for r in search(logs, LogQuery(**wanted, limit=1000)).collect()] == ids
    assert [r["id"] for r in search_page(logs, LogQuery(**wanted, limit=1000)).logs] == ids


@pytest.mark.parametrize("limit", [1, 5, 28, 83, 84, 85])
def test_cursors_walk_over_all_logs_once(logs, limit):
    found, query = [], LogQuery(limit=limit)
    for turn in range(3 if limit == 1 else 1000):
        page = search_page(logs, query)
        found += [r["id"] for r in page.logs]
        if page.next_cursor is None:
            assert turn == -(-len(LOGS) // limit) - 1, "a full last page is the last one"
            break
        assert len(page.logs) == limit
        query = replace(query, cursor=page.next_cursor)
    assert found == expected()[: len(found)] and len(found) >= 3


def test_a_cursor_keeps_its_filters_and_range(logs):
    wanted = {"service": "dock", "since": SEEN}
    first = search_page(logs, LogQuery(**wanted, limit=4))
    second = search_page(logs, LogQuery(**wanted, limit=1000, cursor=first.next_cursor))
    assert [r["id"] for r in first.logs + second.logs] == expected(**wanted)


@pytest.mark.parametrize(
    "wanted",
    [
        {"service": "ship\" OR \"\" = \""},
        {"service": "sh%"},
        {"q": "crate_"},
        {"q": "%"},
        {"q": "\\"},
        {"q": "'); DROP TABLE logs; --"},
        {"attributes": {"bay') IS NOT NULL OR ('": "1"}},
        {"attributes": {"$.bay": "1"}},
        {"attributes": {"bay": "1", "hold": ""}},
    ],
)
def test_no_value_is_read_as_a_pattern_or_as_code(logs, wanted):
    assert search(logs, LogQuery(**wanted)).collect() == []


def dense(spark, count, same=False):
    start = time_literal(datetime(2024, 1, 1, tzinfo=UTC))
    zero = F.lit(0)
    after = F.make_dt_interval(zero, zero, zero, (F.col("id") / 1e6).cast("decimal(18,6)"))
    return spark.range(count).select(
        "id", (start if same else start + after).alias("timestamp"), F.lit("info").alias("level"),
        F.lit("s").alias("service"), F.lit("m").alias("message"), F.lit("{}").alias("attributes"),
    )


@pytest.mark.parametrize("same", [False, True])
def test_pages_inside_one_millisecond(spark, same):
    logs = dense(spark, 5000, same).cache()
    pages = list(search_pages(logs, LogQuery(limit=700)))
    assert [r["id"] for page in pages for r in page.logs] == list(range(4999, -1, -1))
    assert len(pages) == 8


def test_export_equals_walking_the_pages(spark):
    logs = dense(spark, 3000).cache()
    query = LogQuery(limit=700, until="2024-01-01T00:00:00.002800Z")
    walked = list(search_pages(logs, query))
    exported = paged_export(logs, query).collect()
    by_page = {}
    for row in exported:
        by_page.setdefault(row["page"], []).append(row)
    assert len(by_page) == len(walked) == 4
    for number, page in enumerate(walked):
        rows = sorted(by_page[number], key=lambda r: -r["id"])
        assert [r["id"] for r in rows] == [r["id"] for r in page.logs]
        assert rows[-1]["next_cursor"] == page.next_cursor
        assert all(r["next_cursor"] is None for r in rows[:-1])


def test_slices_cover_the_range_once():
    newest = datetime(2024, 3, 1, tzinfo=UTC)
    for query in (
        LogQuery(), LogQuery(since="2024-02-28T00:00:00Z"), LogQuery(since="2020-01-01T00:00:00Z"),
        LogQuery(until="2024-02-01T00:00:00Z"), LogQuery(since="2024-04-01T00:00:00Z"),
    ):
        slices = list(time_slices(query, newest))
        for later, earlier in zip(slices, slices[1:]):
            assert later[0] == earlier[1]
        if slices:
            assert slices[-1][0] == query.since
            ends = [newest + timedelta(microseconds=1), query.until]
            assert slices[0][1] == min(end for end in ends if end is not None)


@pytest.mark.parametrize("moment", ["0001-01-01T00:00:00Z", "9999-12-31T23:59:59.999999Z"])
def test_slices_at_the_ends_of_the_calendar(moment):
    cursor = LogCursor(parse_iso(moment), 1)
    assert list(time_slices(LogQuery(cursor=cursor), None))[-1][0] is None


def test_slices_find_old_rows_too(spark):
    logs = dense(spark, 10)
    page = search_page(logs, LogQuery(limit=7), newest=datetime(2026, 1, 1, tzinfo=UTC))
    assert [r["id"] for r in page.logs] == list(range(9, 2, -1))
    rest = search_page(logs, replace(LogQuery(limit=7), cursor=None), newest=None)
    assert rest == page


def test_plan_is_a_bounded_top_k_with_pushed_filters(spark, tmp_path):
    dense(spark, 100).write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    first = search_page(logs, LogQuery(limit=10))
    query = LogQuery(service="s", limit=5, cursor=first.next_cursor, since="2024-01-01T00:00:00Z")
    plan = search(logs, query)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    pushed = plan[plan.index("PushedFilters"):plan.index("ReadSchema")]
    assert "EqualTo(service,s)" in pushed
    assert "LessThanOrEqual(timestamp" in pushed and "GreaterThanOrEqual(timestamp" in pushed
