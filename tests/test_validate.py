import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.timeutil import format_iso
from tidelog.operators.validate import (
    accepted_logs,
    check_entries,
    check_requests,
    rejected_entries,
    request_outcomes,
    split_checked,
    to_records,
    validate,
)
from tidelog.sources.requests import explode_requests, request_entries

NOW = datetime(2031, 3, 4, 10, 0, tzinfo=timezone.utc)
VALID = {
    "timestamp": format_iso(NOW), "level": "info", "service": "ledger",
    "message": "row written",
    "attributes": {"shelf": "b7", "weight": 3, "sealed": False},
}


def entry(**changes):
    return {**VALID, **changes}


def without(name):
    return {k: v for k, v in VALID.items() if k != name}


FUTURE = format_iso(NOW + timedelta(minutes=6))
EDGE = format_iso(NOW + timedelta(minutes=5))
CASES = [
    (VALID, None),
    (entry(level="fatal"), S.BAD_LEVEL),
    (entry(level=None), S.BAD_LEVEL),
    (without("level"), S.BAD_LEVEL),
    (entry(attributes={"box": {"side": 3}}), S.ATTRIBUTE_VALUE),
    (entry(attributes={"labels": ["a"]}), S.ATTRIBUTE_VALUE),
    (entry(attributes={"a": None}), S.ATTRIBUTE_VALUE),
    (entry(attributes=None), S.ATTRIBUTES_NOT_FLAT),
    (entry(attributes=[]), S.ATTRIBUTES_NOT_FLAT),
    (entry(attributes="x"), S.ATTRIBUTES_NOT_FLAT),
    (entry(attributes={}), None),
    (without("attributes"), None),
    (entry(timestamp=FUTURE), S.IN_FUTURE),
    (entry(timestamp=EDGE), None),
    (entry(timestamp="2031-03-04T10:05:00.001Z"), S.IN_FUTURE),
    (entry(timestamp="2031-03-04T10:05:00.000999Z"), None),
    (entry(timestamp="1890-01-01T00:00:00Z"), None),
    (entry(timestamp="bad-date"), S.BAD_TIMESTAMP),
    (entry(timestamp="2033-05-06"), S.BAD_TIMESTAMP),
    (entry(timestamp="2026-02-29T10:00:00Z"), S.BAD_TIMESTAMP),
    (entry(timestamp="2031-03-04T10:00:00+19:00"), S.BAD_TIMESTAMP),
    (entry(timestamp=1723284000), S.BAD_TIMESTAMP),
    (without("timestamp"), S.BAD_TIMESTAMP),
    ({}, S.BAD_TIMESTAMP),
    (entry(service=""), S.EMPTY_SERVICE),
    (entry(service=" "), None),
    (entry(service=5), S.EMPTY_SERVICE),
    (entry(message=""), S.EMPTY_MESSAGE),
    (entry(message=True), S.EMPTY_MESSAGE),
    (entry(timestamp="bad-date", level="fatal", service="", message=""), S.BAD_TIMESTAMP),
    (entry(level="fatal", service="", message=""), S.BAD_LEVEL),
    (5, S.NOT_OBJECT),
    (None, S.NOT_OBJECT),
    ([], S.NOT_OBJECT),
    ([VALID], S.NOT_OBJECT),
    ("text", S.NOT_OBJECT),
    (entry(extra={"deep": [1]}), None),
    (entry(service="5"), None),
    (entry(service="true"), None),
    (entry(service=False), S.EMPTY_SERVICE),
    (entry(service={"a": 1}), S.EMPTY_SERVICE),
    (entry(service='{"a":1}'), None),
    (entry(message=["x"]), S.EMPTY_MESSAGE),
    (entry(message="[1]"), None),
    (entry(message=-1.5), S.EMPTY_MESSAGE),
    (entry(level=5), S.BAD_LEVEL),
    (entry(timestamp=[format_iso(NOW)]), S.BAD_TIMESTAMP),
    (entry(attributes={"a": 12345678901234567890, "b": 1e300, "c": -0.0}), None),
]


def requests(spark, *bodies):
    rows = [(f"r{i}", body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "request_id string, body string")


@pytest.fixture(scope="module")
def checked(spark):
    body = json.dumps({"logs": [case for case, _ in CASES]})
    return check_entries(request_entries(requests(spark, body)), NOW).collect()


def test_first_failing_reason(checked):
    found = {row["index"]: row["reason"] for row in checked}
    assert found == {i: reason for i, (_, reason) in enumerate(CASES)}


def test_checks_inside_a_request_are_those_of_its_entries(spark):
    body = json.dumps({"logs": [case for case, _ in CASES]})
    rows = requests(spark, body, "{}", '{"logs": []}').withColumn("note", F.lit("n"))
    checked = check_requests(rows, NOW)
    valid, rejected = split_checked(check_entries(request_entries(rows), NOW))
    inside, apart = accepted_logs(checked), valid
    assert inside.columns == apart.columns and inside.dtypes == apart.dtypes
    assert inside.orderBy("index").collect() == apart.orderBy("index").collect() != []
    assert rejected_entries(checked).orderBy("index").collect() == rejected.orderBy("index").collect() != []
    assert checked.columns == ["request_id", "note", "checks"]


def test_body_is_parsed_once(spark):
    plan = accepted_logs(check_requests(requests(spark, "{}"), NOW))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_records_keep_the_type_of_a_field(spark):
    body = json.dumps({"logs": [entry(level=5, service="7"), entry(level="odd", message=True), 3]})
    found = to_records(request_entries(requests(spark, body))).orderBy("index")
    assert [tuple(r) for r in found.select("level", "service", "message").collect()] == [
        (None, "7", "row written"), ("odd", "ledger", None), (None, None, None),
    ]


def test_accepted_row_is_typed(checked):
    row = checked[0]
    assert row["timestamp"] == NOW.replace(tzinfo=None)
    assert row["attr_text"] == {"shelf": "b7", "weight": "3", "sealed": "false"}
    assert json.loads(row["attributes"]) == VALID["attributes"]
    bare = next(r for r, (case, _) in zip(checked, CASES) if case == without("attributes"))
    assert (bare["attributes"], bare["attr_text"]) == ("{}", {})


def test_partial_batch(spark):
    body = json.dumps({"logs": [VALID, entry(level="nope"), VALID]})
    entries, bad = explode_requests(requests(spark, body))
    valid, rejected = validate(entries, NOW)
    assert [r["index"] for r in valid.orderBy("index").collect()] == [0, 2]
    assert [(r["index"], r["reason"]) for r in rejected.collect()] == [(1, S.BAD_LEVEL)]
    assert bad.count() == 0


def test_request_outcomes(spark):
    both = json.dumps({"logs": [5, VALID, entry(message="")]})
    none = json.dumps({"logs": [entry(level="x"), entry(timestamp="bad", level="fatal")]})
    bodies = [both, none, "{}", '{"logs": []}', '{"logs": [', '{"logs": {}}', '[]', '{"logs": 5}']
    outcomes = request_outcomes(check_requests(requests(spark, *bodies), NOW))
    assert "Exchange" not in outcomes._jdf.queryExecution().executedPlan().toString()
    rows = {r["request_id"]: r for r in outcomes.collect()}
    assert (rows["r0"]["accepted"], rows["r0"]["status"], rows["r0"]["error"]) == (1, 200, None)
    assert [tuple(x) for x in rows["r0"]["rejected"]] == [(0, S.NOT_OBJECT), (2, S.EMPTY_MESSAGE)]
    assert (rows["r1"]["accepted"], rows["r1"]["status"]) == (0, 400)
    assert [x["reason"] for x in rows["r1"]["rejected"]] == [S.BAD_LEVEL, S.BAD_TIMESTAMP]
    for name in ("r2", "r3", "r4", "r5", "r6", "r7"):
        assert (rows[name]["status"], rows[name]["error"]) == (400, S.BAD_REQUEST)


def test_requests_of_any_size_and_repeated_keys(spark):
    """Each entry is parsed by itself, so many megabytes of them do not drop the request."""
    long = entry(message="m" * 9_000_000)
    twice = json.dumps(VALID)[:-1] + ', "level": "warn", "level": "error"}'
    body = '{"logs": [' + ",".join([json.dumps(long), json.dumps(long), json.dumps(VALID)]) + "]}"
    checked = check_entries(request_entries(requests(spark, body, f'{{"logs": [{twice}]}}')), NOW)
    found = checked.select("request_id", "index", "reason", "level").orderBy("request_id", "index").collect()
    assert [tuple(r) for r in found] == [("r0", 0, None, "info"), ("r0", 1, None, "info"), ("r0", 2, None, "info"), ("r1", 0, None, "error")]


def test_session_zone_does_not_matter(new_york):
    body = json.dumps({"logs": [entry(timestamp="2024-03-10T02:30:00.000001Z")]})
    row = check_entries(request_entries(requests(new_york, body)), NOW).selectExpr(
        "unix_micros(timestamp) AS m"
    ).first()
    assert row["m"] == 1710037800000001
