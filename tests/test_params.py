import pytest

from tidelog.plans.params import (
    AggregateQuery,
    LogQuery,
    parse_aggregate_query,
    parse_log_query,
    retention_days,
)


def test_search_defaults():
    query = parse_log_query({})
    assert (query.limit, query.service, query.cursor, query.attributes) == (100, None, None, {})


def test_search_keeps_attributes_and_limit():
    query = parse_log_query({"attr.rack": "42", "attr.region": "north", "limit": "500"})
    assert query.attributes == {"rack": "42", "region": "north"}
    assert query.limit == 500


@pytest.mark.parametrize(
    "raw, message",
    [
        ({"limit": "0"}, "limit must be between 1 and 1000"),
        ({"limit": "1001"}, "limit must be between 1 and 1000"),
        ({"limit": "9" * 5000}, "limit must be between 1 and 1000"),
        ({"limit": "abc"}, "limit must be numeric"),
        ({"limit": "-1"}, "limit must be numeric"),
        ({"limit": 5}, "limit must be numeric"),
        ({"level": "fatal"}, "invalid level"),
        ({"level": "INFO"}, "invalid level"),
        ({"since": "bad-date"}, "invalid since"),
        ({"until": "2033-05-06"}, "invalid until"),
        ({"since": "2033-05-06T10:00:00"}, "invalid since"),
        ({"service": ["a"]}, "service must be a string"),
        ({"attr.": "x"}, "attribute key must not be empty"),
        ({"attr.a": ["x"]}, "attr.a must be a string"),
        ({"cursor": "%%%"}, "invalid cursor"),
        ({"cursor": "x", "level": "fatal"}, "invalid cursor"),
        (
            {"since": "2033-05-06T10:00:00Z", "until": "2033-05-06T10:00:00Z"},
            "until must be later than since",
        ),
    ],
)
def test_search_rejects(raw, message):
    with pytest.raises(ValueError, match=f"^{message}$"):
        parse_log_query(raw)


GOOD = {"since": "2031-03-04T10:00:00Z", "until": "2031-03-04T11:00:00Z", "bucket": "1m"}


def test_aggregate_accepts():
    query = parse_aggregate_query({**GOOD, "group_by": "level", "attr.a.b": "1", "q": "x"})
    assert query.bucket == "1m" and query.attributes == {"a.b": "1"}


@pytest.mark.parametrize(
    "change, message",
    [
        ({"since": None}, "since is required"),
        ({"until": None}, "until is required"),
        ({"bucket": None}, "bucket is required"),
        ({"bucket": "10m"}, "invalid bucket"),
        ({"group_by": "message"}, "invalid group_by"),
        ({"until": "2031-03-04T09:00:00Z"}, "until must be later than since"),
        ({"since": "x"}, "invalid since"),
        ({"level": "x"}, "invalid level"),
        ({"attr.": "1"}, "attribute key must not be empty"),
        ({"q": 5}, "q must be a string"),
    ],
)
def test_aggregate_rejects(change, message):
    with pytest.raises(ValueError, match=f"^{message}$"):
        parse_aggregate_query({**GOOD, **change})


def test_typed_queries_check_too():
    with pytest.raises(ValueError):
        LogQuery(limit=1001)
    with pytest.raises(ValueError):
        AggregateQuery("2031-03-04T10:00:00Z", "2031-03-04T11:00:00Z", "2m")


def test_range_is_exact_below_a_millisecond():
    LogQuery(since="2031-03-04T10:00:00.000100Z", until="2031-03-04T10:00:00.000500Z")


def test_retention_days():
    assert retention_days() == 30 and retention_days("7") == 7
    for bad in (0, -1, "0", "x", "1.5", 1.5, True):
        with pytest.raises(ValueError):
            retention_days(bad)
