import json
from datetime import date, datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions.attributes import bind, canonical_attributes, number_text, object_members, scalar_text
from tidelog.functions.cursor import (
    LogCursor,
    cursor_position,
    cursor_token,
    decode_cursor,
    encode_cursor,
)
from tidelog.functions.text import contains_text, like_literal
from tidelog.functions.timeutil import (
    bucket,
    ceil_minute,
    day_of,
    epoch_micros,
    floor_minute,
    format_iso,
    iso_text,
    iso_to_timestamp,
    parse_iso,
    partition_day,
    partition_name,
    time_literal,
    to_micros,
    utc_instant,
)
from tidelog.operators.filters import member_equals

UTC = timezone.utc


@given(st.datetimes(timezones=st.just(UTC)), st.integers(0, 2**63 - 1))
def test_cursor_round_trip(moment, number):
    cursor = LogCursor(moment, number)
    token = encode_cursor(cursor)
    assert "=" not in token and decode_cursor(token) == cursor


def _token(body: object) -> str:
    import base64

    text = body if isinstance(body, str) else json.dumps(body)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


STAMP = "2026-08-13T10:30:00Z"
BAD_CURSORS = [
    "not-a-valid-cursor", "", "%%%", _token("5"), _token("null"), _token("{"),
    _token({"timestamp": STAMP}), _token({"timestamp": STAMP, "id": "abc"}),
    _token({"timestamp": STAMP, "id": 42}), _token({"timestamp": "2026-08-13", "id": "42"}),
    _token({"timestamp": STAMP, "id": str(2**63)}), _token({"timestamp": STAMP, "id": "9" * 5000}),
    _token({"timestamp": STAMP, "id": "-1"}), _token({"timestamp": 5, "id": "1"}),
]


@pytest.mark.parametrize("token", BAD_CURSORS)
def test_bad_cursor(token):
    with pytest.raises(ValueError, match="^invalid cursor$"):
        decode_cursor(token)


def test_known_cursor():
    token = _token({"timestamp": STAMP, "id": "42"})
    assert decode_cursor(token) == LogCursor(datetime(2026, 8, 13, 10, 30, tzinfo=UTC), 42)


def test_cursor_columns(new_york):
    moment = datetime(2024, 3, 10, 7, 30, 0, 1, tzinfo=UTC)
    df = new_york.range(1).select(time_literal(moment).alias("timestamp"), F.lit(9).alias("id"))
    assert df.select(cursor_token(df)).first()[0] == encode_cursor(LogCursor(moment, 9))
    good = encode_cursor(LogCursor(moment, 9))
    tokens = new_york.createDataFrame([(t,) for t in [good, *BAD_CURSORS]], "t string")
    read = tokens.select(cursor_position(F.col("t")).alias("p")).select(
        F.unix_micros("p.timestamp").alias("m"), "p.id"
    )
    rows = [tuple(r) for r in read.collect()]
    assert rows[0] == (to_micros(moment), 9)
    assert set(rows[1:]) == {(None, None)}


@pytest.mark.parametrize("number", [99_999, 999_999, 9_999_999, 2**63 - 1])
def test_cursor_columns_of_long_ids_are_one_line(spark, number):
    moment = datetime(2024, 1, 30, 23, 59, 25, 261702, tzinfo=UTC)
    df = spark.createDataFrame([(moment, number)], "timestamp timestamp, id long")
    token = df.select(cursor_token(df)).first()[0]
    assert token == encode_cursor(LogCursor(moment, number))
    assert decode_cursor(token) == LogCursor(moment, number)


NUMBERS = {
    "1.0": "1", "1e2": "100", "0.1": "0.1", "1e-7": "0.0000001", "1e-13": "0.0000000000001",
    "1e21": "1000000000000000000000", "-0.0": "0", "0": "0", "-5": "-5", "1.50": "1.5",
    "0.30000000000000004": "0.30000000000000004", "12345678901234567890": "12345678901234567000",
    "1e30": "1" + "0" * 30, "-2.5e-30": "-0." + "0" * 29 + "25", "123456789.25": "123456789.25",
    "12345678.5": "12345678.5", "100": "100", "9007199254740993": "9007199254740992",
}


MEMBERS = {
    "a": "x", "b.c": "dot", "d'e": "quote", 'f"g': "double", "h'i\"j": "both", "k?": "asks", "l\\m": "back", " ": "blank", "[0]": "square", "$": "root",
    "n": 5, "o": 5.50, "p": -0.0, "q": True, "r": None, "s": {"a": "x"}, "t": [1], "u": "5", "v": "[1]", "w": '{"a":"x"}', "x": "", "": "none", "é": "ü", "y": 1e21, "z": "true",
}
WANTED = ["x", "dot", "quote", "double", "both", "asks", "back", "blank", "square", "root", "5", "5.5", "5.50", "0", "-0.0", "true", "null", '{"a":"x"}', "[1]", "", "none", "ü", "1000000000000000000000", "1.0E21", "1e21"]


def test_members_by_path_are_those_by_name(spark):
    df = spark.createDataFrame([(json.dumps(MEMBERS),)], "body string")
    by_name = lambda key: bind(F.try_element_at(object_members(F.col("body")), F.lit(key)), scalar_text)
    names = df.select(*(by_name(key).alias(f"k{i}") for i, key in enumerate(MEMBERS))).first()
    pairs = [(i, key, value) for i, key in enumerate(MEMBERS) for value in WANTED]
    found = df.select(F.array(*(member_equals(F.col("body"), key, value) for _, key, value in pairs))).first()[0]
    for (i, key, value), same in zip(pairs, found, strict=True):
        assert bool(same) == (names[i] == value), (key, value)
    assert sum(map(bool, found)) >= 20


@pytest.mark.parametrize("body", ["[1]", '"a"', "nope", "{}", None, "null", '{"b": 1}'])
def test_members_of_what_has_none(spark, body):
    df = spark.createDataFrame([(body,)], "body string")
    assert not any(df.select(member_equals(F.col("body"), "a", "x"), member_equals(F.col("body"), "a", "1")).first())


def test_attribute_texts(spark):
    members = ",".join(f'"n{i}":{text}' for i, text in enumerate(NUMBERS))
    body = "{" + members + r',"s":"x\"y\\","b":false,"a.b":"dot","q\"k":1e3,"e":""}'
    df = spark.createDataFrame([(body,)], "attributes string")
    texts = canonical_attributes(df).first()["attr_text"]
    assert {k: texts[f"n{i}"] for i, k in enumerate(NUMBERS)} == NUMBERS
    assert texts["s"] == 'x"y\\' and texts["b"] == "false" and texts["a.b"] == "dot"
    assert texts['q"k'] == "1000" and texts["e"] == ""
    written = canonical_attributes(df).first()["attributes"]
    assert '"n1":100,' in written and '"q\\"k":1000' in written
    read = json.loads(written)
    assert read["s"] == 'x"y\\' and read["b"] is False and read["n4"] == 1e-13


def test_canonical_attributes_of_odd_text(spark):
    df = spark.createDataFrame([(None,), ("[1]",), ("nope",)], "attributes string")
    rows = canonical_attributes(df).select("attributes", "attr_text").collect()
    assert [tuple(r) for r in rows] == [("{}", {}), ("[1]", None), ("nope", None)]


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text_reads_back_in_python_form(value):
    # The rule itself, applied to the shortest text Python gives.
    from decimal import Decimal

    text = format(Decimal(repr(value)), "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    assert float(text) == value


def test_number_text_column(spark):
    from decimal import Decimal

    values = [m * 10.0**e for m in (1.0, -2.5, 1.2345678) for e in range(-30, 31, 3)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for value, text in df.select("v", number_text(F.col("v"))).collect():
        assert "E" not in text and float(Decimal(text)) == value


TEXTS = ["50% off", "50 off", "a_b", "axb", "wow!", "c:\\dir", "ÉCOLE"]


@pytest.mark.parametrize(
    "q, found",
    [
        ("50%", ["50% off"]), ("A_B", ["a_b"]), ("!", ["wow!"]), ("\\", ["c:\\dir"]),
        ("", TEXTS), ("école", ["ÉCOLE"]), ("OFF", ["50% off", "50 off"]), ("' OR '1'='1", []),
    ],
)
def test_text_is_literal(spark, q, found):
    df = spark.createDataFrame([(t,) for t in TEXTS], "message string")
    rows = df.filter(contains_text(F.col("message"), q)).collect()
    assert [r.message for r in rows] == found


def test_like_literal():
    assert like_literal("a!b%c_d") == "a!!b!%c!_d"


MOMENTS = [
    datetime(2024, 3, 10, 7, 30, 0, 500000, tzinfo=UTC),
    datetime(1969, 12, 31, 23, 59, 59, 999999, tzinfo=UTC),
    datetime(1960, 2, 29, 0, 0, 0, 1, tzinfo=UTC),
    datetime(2024, 11, 3, 5, 59, 59, tzinfo=UTC),
    datetime(2024, 3, 10, 2, 30, tzinfo=UTC),
    datetime(9998, 12, 31, 23, 59, 59, 999999, tzinfo=UTC),
]
WIDTHS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}


@pytest.mark.parametrize("ntz", [False, True])
def test_time_functions_ignore_the_session_zone(new_york, ntz):
    df = new_york.range(1).select(
        F.explode(F.array(*(time_literal(m, ntz) for m in MOMENTS))).alias("t")
    )
    for width, seconds in WIDTHS.items():
        cut = df.select("t", bucket(F.col("t"), width).alias("b"))
        rows = cut.select(epoch_micros(cut, "t"), epoch_micros(cut, "b")).collect()
        size = seconds * 1_000_000
        assert [r[1] for r in rows] == [to_micros(m) // size * size for m in MOMENTS]
    shown = df.select(
        day_of(df, "t"), iso_text(df, "t", 3), iso_text(df, "t", 6),
        F.unix_micros(utc_instant(df, "t")),
    ).collect()
    for row, moment in zip(shown, MOMENTS):
        full = format_iso(moment)
        assert tuple(row) == (moment.date(), full[:23] + "Z", full, to_micros(moment))


ISO = {
    "2026-08-10T10:00:00Z": "2026-08-10T10:00:00.000000Z",
    "2026-08-10T10:00Z": "2026-08-10T10:00:00.000000Z",
    "2026-08-10T10:00:00.1Z": "2026-08-10T10:00:00.100000Z",
    "2026-08-10T10:00:00.12345678901Z": "2026-08-10T10:00:00.123456Z",
    "2026-08-10T10:00:00+05:30": "2026-08-10T04:30:00.000000Z",
    "2026-08-10T10:00-15:59": "2026-08-11T01:59:00.000000Z",
    "2028-02-29T00:00:00Z": "2028-02-29T00:00:00.000000Z",
    "2026-08-14": None, "2026-08-10T10:00:00": None, "2026-02-29T10:00:00Z": None,
    "2026-08-10T10:00:00+19:00": None, "2026-08-10T24:00:00Z": None, "0000-01-01T00:00:00Z": None,
    "2026-08-10T10:60:00Z": None, "2026-08-10t10:00:00z": None, "2026-08-10 10:00:00Z": None,
    "2026-08-10T10:00:00.Z": None, " 2026-08-10T10:00:00Z": None, "2026-08-10T10:00:00Z\n": None,
    "2026-08-10T10:00:00+0530": None, "2026-13-01T00:00:00Z": None, "x": None, "": None,
}


def test_iso_parsing_is_the_same_in_python_and_spark(new_york):
    df = new_york.createDataFrame([(t,) for t in ISO], "t string")
    read = df.select("t", iso_to_timestamp(F.col("t")).alias("m"))
    spark_side = {r[0]: r[1] for r in read.select("t", iso_text(read, "m", 6)).collect()}
    assert spark_side == ISO
    for text, expected in ISO.items():
        if expected is None:
            with pytest.raises(ValueError):
                parse_iso(text)
        else:
            assert format_iso(parse_iso(text)) == expected


@given(st.datetimes(timezones=st.just(UTC), max_value=datetime(9000, 1, 1)))
def test_minute_floor_and_ceiling(moment):
    low, high = floor_minute(moment), ceil_minute(moment)
    assert low <= moment <= high and high - low in (timedelta(0), timedelta(minutes=1))
    assert (low.second, low.microsecond, high.second, high.microsecond) == (0, 0, 0, 0)


def test_ceiling_sees_microseconds():
    moment = datetime(2026, 8, 10, 10, 0, 0, 500, tzinfo=UTC)
    assert ceil_minute(moment) == datetime(2026, 8, 10, 10, 1, tzinfo=UTC)


def test_partition_names(spark):
    df = spark.createDataFrame([(date(2024, 1, 2),)], "d date")
    assert df.select(partition_name(F.col("d"))).first()[0] == "logs_20240102"
    names = ["logs_20240102", "logs_default", "logs_2024012", "x_20240102", "logs_20241302"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    days = [r[0] for r in df.select(partition_day(F.col("n"))).collect()]
    assert days == [date(2024, 1, 2), None, None, None, None]
