"""Filters shared by search and aggregation."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.attributes import bind, object_members, scalar_text
from tidelog.functions.cursor import LogCursor
from tidelog.functions.text import contains_text
from tidelog.functions.timeutil import MICROSECOND, is_ntz, time_literal, utc_day

# A function from a time range to rows that include those in it.
Scan = Callable[[datetime | None, datetime | None], DataFrame]
# Texts that a number, an object or an array may have.
_OTHER_THAN_TEXT = re.compile(r"[-0-9{\[]")


def scan_of(logs: DataFrame | Scan) -> Scan:
    return logs if callable(logs) else (lambda since, until: logs)


def time_range(
    df: DataFrame, since: datetime | None, until: datetime | None, column: str = "timestamp"
) -> list[Column]:
    """``since <= column < until``, and the same bounds on ``day`` where there is one.

    The bounds on ``day`` let Spark skip whole partitions; a bound on the
    timestamp alone cannot do that.
    """
    ntz = is_ntz(df, column)
    found = []
    if since is not None:
        found.append(F.col(column) >= time_literal(since, ntz))
        if "day" in df.columns:
            found.append(F.col("day") >= F.lit(utc_day(since)))
    if until is not None:
        found.append(F.col(column) < time_literal(until, ntz))
        if "day" in df.columns:
            found.append(F.col("day") <= F.lit(utc_day(until - MICROSECOND)))
    return found


def equals(service: str | None, level: str | None) -> list[Column]:
    wanted = {"service": service, "level": level}
    return [F.col(name) == F.lit(value) for name, value in wanted.items() if value is not None]


def attribute_equals(df: DataFrame, attributes: Mapping[str, str]) -> list[Column]:
    """String equality on attribute texts; keys are literal names, not paths."""
    if not attributes:
        return []
    if "attr_text" in df.columns:
        return [F.try_element_at("attr_text", F.lit(k)) == F.lit(v) for k, v in attributes.items()]
    return [member_equals(F.col("attributes"), k, v) for k, v in attributes.items()]


def member_equals(json_text: Column, key: str, value: str) -> Column:
    """Whether a member of a JSON object reads as the text ``value``.

    The member is taken by a literal path, inside generated code; a key that no path
    can hold is looked up in the whole object. Only a value that may be the text of a
    number, an object or an array needs a look at the kind of the member.
    """
    path = member_path(key)
    if path is None:
        return bind(F.try_element_at(object_members(json_text), F.lit(key)), scalar_text) == F.lit(value)
    parsed = F.try_parse_json(json_text)
    if _OTHER_THAN_TEXT.match(value):
        return bind(F.try_variant_get(parsed, path, "variant"), scalar_text) == F.lit(value)
    return F.try_variant_get(parsed, path, "string") == F.lit(value)


def member_path(key: str) -> str | None:
    """A VARIANT path to the member of that literal name, if there is one."""
    if not key or "?" in key or "\\" in key:
        return None
    quote = next((q for q in ("'", '"') if q not in key), None)
    return None if quote is None else f"$[{quote}{key}{quote}]"


def before_cursor(df: DataFrame, cursor: LogCursor | None) -> list[Column]:
    """Rows after the cursor in newest-first order.

    The first condition follows from the second one; it stands alone so that
    it reaches the scan, which a disjunction over two columns hardly does.
    """
    if cursor is None:
        return []
    at = time_literal(cursor.timestamp, is_ntz(df, "timestamp"))
    found = [
        F.col("timestamp") <= at,
        (F.col("timestamp") < at)
        | ((F.col("timestamp") == at) & (F.col("id") < F.lit(cursor.id).cast("long"))),
    ]
    if "day" in df.columns:
        found.append(F.col("day") <= F.lit(utc_day(cursor.timestamp)))
    return found


def apply_filters(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.filter(reduce(and_, conditions)) if conditions else df


def matching(df: DataFrame, query) -> DataFrame:
    """Rows that pass every filter of a search or aggregation query."""
    conditions = equals(query.service, query.level)
    conditions += time_range(df, query.since, query.until)
    conditions += before_cursor(df, getattr(query, "cursor", None))
    conditions += attribute_equals(df, query.attributes)
    if query.q is not None:
        conditions.append(contains_text(F.col("message"), query.q))
    return apply_filters(df, conditions)
