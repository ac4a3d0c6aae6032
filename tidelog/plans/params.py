"""Typed query parameters; building one checks the whole argument contract."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime

from tidelog.functions.cursor import LogCursor, decode_cursor
from tidelog.functions.timeutil import UTC, parse_iso
from tidelog.schema import BUCKETS, DEFAULT_LIMIT, DEFAULT_RETENTION_DAYS, GROUPS, LEVELS, MAX_LIMIT

_ATTRIBUTE_PREFIX = "attr."


@dataclass(frozen=True)
class LogQuery:
    """Filters and page position of a newest-first search."""

    service: str | None = None
    level: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    q: str | None = None
    limit: int = DEFAULT_LIMIT
    cursor: LogCursor | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if isinstance(self.cursor, str):
            object.__setattr__(self, "cursor", decode_cursor(self.cursor))
        _check_filters(self)
        for name in ("since", "until"):
            object.__setattr__(self, name, _moment(getattr(self, name), name))
        if self.since is not None and self.until is not None:
            _check_range(self.since, self.until)
        if not isinstance(self.limit, int) or isinstance(self.limit, bool):
            raise ValueError("limit must be numeric")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")


@dataclass(frozen=True)
class AggregateQuery:
    """Range, bucket width, grouping and filters of a time-bucket count."""

    since: datetime
    until: datetime
    bucket: str
    group_by: str | None = None
    service: str | None = None
    level: str | None = None
    q: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("since", "until", "bucket"):
            if getattr(self, name) is None:
                raise ValueError(f"{name} is required")
        for name in ("since", "until"):
            object.__setattr__(self, name, _moment(getattr(self, name), name))
        _check_range(self.since, self.until)
        if self.bucket not in BUCKETS:
            raise ValueError("invalid bucket")
        _check_filters(self)
        _check_string(self.group_by, "group_by")
        if self.group_by is not None and self.group_by not in GROUPS:
            raise ValueError("invalid group_by")


def parse_log_query(raw: Mapping[str, object]) -> LogQuery:
    """Search parameters as they come from a query string."""
    attributes = _attributes(raw)
    names = ("service", "level", "since", "until", "q", "cursor")
    for name in names:
        _check_string(raw.get(name), name)
    query = LogQuery(attributes=attributes, **{name: raw.get(name) for name in names})
    limit = raw.get("limit")
    return query if limit is None else replace(query, limit=_number(limit))


def parse_aggregate_query(raw: Mapping[str, object]) -> AggregateQuery:
    """Aggregation parameters as they come from a query string."""
    for name in ("since", "until", "bucket"):
        if not isinstance(raw.get(name), str):
            raise ValueError(f"{name} is required")
    names = ("since", "until", "bucket", "service", "level", "q", "group_by")
    return AggregateQuery(
        attributes=_attributes(raw), **{name: raw.get(name) for name in names}
    )


def retention_days(value: object = None) -> int:
    """Retention setting: a positive whole number of days."""
    if value is None:
        return DEFAULT_RETENTION_DAYS
    if isinstance(value, str) and re.fullmatch(r"\d+", value.strip(), re.ASCII):
        value = int(value)
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValueError("retention days must be a positive integer")
    return value


def _number(text: object) -> int:
    if not isinstance(text, str) or re.fullmatch(r"\d+", text, re.ASCII) is None:
        raise ValueError("limit must be numeric")
    # A number with more digits than any valid limit is out of range anyway.
    return int(text) if len(text.lstrip("0")) <= len(str(MAX_LIMIT)) else MAX_LIMIT + 1


def _attributes(raw: Mapping[str, object]) -> dict[str, str]:
    found = {}
    for name, value in raw.items():
        if name.startswith(_ATTRIBUTE_PREFIX):
            _check_string(value, name, required=True)
            found[name[len(_ATTRIBUTE_PREFIX):]] = value
    _check_attributes(found)
    return found


def _check_filters(query: LogQuery | AggregateQuery) -> None:
    _check_attributes(query.attributes)
    for name in ("service", "level", "q"):
        _check_string(getattr(query, name), name)
    if query.level is not None and query.level not in LEVELS:
        raise ValueError("invalid level")


def _check_attributes(attributes: Mapping[str, str]) -> None:
    for key, value in attributes.items():
        _check_string(value, f"{_ATTRIBUTE_PREFIX}{key}", required=True)
        if key == "":
            raise ValueError("attribute key must not be empty")


def _check_string(value: object, name: str, required: bool = False) -> None:
    if value is None and not required:
        return
    if not isinstance(value, str):
        raise ValueError(f"{name} must be a string")


def _check_range(since: datetime, until: datetime) -> None:
    if until <= since:
        raise ValueError("until must be later than since")


def _moment(value: object, name: str) -> datetime | None:
    if value is None:
        return None
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ValueError(f"{name} must carry a time zone")
        return value.astimezone(UTC)
    if not isinstance(value, str):
        raise ValueError(f"{name} must be a string")
    try:
        return parse_iso(value)
    except (ValueError, OverflowError):
        raise ValueError(f"invalid {name}") from None
