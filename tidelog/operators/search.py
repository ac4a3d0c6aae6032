"""Newest-first search with keyset paging."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidelog.functions.cursor import cursor_token, decode_cursor
from tidelog.functions.timeutil import MICROSECOND, UTC, whole_quotient
from tidelog.operators.filters import Scan, matching, scan_of
from tidelog.operators.numbering import counted_rows
from tidelog.plans.params import LogQuery
from tidelog.schema import LOG_COLUMNS

_FIRST = datetime.min.replace(tzinfo=UTC)
_LAST = datetime.max.replace(tzinfo=UTC)
# Lengths of the time slices a page is looked for in, newest first; after the
# last one comes everything older.
SLICES = (timedelta(hours=1), timedelta(hours=8), timedelta(days=3), timedelta(days=24))


@dataclass(frozen=True)
class Page:
    """At most ``limit`` rows and the cursor of the next page, None on the last."""

    logs: list[Row]
    next_cursor: str | None


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("id")]


def top_rows(rows: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` rows; every task keeps no more than that many."""
    return rows.select(*LOG_COLUMNS).orderBy(*newest_first()).limit(count)


def search(logs: DataFrame, query: LogQuery) -> DataFrame:
    """The rows of one page, newest first."""
    return top_rows(matching(logs, query), query.limit)


def search_page(logs: DataFrame | Scan, query: LogQuery, newest: datetime | None = None) -> Page:
    """One page and its cursor; one row more than asked tells whether there is more.

    ``logs`` is a table, or a function from a time range to the rows in it;
    ``newest`` is the latest timestamp in it, where known. All rows of a later
    time slice come before those of an earlier one, so slices are read newest
    first, each row at most once, until the page is full.
    """
    scan = scan_of(logs)
    wanted = query.limit + 1
    rows: list[Row] = []
    for since, until in time_slices(query, newest):
        part = matching(scan(since, until), replace(query, since=since, until=until))
        part = top_rows(part, wanted - len(rows))
        rows += part.withColumn("_cursor", cursor_token(part)).collect()
        if len(rows) >= wanted:
            break
    page = rows[: query.limit]
    more = page[-1]["_cursor"] if len(rows) > query.limit else None
    shown = Row(*LOG_COLUMNS)
    return Page([shown(*(row[name] for name in LOG_COLUMNS)) for row in page], more)


def search_pages(
    logs: DataFrame | Scan, query: LogQuery, newest: datetime | None = None
) -> Iterator[Page]:
    """Page after page until the cursor runs out."""
    page = search_page(logs, query, newest)
    yield page
    while page.next_cursor is not None:
        query = replace(query, cursor=decode_cursor(page.next_cursor))
        page = search_page(logs, query, newest)
        yield page


def time_slices(
    query: LogQuery, newest: datetime | None
) -> Iterator[tuple[datetime | None, datetime | None]]:
    """Disjoint ranges, newest first, that cover the range of the query."""
    latest = [m for m in (query.cursor and query.cursor.timestamp, newest) if m is not None]
    ends = [moment + MICROSECOND for moment in latest if moment < _LAST]
    ends += [] if query.until is None else [query.until]
    until = min(ends, default=None)
    oldest = _FIRST if query.since is None else query.since
    if until is not None:
        for length in SLICES:
            if until - oldest <= length:
                break
            start = until - length
            yield start, until
            until = start
    if until is None or query.since is None or query.since < until:
        yield query.since, until


def paged_export(logs: DataFrame, query: LogQuery, partitions: int | None = None) -> DataFrame:
    """All pages of a search in one distributed pass.

    Gives what walking the pages gives: every matching row with the number of
    its page, and on the last row of each page but the final one the cursor of
    the next page. No row passes through the driver.
    """
    rows = matching(logs, query).select(*LOG_COLUMNS)
    ranked, total = counted_rows(rows, newest_first(), "_rank", 0, partitions)
    ends_page = (F.col("_rank") % query.limit == query.limit - 1) & (F.col("_rank") < total - 1)
    return ranked.select(
        whole_quotient(F.col("_rank"), F.lit(query.limit)).alias("page"),
        *LOG_COLUMNS,
        F.when(ends_page, cursor_token(ranked)).alias("next_cursor"),
    )
