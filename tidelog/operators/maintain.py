"""Retention, compaction, rollup rebuild, backfill and export of a log store.

Each job writes new segments and commits a manifest that shows them in place of
the old ones. Running readers keep their snapshot; ``LogStore.vacuum`` removes
what nobody sees any more. One job or ingest stream at a time per store.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.attributes import canonical_attributes
from tidelog.functions.timeutil import EPOCH, MICROSECOND, UTC, utc_day, utc_instant
from tidelog.operators.aggregate import merge_rollups, minute_rollup, with_day
from tidelog.operators.filters import apply_filters, time_range
from tidelog.operators.layout import ROWS_PER_FILE, clustered, compacted_files, interleaved, read_layout, rollup_layout
from tidelog.plans.params import retention_days
from tidelog.schema import LOG_COLUMNS
from tidelog.session import partitions_for
from tidelog.sources.store import Days, DayView, LogStore, Manifest, add_segment, put_segment

def expiry_cutoff(now: datetime, days: object = None) -> datetime:
    return now.astimezone(UTC) - timedelta(days=retention_days(days))


def kept_rows(
    rows: DataFrame, now: datetime, days: object = None, exact: bool = False,
    column: str = "timestamp",
) -> DataFrame:
    """Rows that retention keeps: whole days, or to the microsecond with ``exact``."""
    cutoff = expiry_cutoff(now, days)
    if not exact:
        cutoff = datetime.combine(utc_day(cutoff), datetime.min.time(), UTC)
    return apply_filters(rows, time_range(rows, cutoff, None, column))


def expire(
    store: LogStore, now: datetime, days: object = None, exact: bool = False
) -> Manifest | None:
    """Drop expired days from logs and rollups alike, without reading a row.

    With ``exact`` the day of the cutoff is written anew without its expired
    rows, and its rollup is counted from what is left.
    """
    manifest = store.manifest()
    cutoff = expiry_cutoff(now, days)
    first = utc_day(cutoff).isoformat()
    logs, rollups, outcomes = (
        {day: view for day, view in table.items() if day >= first}
        for table in (manifest.logs, manifest.rollups, manifest.outcomes)
    )
    segment = store.new_segment("expire", manifest.version + 1)
    if exact and first in logs:
        boundary = store.read_days("logs", {first: logs[first]}, manifest.streams)
        if not apply_filters(boundary, time_range(boundary, None, cutoff)).isEmpty():
            kept = apply_filters(boundary, time_range(boundary, cutoff, None))
            files = -(-logs[first].rows // ROWS_PER_FILE)
            written = _write(store, segment, clustered(kept, read_layout(), files))
            logs, rollups = (
                put_segment({day: v for day, v in table.items() if day != first}, written, segment, manifest.streams)
                for table in (logs, rollups)
            )
    if (logs, rollups, outcomes) == (manifest.logs, manifest.rollups, manifest.outcomes):
        return None
    dropped = _count(manifest.logs) - _count(logs)
    changed = replace(manifest, logs=logs, rollups=rollups, outcomes=outcomes)
    return store.commit(changed, "expire", segment, -dropped)


def compact_logs(
    store: LogStore, days: Iterable[date] | None = None, rows_per_file: int = ROWS_PER_FILE
) -> Manifest | None:
    """Rewrite days as few sorted files, so that min and max let scans skip."""
    manifest = store.manifest()
    wanted = _wanted(manifest.logs, days)
    rows = _count(wanted)
    if rows == 0:
        return None
    segment = store.new_segment("logs", manifest.version + 1)
    old = store.read_days("logs", wanted, manifest.streams)
    files = compacted_files(rows, rows_per_file, store.spark.sparkContext.defaultParallelism)
    store.write_logs(interleaved(old, files, len(wanted)), segment)
    written = store.segment_rows("logs", segment)
    if written != {day: view.rows for day, view in wanted.items()}:
        raise RuntimeError(f"compaction read {rows} rows and wrote {sum(written.values())}")
    changed = replace(manifest, logs=put_segment(manifest.logs, written, segment, manifest.streams))
    return store.commit(changed, "compact_logs", segment, rows)


def compact_rollups(store: LogStore, days: Iterable[date] | None = None) -> Manifest | None:
    """Sum the deltas of each key to one row and show those instead."""
    manifest = store.manifest()
    wanted = _wanted(manifest.rollups, days)
    if not wanted:
        return None
    old = store.read_days("rollups", wanted, manifest.streams)
    return _replace_rollups(store, manifest, merge_rollups(old), wanted, "compact_rollups")


def compact_outcomes(store: LogStore, days: Iterable[date] | None = None) -> Manifest | None:
    """Bring the outcomes of each day together in few files."""
    manifest = store.manifest()
    wanted = _wanted(manifest.outcomes, days)
    if not wanted:
        return None
    segment = store.new_segment("outcomes", manifest.version + 1)
    old = store.read_days("outcomes", wanted, manifest.streams)
    store.write_outcomes(old.repartitionByRange("day", "request_id").sortWithinPartitions("day", "request_id"), segment)
    written = store.segment_rows("outcomes", segment)
    if written != {day: view.rows for day, view in wanted.items()}:
        raise RuntimeError(f"compaction read {_count(wanted)} outcomes and wrote {sum(written.values())}")
    changed = replace(manifest, outcomes=put_segment(manifest.outcomes, written, segment, manifest.streams))
    return store.commit(changed, "compact_outcomes", segment, _count(wanted))


def rebuild_rollups(store: LogStore, days: Iterable[date] | None = None) -> Manifest | None:
    """Count the rollup of the given days anew from the raw logs."""
    manifest = store.manifest()
    wanted = _wanted(manifest.logs, days)
    if not wanted:
        return None
    raw = store.read_days("logs", wanted, manifest.streams)
    return _replace_rollups(store, manifest, minute_rollup(raw), wanted, "rebuild_rollups")


def backfill(
    store: LogStore, flat: DataFrame, files: int | None = None, name: str = "backfill"
) -> Manifest:
    """Add a flat log table, ids kept, to the store; new ids go on above its largest."""
    manifest = store.manifest()
    segment = store.new_segment(name, manifest.version + 1)
    missing = flat.filter(F.col("timestamp").isNull()).count()
    if missing:
        raise ValueError(f"{missing} rows have no timestamp")
    rows = flat.withColumn("timestamp", utc_instant(flat, "timestamp"))
    rows = canonical_attributes(rows)
    files = files or partitions_for(flat)
    rows = clustered(with_day(rows, "timestamp"), read_layout(), files)
    days = _write(store, segment, rows)
    logs, rollups = (add_segment(table, days, segment, manifest.streams) for table in (manifest.logs, manifest.rollups))
    written = _written(store, segment, days)
    largest, oldest, newest = written.agg(
        F.max("id"), F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))
    ).first()
    changed = replace(
        manifest, logs=logs, rollups=rollups, next_id=max(manifest.next_id, (largest or 0) + 1)
    )
    span = [None if micros is None else EPOCH + micros * MICROSECOND for micros in (oldest, newest)]
    return store.commit(changed, "backfill", segment, sum(days.values()), *span)


def flatten(store: LogStore, path: str) -> None:
    """Write all logs to ``path`` as one table without day folders."""
    logs = store.snapshot().logs().select(*LOG_COLUMNS)
    logs.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def next_id(logs: DataFrame) -> int:
    """The first free id of a table, where no manifest says it."""
    return (logs.agg(F.max("id")).first()[0] or 0) + 1


def _written(store: LogStore, segment: str, days: Iterable[str]) -> DataFrame:
    """The logs of one segment, before or after it shows."""
    return store.read_days("logs", {day: DayView(extra=[segment]) for day in days}, {})


def _write(store: LogStore, segment: str, rows: DataFrame) -> dict[str, int]:
    """Write logs and their rollup, which is counted from what was written; rows per day."""
    store.write_logs(rows, segment)
    days = store.segment_rows("logs", segment)
    if days:
        minutes = minute_rollup(_written(store, segment, days))
        store.write_rollups(rollup_layout(with_day(minutes, "bucket_start")), segment)
    return days


def _replace_rollups(store: LogStore, manifest: Manifest, minutes: DataFrame, wanted: Days, kind: str) -> Manifest:
    segment = store.new_segment("rollups", manifest.version + 1)
    store.write_rollups(rollup_layout(with_day(minutes, "bucket_start")), segment)
    days = store.segment_rows("rollups", segment)
    expected = {day: manifest.logs[day].rows for day in wanted}
    if days != expected:
        raise RuntimeError(f"rollup counts {sum(days.values())} logs, the store holds {sum(expected.values())}")
    changed = replace(manifest, rollups=put_segment(manifest.rollups, days, segment, manifest.streams))
    return store.commit(changed, kind, segment, sum(days.values()))


def _wanted(table: Days, days: Iterable[date] | None) -> Days:
    chosen = None if days is None else {day.isoformat() for day in days}
    return {day: view for day, view in sorted(table.items()) if chosen is None or day in chosen}


def _count(table: Days) -> int:
    return sum(view.rows for view in table.values())
