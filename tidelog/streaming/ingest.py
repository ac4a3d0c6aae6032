"""Structured Streaming ingest: requests in; logs, rollup deltas and outcomes out."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.timeutil import EPOCH, MICROSECOND, utc_day
from tidelog.operators.aggregate import minute_rollup, with_day
from tidelog.operators.layout import batch_layout, rollup_layout
from tidelog.operators.numbering import join_metadata, split_offsets
from tidelog.operators.validate import accepted_count, accepted_logs, check_requests, request_outcomes
from tidelog.sources.requests import SPLIT, read_requests
from tidelog.sources.store import LogStore, Manifest, add_batch, batch_segment

# Requests are collected for this long before they are written as one batch.
DEFAULT_INTERVAL = "10 seconds"
DEFAULT_MAX_FILES = 2_000


def start_ingest(
    store: LogStore,
    source: str,
    checkpoint: str,
    stream: str = "ingest",
    available_now: bool = False,
    interval: str = DEFAULT_INTERVAL,
    whole_files: bool = False,
    as_of: datetime | None = None,
    **limits: object,
) -> StreamingQuery:
    """Ingest new request files as they appear, or all there are and stop.

    No watermark: a log of any age is stored and counted. ``limits`` bound a
    micro-batch (``maxFilesPerTrigger``, ``maxBytesPerTrigger``); more than
    that waits in the source folder. ``as_of`` judges every batch by one moment
    instead of the one it was begun at.
    """
    usual = {} if "maxBytesPerTrigger" in limits else {"maxFilesPerTrigger": DEFAULT_MAX_FILES}
    limits = usual | limits
    requests = read_requests(store.spark, source, True, whole_files, **limits)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        requests.writeStream.queryName(stream)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(lambda batch, batch_id: ingest_batch(store, batch, batch_id, stream, as_of))
        .start()
    )


def ingest_batch(
    store: LogStore,
    requests: DataFrame,
    batch_id: int,
    stream: str = "ingest",
    as_of: datetime | None = None,
) -> Manifest | None:
    """Store one batch of requests and make it visible with one commit.

    A batch that was committed before is skipped; one that was cut off is
    written again over its own leftovers, judged by the clock it was begun with.
    Ids follow reading order and depend only on the last commit and the requests.
    ``as_of`` is the clock of the future check where none was noted.
    """
    manifest = store.manifest()
    if manifest.streams.get(stream, -1) >= batch_id:
        return None
    segment = batch_segment(stream, batch_id)
    as_of = store.clock(segment, as_of)
    requests = requests.withColumn("request_row", F.monotonically_increasing_id())
    checked = check_requests(requests, as_of).withColumn("_accepted", accepted_count())
    held = [checked.persist()]
    try:
        splits, size, total, tasks = split_offsets(checked, SPLIT, "request_row", "_accepted")
        span = Observation()
        days: dict[str, int] = {}
        if total:
            valid = accepted_logs(checked).withColumn("_at", F.monotonically_increasing_id())
            minutes = with_day(minute_rollup(valid), "bucket_start").persist()
            held.append(minutes)
            per_day = minutes.groupBy("day").agg(F.sum("count").alias("logs"))
            days = {r["day"].isoformat(): r["logs"] for r in per_day.collect()}
            if sum(days.values()) != total:
                raise RuntimeError(f"batch {segment}: {total} logs, {sum(days.values())} in the rollup")
            # Brought together by day first: a file per task and day would be very many small files.
            store.write_rollups(rollup_layout(minutes), segment)
            number = F.col("shift") + F.col("_at") - F.col("first_item")
            logs = join_metadata(valid, splits, SPLIT, size).withColumn("id", F.lit(manifest.next_id).cast("long") + number)
            logs = with_day(logs, "timestamp").observe(
                span,
                F.min(F.unix_micros("timestamp")).alias("oldest"),
                F.max(F.unix_micros("timestamp")).alias("newest"),
            )
            store.write_logs(batch_layout(logs, tasks, days), segment)
        taken_in = utc_day(as_of)
        told = Observation()
        store.write_outcomes(_outcomes(checked, splits, size).observe(told, F.count(F.lit(1)).alias("requests")), segment, taken_in)
        answered = {taken_in.isoformat(): told.get["requests"]} if size else {}
    finally:
        for frame in held:
            frame.unpersist()
    moments = [_moment(span.get[name]) for name in ("oldest", "newest")] if total else [None, None]
    return store.commit(
        replace(
            manifest,
            next_id=manifest.next_id + total,
            streams={**manifest.streams, stream: batch_id},
            logs=add_batch(manifest.logs, days, manifest.streams),
            rollups=add_batch(manifest.rollups, days, manifest.streams),
            outcomes=add_batch(manifest.outcomes, answered, manifest.streams),
        ),
        "ingest",
        segment,
        total,
        *moments,
    )


def _outcomes(checked: DataFrame, splits: DataFrame, size: int) -> DataFrame:
    """Outcome per request, named by file, split and row within the split."""
    placed = join_metadata(checked.drop("_accepted"), splits.select(*SPLIT, "first_row"), SPLIT, size)
    row = F.col("request_row") - F.col("first_row")
    name = F.concat_ws("#", "file_path", "file_block", row)
    return request_outcomes(placed.select(name.alias("request_id"), "checks"))


def _moment(micros: int) -> datetime:
    return EPOCH + micros * MICROSECOND
