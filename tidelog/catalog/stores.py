"""Queries that go through a log store: streaming ingest, backfill, maintenance."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.catalog.counts import NOW, ROLLUP_SQL, count_sql
from tidelog.catalog.ingest import AS_OF, GOOD_REQUEST_SQL, REASON_SQL, requests
from tidelog.catalog.registry import COLUMNS_SQL, LOGS_SQL, div, event_logs, query, table
from tidelog.catalog.searches import NEWEST, RANGE_SQL, SINCE, UNTIL
from tidelog.functions.timeutil import iso_text, utc_wall_clock
from tidelog.operators.aggregate import merge_rollups
from tidelog.operators.maintain import (
    backfill,
    compact_logs,
    compact_outcomes,
    compact_rollups,
    expire,
    flatten,
    rebuild_rollups,
)
from tidelog.operators.report import reconcile, throughput, visibility_lag
from tidelog.plans.params import AggregateQuery, LogQuery
from tidelog.schema import LOG_COLUMNS
from tidelog.session import new_dir
from tidelog.sources.store import LogStore
from tidelog.sources.synth import log_requests
from tidelog.streaming.ingest import start_ingest
from tidelog.streaming.live import live_rollup

# Stores made for this session, by kind and data folder: several queries read the same one.
_STORES: dict[tuple, LogStore] = {}

# Files of requests, and so micro-batches, of the recovered store.
BATCHES = 5

STORED_SQL = LOGS_SQL.replace("props AS", "replace(props, ' ', '') AS")


def as_wall_clock(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: utc_wall_clock(df, name) for name in names})


def new_store(spark: SparkSession) -> LogStore:
    return LogStore(spark, new_dir(spark, "store"))


def shared_store(spark: SparkSession, folder: str, make) -> LogStore:
    key = (spark.sparkContext.applicationId, folder, make.__name__)
    if key not in _STORES:
        store = new_store(spark)
        make(store, folder)
        _STORES[key] = store
    return _STORES[key]


def backfilled(store: LogStore, folder: str) -> None:
    backfill(store, event_logs(store.spark, folder))


def compacted(store: LogStore, folder: str) -> None:
    """Two overlapping backfills, then one compaction of logs and of rollups."""
    logs = event_logs(store.spark, folder)
    odd = F.col("id") % 2 == 1
    backfill(store, logs.filter(odd))
    backfill(store, logs.filter(~odd))
    compact_logs(store)
    compact_rollups(store)


def indexed(store: LogStore, folder: str) -> None:
    """Compacted to more files than one a day, their messages indexed, and logs that are not."""
    logs = event_logs(store.spark, folder)
    late = F.col("id") % 10 == 3
    backfill(store, logs.filter(~late))
    compact_logs(store, rows_per_file=2_000)
    store.index_messages()
    backfill(store, logs.filter(late))


def expired(store: LogStore, folder: str) -> None:
    backfilled(store, folder)
    expire(store, NOW, 15, exact=True)


def ingested(store: LogStore, folder: str) -> None:
    """All events as ingest requests of fifty, through the streaming job."""
    spark = store.spark
    logs = event_logs(spark, folder)
    source = new_dir(spark, "requests")
    bodies = log_requests(logs, div("id", 50), F.col("id"), iso_text(logs, "timestamp", 6))
    bodies.select("body").write.text(source)
    stream = start_ingest(store, source, new_dir(spark, "offsets"), available_now=True)
    stream.awaitTermination()


class CutOffStore(LogStore):
    """A store whose driver dies once, after a batch was written and before it was committed."""

    def __init__(self, store: LogStore, batch: int) -> None:
        super().__init__(store.spark, store.root)
        self.batch = batch

    def commit(self, manifest, kind, segment, *more, **named):
        if kind == "ingest" and segment.endswith(f"-{self.batch:010d}"):
            raise ConnectionError(f"cut off before the commit of {segment}")
        return super().commit(manifest, kind, segment, *more, **named)


def recovered(store: LogStore, folder: str) -> None:
    """Faulty requests in several micro-batches; the middle one is cut off and done again.

    Between the two runs the store is compacted, as another job would.
    """
    spark = store.spark
    source, offsets = new_dir(spark, "requests"), new_dir(spark, "offsets")
    requests(spark, folder).select("body").repartition(BATCHES).write.text(source)
    # Less than any file: a batch takes one file, and the others wait in the source.
    limits = {"maxBytesPerTrigger": 1000, "as_of": AS_OF, "available_now": True}
    try:
        start_ingest(CutOffStore(store, BATCHES // 2), source, offsets, **limits).awaitTermination()
    except StreamingQueryException as error:
        if "cut off" not in str(error):
            raise
    compact_logs(store)
    compact_rollups(store)
    compact_outcomes(store)
    start_ingest(store, source, offsets, **limits).awaitTermination()


def worn(store: LogStore, folder: str) -> None:
    """Ingested, compacted, and cleared of all that is old."""
    ingested(store, folder)
    compact_logs(store)
    compact_rollups(store)
    store.vacuum(timedelta(days=-1))


@query(
    "store_throughput",
    """SELECT count(*) AS accepted, round(count(*) / 60.0, 9) AS logs_per_second,
      'MET TARGET' AS status FROM events""",
)
def store_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Logs taken in, from the commits of a store that was compacted and vacuumed since."""
    store = shared_store(spark, folder, worn)
    report = throughput(store.commits(), 60, sum(store.snapshot().day_rows().values()))
    return report.withColumn("logs_per_second", F.round("logs_per_second", 9))


@query("store_visibility", "SELECT count(*) AS logs, true AS in_order, false AS within_bound FROM events")
def store_visibility(spark: SparkSession, folder: str) -> DataFrame:
    """Lags of streamed batches, from the store alone; the events are older than any bound."""
    store = shared_store(spark, folder, ingested)
    lags = visibility_lag(store.snapshot().logs(segment=True), store.commits())
    names = ["min_lag_s", "p50_lag_s", "p95_lag_s", "p99_lag_s", "max_lag_s"]
    rising = [F.col(a) <= F.col(b) + 0.002 for a, b in zip(names, names[1:], strict=False)]
    return lags.agg(
        F.sum("logs").alias("logs"), F.bool_and(reduce(and_, rising)).alias("in_order"),
        F.bool_or("within_bound").alias("within_bound"),
    )


@query("store_next_id", "SELECT max(event_id) + 1 AS by_logs, max(event_id) + 1 AS by_manifest FROM events")
def store_next_id(spark: SparkSession, folder: str) -> DataFrame:
    """The first free id after a restart, from the logs and from the manifest."""
    snapshot = shared_store(spark, folder, backfilled).snapshot()
    return snapshot.logs().agg((F.max("id") + 1).alias("by_logs")).withColumn(
        "by_manifest", F.lit(snapshot.manifest.next_id).cast("long")
    )


@query("store_days", "SELECT CAST(ts AS DATE) AS day, count(*) AS logs FROM events GROUP BY 1")
def store_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days of the store and their rows, without reading the logs."""
    rows = shared_store(spark, folder, compacted).snapshot().day_rows()
    return spark.createDataFrame(list(rows.items()), "day date, logs long")


@query("store_logs", f"WITH {STORED_SQL} SELECT {COLUMNS_SQL} FROM logs")
def store_logs(spark: SparkSession, folder: str) -> DataFrame:
    logs = shared_store(spark, folder, backfilled).snapshot().logs()
    return as_wall_clock(logs, "timestamp").select(*LOG_COLUMNS)


@query("store_rollups", ROLLUP_SQL)
def store_rollups(spark: SparkSession, folder: str) -> DataFrame:
    rollups = merge_rollups(shared_store(spark, folder, backfilled).snapshot().rollups())
    return as_wall_clock(rollups, "bucket_start")


@query("store_flatten", f"WITH {STORED_SQL} SELECT {COLUMNS_SQL} FROM logs")
def store_flatten(spark: SparkSession, folder: str) -> DataFrame:
    path = new_dir(spark, "flat")
    flatten(shared_store(spark, folder, backfilled), path)
    return as_wall_clock(spark.read.parquet(path), "timestamp")


@query(
    "store_search",
    f"""WITH {STORED_SQL} SELECT {COLUMNS_SQL} FROM logs
      WHERE level = 'error' AND {RANGE_SQL} {NEWEST} LIMIT 1000""",
)
def store_search(spark: SparkSession, folder: str) -> DataFrame:
    """One page by newest-first slices; a page is at most 1,000 rows by contract."""
    store = shared_store(spark, folder, backfilled)
    wanted = LogQuery(level="error", since=SINCE, until=UNTIL, limit=1000)
    page = store.snapshot().search(wanted)
    logs = store.snapshot().logs()
    shown = spark.createDataFrame(page.logs, logs.select(*LOG_COLUMNS).schema)
    return as_wall_clock(shown, "timestamp")


@query(
    "store_search_text",
    f"""WITH {STORED_SQL} SELECT {COLUMNS_SQL} FROM logs
      WHERE message ILIKE '%ser 77 DID%' {NEWEST} LIMIT 1000""",
)
def store_search_text(spark: SparkSession, folder: str) -> DataFrame:
    """A page of a search by text over files whose messages were indexed."""
    snapshot = shared_store(spark, folder, indexed).snapshot()
    page = snapshot.search(LogQuery(q="ser 77 DID", limit=1000))
    shown = spark.createDataFrame(page.logs, snapshot.logs().select(*LOG_COLUMNS).schema)
    return as_wall_clock(shown, "timestamp")


@query("store_aggregate", count_sql("5m", "service", RANGE_SQL))
def store_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    wanted = AggregateQuery(SINCE, UNTIL, "5m", "service")
    counts = shared_store(spark, folder, backfilled).snapshot().aggregate(wanted)
    return as_wall_clock(counts, "bucket_start")


@query("store_aggregate_attr", count_sql("1h", "level", f"{RANGE_SQL} AND attributes::JSON ->> 'k' = '7'"))
def store_aggregate_attr(spark: SparkSession, folder: str) -> DataFrame:
    wanted = AggregateQuery(SINCE, UNTIL, "1h", "level", attributes={"k": "7"})
    counts = shared_store(spark, folder, backfilled).snapshot().aggregate(wanted)
    return as_wall_clock(counts, "bucket_start")


@query("rollup_compact", ROLLUP_SQL)
def rollup_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The compacted rollup holds one row per key as it lies in the store."""
    rollups = shared_store(spark, folder, compacted).snapshot().rollups().drop("day")
    return as_wall_clock(rollups, "bucket_start")


@query("logs_compact", f"WITH {STORED_SQL} SELECT {COLUMNS_SQL} FROM logs")
def logs_compact(spark: SparkSession, folder: str) -> DataFrame:
    logs = shared_store(spark, folder, compacted).snapshot().logs()
    return as_wall_clock(logs, "timestamp").select(*LOG_COLUMNS)


@query("rollup_rebuild", ROLLUP_SQL)
def rollup_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark)
    backfilled(store, folder)
    rebuild_rollups(store)
    return as_wall_clock(store.snapshot().rollups().drop("day"), "bucket_start")


KEPT_SQL = "timestamp >= TIMESTAMP '2024-01-16 12:00:00'"


@query("store_expired_logs", f"WITH {STORED_SQL} SELECT {COLUMNS_SQL} FROM logs WHERE {KEPT_SQL}")
def store_expired_logs(spark: SparkSession, folder: str) -> DataFrame:
    logs = shared_store(spark, folder, expired).snapshot().logs()
    return as_wall_clock(logs, "timestamp").select(*LOG_COLUMNS)


@query("store_expired_rollups", ROLLUP_SQL.replace("FROM logs", f"FROM logs WHERE {KEPT_SQL}"))
def store_expired_rollups(spark: SparkSession, folder: str) -> DataFrame:
    rollups = merge_rollups(shared_store(spark, folder, expired).snapshot().rollups())
    return as_wall_clock(rollups, "bucket_start")


@query(
    "stream_ingest_counts",
    f"""WITH {LOGS_SQL} SELECT CAST(timestamp AS DATE) AS day, service, level, count(*) AS logs
      FROM logs GROUP BY 1, 2, 3""",
)
def stream_ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    logs = shared_store(spark, folder, ingested).snapshot().logs()
    return logs.groupBy("day", "service", "level").agg(F.count(F.lit(1)).alias("logs"))


@query(
    "stream_ingest_logs",
    f"WITH {STORED_SQL} SELECT {COLUMNS_SQL.replace('id, ', '')} FROM logs",
)
def stream_ingest_logs(spark: SparkSession, folder: str) -> DataFrame:
    logs = shared_store(spark, folder, ingested).snapshot().logs()
    return as_wall_clock(logs, "timestamp").select(*LOG_COLUMNS[1:])


@query(
    "stream_ingest_ids",
    "SELECT count(*) AS logs, count(*) AS ids, CAST(1 AS BIGINT) AS first, count(*) AS last FROM events",
)
def stream_ingest_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids are unique and have no gap: as many ids as rows, from 1 to that number."""
    logs = shared_store(spark, folder, ingested).snapshot().logs()
    per_id = logs.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    return per_id.agg(
        F.sum("rows").alias("logs"), F.count(F.lit(1)).alias("ids"),
        F.min("id").alias("first"), F.max("id").alias("last"),
    )


@query("stream_rollup_late", ROLLUP_SQL)
def stream_rollup_late(spark: SparkSession, folder: str) -> DataFrame:
    """A month of logs arrives in no order of time; none is too late to count."""
    rollups = merge_rollups(shared_store(spark, folder, ingested).snapshot().rollups())
    return as_wall_clock(rollups, "bucket_start")


@query(
    "stream_outcomes",
    """SELECT accepted, status, '[]' AS rejected, count(*) AS requests FROM (
      SELECT event_id // 50 AS request, count(*) AS accepted, CAST(200 AS INTEGER) AS status
      FROM events GROUP BY 1) GROUP BY 1, 2""",
)
def stream_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = shared_store(spark, folder, ingested).snapshot().outcomes()
    return outcomes.groupBy("accepted", "status", F.to_json("rejected").alias("rejected")).agg(
        F.count(F.lit(1)).alias("requests")
    )


TAKEN_IN_SQL = f"""{LOGS_SQL}, checked AS (
      SELECT logs.*, {GOOD_REQUEST_SQL} AS good, {REASON_SQL} AS reason FROM logs),
    taken AS (SELECT *, CASE WHEN id % 20 = 0 THEN TIMESTAMP '2024-02-15 00:05:00' ELSE timestamp END AS moment
              FROM checked WHERE good AND reason IS NULL)"""


@query(
    "recovery_logs",
    f"""WITH {TAKEN_IN_SQL} SELECT moment AS timestamp, level, service, message,
      CASE WHEN id % 10 = 9 THEN '{{}}' ELSE replace(attributes, ' ', '') END AS attributes FROM taken""",
)
def recovery_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Every accepted log once, after a batch was cut off and done again."""
    logs = shared_store(spark, folder, recovered).snapshot().logs()
    return as_wall_clock(logs, "timestamp").select(*LOG_COLUMNS[1:])


@query(
    "recovery_outcomes",
    f"""WITH {TAKEN_IN_SQL}, answers AS (
      SELECT id // 50 AS request, count(*) FILTER (good AND reason IS NULL) AS accepted,
        CAST(coalesce(to_json(list({{'index': id % 50, 'reason': reason}} ORDER BY id)
          FILTER (good AND reason IS NOT NULL)), '[]') AS VARCHAR) AS rejected,
        CASE WHEN NOT bool_or(good) THEN 'request body must contain a non-empty logs array' END AS error
      FROM checked GROUP BY 1)
    SELECT accepted, CAST(CASE WHEN accepted > 0 THEN 200 ELSE 400 END AS INTEGER) AS status,
      rejected, error, count(*) AS requests FROM answers GROUP BY ALL""",
)
def recovery_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of accepted, mixed, rejected and broken requests, one for each."""
    outcomes = shared_store(spark, folder, recovered).snapshot().outcomes()
    return outcomes.groupBy("accepted", "status", F.to_json("rejected").alias("rejected"), "error").agg(
        F.count(F.lit(1)).alias("requests")
    )


@query(
    "recovery_rollups",
    f"""WITH {TAKEN_IN_SQL} SELECT date_trunc('minute', moment) AS bucket_start, service, level, count(*) AS count
      FROM taken GROUP BY 1, 2, 3""",
)
def recovery_rollups(spark: SparkSession, folder: str) -> DataFrame:
    rollups = merge_rollups(shared_store(spark, folder, recovered).snapshot().rollups())
    return as_wall_clock(rollups, "bucket_start")


@query(
    "recovery_ids",
    f"""WITH {TAKEN_IN_SQL} SELECT count(*) AS logs, count(*) AS ids, CAST(1 AS BIGINT) AS first,
      count(*) AS last, CAST({BATCHES} AS BIGINT) AS batches, true AS in_order FROM taken""",
)
def recovery_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids have no gap; the batches were committed in order, each of them once."""
    store = shared_store(spark, folder, recovered)
    spans = store.commits().filter("kind = 'ingest'").select("segment", "version", "rows")
    ids = store.snapshot().logs().agg(
        F.count("id").alias("logs"), F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last")
    )
    in_order = F.bool_and(F.col("segment") == F.concat(F.lit("ingest-"), F.lpad((F.col("place") - 1).cast("string"), 10, "0")))
    placed = spans.withColumn("place", F.row_number().over(Window.orderBy("version")))
    batches = placed.agg(F.count(F.lit(1)).alias("batches"), in_order.alias("in_order"))
    return ids.join(F.broadcast(batches))


@query("live_rollup", ROLLUP_SQL)
def live_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Stateful counts over the events as a stream, complete result per batch."""
    events = table(spark, folder, "events")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    path = new_dir(spark, "live")
    running = (
        live_rollup(event_logs(spark, folder, stream))
        .writeStream.outputMode("complete")
        .option("checkpointLocation", new_dir(spark, "offsets"))
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(path)


@query(
    "reconcile",
    f"""WITH {LOGS_SQL} SELECT service, count(*) AS accepted, count(*) AS persisted,
      'CONSISTENT' AS status FROM logs GROUP BY 1""",
)
def reconcile_store(spark: SparkSession, folder: str) -> DataFrame:
    """What was sent against what the store counts, from its rollup."""
    stored = shared_store(spark, folder, ingested).snapshot().rollups()
    return reconcile(event_logs(spark, folder), stored)
