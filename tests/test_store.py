from dataclasses import replace
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.grams import gram_bits
from tidelog.functions.text import contains_text
from tidelog.functions.timeutil import time_literal
from tidelog.operators.aggregate import aggregate_raw, merge_rollups, minute_rollup, with_day
from tidelog.operators.maintain import (
    backfill,
    compact_logs,
    compact_outcomes,
    compact_rollups,
    expire,
    flatten,
    next_id,
    rebuild_rollups,
)
from tidelog.operators.search import search_pages
from tidelog.plans.params import AggregateQuery, LogQuery
from tidelog.sources import files
from tidelog.sources.store import LogStore, add_batch, batch_segment

UTC = timezone.utc
START = datetime(2023, 12, 30, tzinfo=UTC)


def flat_logs(spark, count=4000, days=4, first=1):
    """Logs over four days; one service holds half of all rows."""
    i = F.col("i")
    micros = (i * 86_400_000_000 * days / count).cast("long")
    return spark.range(count).withColumnRenamed("id", "i").select(
        (i + first).alias("id"),
        F.timestamp_micros(F.unix_micros(time_literal(START)) + micros).alias("timestamp"),
        F.when(i % 5 == 0, "error").otherwise("info").alias("level"),
        F.when(i % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), i % 7)).alias("service"),
        F.concat(F.lit("message "), i).alias("message"),
        F.concat(F.lit('{"n": '), i % 10, F.lit('.0}')).alias("attributes"),
    )


@pytest.fixture
def store(spark, tmp_path):
    made = LogStore(spark, str(tmp_path / "store"))
    backfill(made, flat_logs(spark), files=3)
    return made


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def scanned_files(df):
    return df.inputFiles()


def totals(snapshot):
    """Rows per day by logs, by rollups and by the manifest."""
    logs = snapshot.logs().groupBy("day").count()
    rollups = snapshot.rollups().groupBy("day").agg(F.sum("count"))
    return dict(rows_of(logs)), dict(rows_of(rollups)), snapshot.day_rows()


def test_empty_store(spark, tmp_path):
    snapshot = LogStore(spark, str(tmp_path / "none")).snapshot()
    assert snapshot.logs().count() == snapshot.rollups().count() == snapshot.outcomes().count() == 0
    assert snapshot.search(LogQuery()).logs == [] and snapshot.newest is None
    query = AggregateQuery("2024-01-01T00:00:30Z", "2024-01-02T00:00:30Z", "1m")
    assert snapshot.aggregate(query).count() == 0
    assert snapshot.store.commits().count() == 0


def test_backfill_keeps_rows_and_ids(spark, store):
    snapshot = store.snapshot()
    plain = snapshot.logs().select("id", "timestamp", "level", "service", "message")
    assert rows_of(plain) == rows_of(flat_logs(spark).drop("attributes"))
    assert snapshot.manifest.next_id == 4001 == next_id(snapshot.logs())
    by_logs, by_rollups, by_manifest = totals(snapshot)
    assert by_logs == by_rollups == by_manifest
    assert list(by_manifest) == [date(2023, 12, 30) + timedelta(days=d) for d in range(4)]
    assert snapshot.logs().filter(F.col("attributes") == '{"n":3}').count() == 400


def test_only_the_days_of_a_range_are_read(store):
    snapshot = store.snapshot()
    since, until = datetime(2023, 12, 31, 5, tzinfo=UTC), datetime(2024, 1, 1, tzinfo=UTC)
    for table in (snapshot.logs(since, until), snapshot.rollups(since, until)):
        files = scanned_files(table)
        assert files and all("day=2023-12-31" in f for f in files)
    query = AggregateQuery("2023-12-31T10:00:30Z", "2024-01-01T10:00:30Z", "1h")
    plan = snapshot.aggregate(query)._jdf.queryExecution().executedPlan().toString()
    logs_scans = [part for part in plan.split("FileScan")[1:] if "/logs/" in part]
    assert len(logs_scans) == 2 and all("message" not in s.split("ReadSchema")[1] for s in logs_scans)


def test_store_aggregate_equals_raw(spark, store):
    query = AggregateQuery("2023-12-30T10:00:37.0005Z", "2024-01-02T11:00:22Z", "1h", "service")
    assert rows_of(store.snapshot().aggregate(query)) == rows_of(aggregate_raw(flat_logs(spark), query))
    by_attribute = AggregateQuery(
        "2023-12-30T10:00:37.0005Z", "2024-01-02T11:00:22Z", "1d", "level", attributes={"n": "3"}
    )
    assert rows_of(store.snapshot().aggregate(by_attribute)) == rows_of(
        aggregate_raw(flat_logs(spark), by_attribute)
    )


def test_store_pages(store):
    snapshot = store.snapshot()
    query = LogQuery(service="hot", limit=600, attributes={"n": "4"})
    pages = list(search_pages(snapshot.logs, query, snapshot.newest))
    ids = [r["id"] for page in pages for r in page.logs]
    assert ids == [i + 1 for i in range(3999, -1, -1) if i % 10 == 4]


def test_compaction(spark, store, tmp_path):
    backfill(store, flat_logs(spark, first=10_001), files=3)
    before = store.snapshot()
    old_logs, old_rollups = rows_of(before.logs().drop("attr_text")), rows_of(merge_rollups(before.rollups()))
    assert before.rollups().count() == 2 * len(old_rollups)
    compact_logs(store, rows_per_file=900)
    compact_rollups(store)
    after = store.snapshot()
    assert rows_of(after.logs().drop("attr_text")) == old_logs
    assert rows_of(after.rollups().drop("day")) == old_rollups
    assert rows_of(before.logs().drop("attr_text")) == old_logs, "a running reader keeps its snapshot"
    scanned = after.rollups().select(F.input_file_name().alias("f")).distinct().count()
    assert scanned <= 4 + 4, "a file per day and cut, not per task and day"
    per_file = after.logs().groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 9 and max(r["count"] for r in per_file) < 2000
    assert after.manifest.next_id == before.manifest.next_id
    by_logs, by_rollups, by_manifest = totals(after)
    assert by_logs == by_rollups == by_manifest
    removed = store.vacuum(timedelta(days=-1))
    assert removed >= 4
    assert rows_of(store.snapshot().logs().drop("attr_text")) == old_logs
    assert rows_of(store.snapshot().rollups().drop("day")) == old_rollups


def test_compaction_of_some_days(store):
    days = [date(2023, 12, 31)]
    compact_logs(store, days)
    compact_rollups(store, days)
    by_logs, by_rollups, by_manifest = totals(store.snapshot())
    assert by_logs == by_rollups == by_manifest and len(by_logs) == 4
    assert compact_logs(store, [date(1999, 1, 1)]) is None


def test_rebuild_rollups(store):
    good = rows_of(merge_rollups(store.snapshot().rollups()))
    rebuild_rollups(store, [date(2024, 1, 1)])
    assert rows_of(store.snapshot().rollups().drop("day")) == good


NOW = datetime(2024, 1, 31, 12, tzinfo=UTC)


def test_retention_by_day(store):
    expire(store, NOW, 30)
    by_logs, by_rollups, by_manifest = totals(store.snapshot())
    assert by_logs == by_rollups == by_manifest == {date(2024, 1, 1): 1000, date(2024, 1, 2): 1000}
    assert expire(store, NOW, 30) is None


def test_retention_to_the_microsecond(store):
    expire(store, NOW, 30, exact=True)
    snapshot = store.snapshot()
    by_logs, by_rollups, by_manifest = totals(snapshot)
    assert by_logs == by_rollups == by_manifest == {date(2024, 1, 1): 500, date(2024, 1, 2): 1000}
    assert snapshot.logs().agg(F.min("timestamp")).first()[0] == datetime(2024, 1, 1, 12)
    assert expire(store, NOW, 30, exact=True) is None


def test_retention_of_everything(store):
    expire(store, datetime(2030, 1, 1, tzinfo=UTC), 30, exact=True)
    snapshot = store.snapshot()
    assert snapshot.logs().count() == snapshot.rollups().count() == 0
    assert snapshot.manifest.next_id == 4001, "ids are not used again"
    store.vacuum(timedelta(days=-1))
    assert store.snapshot().logs().count() == 0


def test_vacuum_spares_what_is_young(spark, store):
    store.write_logs(store.snapshot().logs(), "unfinished")
    assert store.vacuum(timedelta(days=1)) == 0
    assert store.vacuum(timedelta(days=-1)) == 4
    assert totals(store.snapshot())[0] == store.snapshot().day_rows()


def test_flatten(store, tmp_path):
    flatten(store, str(tmp_path / "flat"))
    assert store.spark.read.parquet(str(tmp_path / "flat")).count() == 4000


def test_a_second_writer_is_noticed(store):
    stale = store.manifest()
    store.commit(stale, "one", "x", 0)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(stale, "two", "y", 0)


def test_commit_history(store):
    compact_rollups(store)
    rows = store.commits().orderBy("version").collect()
    assert [(r["version"], r["kind"], r["rows"]) for r in rows] == [
        (1, "backfill", 4000), (2, "compact_rollups", 4000),
    ]
    assert rows[0]["min_timestamp"] == datetime(2023, 12, 30)


def test_wall_clock_backfill_ignores_the_session_zone(new_york, tmp_path):
    ntz = flat_logs(new_york).withColumn("timestamp", F.lit("2024-03-10 02:30:00").cast("timestamp_ntz"))
    made = LogStore(new_york, str(tmp_path / "store"))
    backfill(made, ntz)
    snapshot = made.snapshot()
    assert snapshot.logs().select(F.unix_micros("timestamp")).distinct().collect()[0][0] == 1710037800000000
    assert snapshot.newest == datetime(2024, 3, 10, 2, 30, tzinfo=UTC)


def ingest_days(store, batch, *days):
    """A batch of a stream with one log a day, as the ingest job commits it."""
    manifest = store.manifest()
    segment = batch_segment("s", batch)
    rows = store.spark.createDataFrame(
        [(batch * 100 + i, datetime.fromisoformat(f"{day}T12:00:00"), "info", "a", f"b{batch}", "{}", {}, date.fromisoformat(day)) for i, day in enumerate(days)],
        S.LOG,
    )
    store.write_logs(rows, segment)
    store.write_rollups(with_day(minute_rollup(rows), "bucket_start"), segment)
    counts = dict.fromkeys(days, 1)
    views = [add_batch(table, counts, manifest.streams) for table in (manifest.logs, manifest.rollups)]
    return store.commit(replace(manifest, streams={**manifest.streams, "s": batch}, logs=views[0], rollups=views[1]), "ingest", segment, len(days))


def shown(store):
    return sorted((str(r["day"]), r["message"]) for r in store.snapshot().logs().collect())


@pytest.fixture
def streamed(spark, tmp_path):
    made = LogStore(spark, str(tmp_path / "streamed"))
    for batch in range(3):
        ingest_days(made, batch, "2024-05-01", f"2024-05-0{2 + batch}")
    return made


def test_batches_compactions_and_batches_again(streamed):
    everything = shown(streamed)
    assert len(everything) == 6
    old = streamed.snapshot()
    compact_logs(streamed, [date(2024, 5, 1), date(2024, 5, 3)])
    compact_rollups(streamed)
    assert shown(streamed) == everything
    ingest_days(streamed, 3, "2024-05-01", "2024-05-03")
    assert shown(streamed) == sorted([*everything, ("2024-05-01", "b3"), ("2024-05-03", "b3")])
    assert old.logs().count() == 6 and totals(streamed.snapshot())[0] == streamed.snapshot().day_rows() == totals(streamed.snapshot())[1]
    assert streamed.vacuum(timedelta(days=-1)) > 0
    assert len(shown(streamed)) == 8, "what the views show stays"
    compact_logs(streamed)
    assert len(shown(streamed)) == 8


def test_unfinished_batches_and_other_streams_do_not_show(streamed):
    rows = streamed.snapshot().logs().drop("segment")
    for segment in ("s-0000000007", "s-x", "s-00000000001", "other-0000000001", "logs-000000000002-abcdef01"):
        streamed.write_logs(rows, segment)
    assert streamed.snapshot().logs().count() == 6
    assert streamed.vacuum(timedelta(days=1)) == 0
    streamed.vacuum(timedelta(days=-1))
    assert streamed.snapshot().logs().count() == 6


def test_a_dropped_day_does_not_come_back(streamed):
    expire(streamed, datetime(2024, 6, 2, tzinfo=UTC), 30)
    assert [day for day, _ in shown(streamed)] == ["2024-05-03", "2024-05-04"]
    ingest_days(streamed, 3, "2024-05-01")
    assert shown(streamed) == [("2024-05-01", "b3"), ("2024-05-03", "b1"), ("2024-05-04", "b2")]
    streamed.vacuum(timedelta(days=-1))
    assert len(shown(streamed)) == 3


def test_commits_do_not_grow_with_their_number(streamed):
    def size():
        return len(files.read_text(streamed.spark, streamed._manifest_path(streamed.manifest().version)))

    manifest = streamed.manifest()
    for batch in range(3, 60):
        logs = add_batch(manifest.logs, {"2024-05-01": 1, "2024-05-04": 1}, manifest.streams)
        manifest = streamed.commit(replace(manifest, streams={"s": batch}, logs=logs), "ingest", batch_segment("s", batch), 2)
        if batch == 10:
            early = size()
    assert abs(size() - early) <= 12
    files.delete(streamed.spark, f"{streamed.root}/manifest/_last")
    assert streamed.manifest() == manifest, "the note of the last version is only a shortcut"
    files.write_text(streamed.spark, f"{streamed.root}/manifest/_last", "7", over=True)
    assert streamed.manifest() == manifest


def test_segments_are_pruned_by_name(streamed):
    compact_logs(streamed)
    plan = streamed.snapshot().logs()._jdf.queryExecution().executedPlan().toString()
    assert "segment" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_outcomes_lie_by_day_and_can_be_compacted(spark, streamed):
    rows = spark.createDataFrame([(f"r{i}", 1, [], 200, None) for i in range(4)], S.OUTCOME)
    manifest = streamed.manifest()
    for batch, day in ((3, "2024-05-09"), (4, "2024-05-09")):
        streamed.write_outcomes(rows, batch_segment("s", batch), date.fromisoformat(day))
        outcomes = add_batch(manifest.outcomes, {day: 4}, manifest.streams)
        manifest = streamed.commit(replace(manifest, streams={"s": batch}, outcomes=outcomes), "ingest", batch_segment("s", batch), 0)
    before = rows_of(streamed.snapshot().outcomes().drop("rejected"))
    assert len(before) == 8
    compact_outcomes(streamed)
    assert rows_of(streamed.snapshot().outcomes().drop("rejected")) == before
    assert compact_outcomes(streamed, [date(1999, 1, 1)]) is None
    expire(streamed, datetime(2024, 7, 1, tzinfo=UTC), 30)
    assert streamed.snapshot().outcomes().count() == 0


def test_both_searches_read_few_files_after_a_compaction(spark, tmp_path):
    made = LogStore(spark, str(tmp_path / "laid"))
    i = F.col("i")
    backfill(made, flat_logs(spark, 4000, 1).withColumn("i", F.col("id")).withColumn("service", F.concat(F.lit("u"), i * 7 % 16)).drop("i"))
    compact_logs(made, rows_per_file=250)
    logs = made.snapshot().logs()
    spans = logs.groupBy(F.input_file_name()).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.min("service").alias("s"), F.max("service").alias("t")).collect()
    assert len(spans) >= 12
    newest = logs.agg(F.max("timestamp")).first()[0]
    assert sum(r["b"] >= newest - timedelta(minutes=30) for r in spans) <= 6
    assert sum(r["s"] <= "u5" <= r["t"] for r in spans) <= 8


def test_text_searches_skip_files_and_find_all(spark, store):
    compact_logs(store, rows_per_file=100)
    assert store.index_messages([date(2023, 12, 31)]) == 1 and store.index_messages() == 3
    assert store.index_messages() == 0
    backfill(store, flat_logs(spark, 40, first=20_001), files=1)
    snapshot = store.snapshot()
    everything = snapshot.logs()
    files_there = everything.select(F.input_file_name()).distinct().count()
    for q, fewer in (("MESSAGE 3999", True), ("age 77", True), ("no such text", True), ("%ge", True), ("me", False), ("", False), ("İ3", False), ("İ39", True)):
        found = snapshot.logs(q=q)
        plain = contains_text(F.col("message"), q)
        assert rows_of(found.filter(plain).select("id")) == rows_of(everything.filter(plain).select("id"))
        opened = found.select(F.input_file_name()).distinct().count()
        assert (opened < files_there // 2) if fewer else opened == files_there, q
    page = snapshot.search(LogQuery(q="Message 12", limit=1000))
    assert sorted(r["id"] for r in page.logs) == sorted(r["id"] for r in everything.filter(F.ilike("message", F.lit("%message 12%"))).collect())
    counted = snapshot.aggregate(AggregateQuery("2023-12-30T00:00:00Z", "2024-01-03T00:00:00Z", "1d", q="message 39"))
    assert sum(r["count"] for r in counted.collect()) == everything.filter(F.ilike("message", F.lit("%message 39%"))).count()
    compact_logs(store)
    store.vacuum(timedelta(days=-1))
    assert files.find(spark, f"{store.root}/grams/*/*") == [], "the index goes with its segment"


@pytest.mark.parametrize("text", ["", "ab", "abc", "ABC abc", "Straße ΣΑΣ", "İstanbul", "日本語のログ", "a\nb\tc", "x" * 3000])
def test_grams_of_a_part_are_grams_of_the_whole(spark, text):
    parts = [text[i : i + n] for i in range(min(len(text), 12)) for n in (1, 3, 5)] + [text]
    df = spark.createDataFrame([(p,) for p in parts], "p string").withColumn("whole", F.lit(text))
    inside = df.filter(contains_text(F.col("whole"), text) & F.lower("whole").contains(F.lower("p")))
    missing = inside.filter(F.size(F.array_except(gram_bits(F.col("p")), gram_bits(F.col("whole")))) > 0)
    assert missing.collect() == []
