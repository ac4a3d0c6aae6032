import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.operators import layout
from tidelog.operators.aggregate import merge_rollups, minute_rollup
from tidelog.operators.maintain import compact_logs, compact_rollups
from tidelog.operators.report import reconcile, throughput, visibility_lag
from tidelog.plans.params import AggregateQuery, LogQuery
from tidelog.sources.requests import read_requests
from tidelog.sources.store import LogStore
from tidelog.streaming import ingest
from tidelog.streaming.ingest import ingest_batch, start_ingest

NOW = datetime(2026, 8, 10, 12, tzinfo=timezone.utc)


def entry(number, stamp="2026-08-10T10:00:00Z", **changes):
    base = {
        "timestamp": stamp, "level": "info", "service": f"s{number % 3}",
        "message": f"m{number}", "attributes": {"n": number},
    }
    return {**base, **changes}


def write(folder, name, requests):
    os.makedirs(folder, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps({"logs": r}) for r in requests]
    path = os.path.join(folder, name)
    with open(path + ".part", "w") as out:
        out.write("\n".join(lines) + "\n")
    os.rename(path + ".part", path)


@pytest.fixture
def setup(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store")), str(tmp_path / "in"), str(tmp_path / "offsets")


def run(store, source, checkpoint, **limits):
    start_ingest(store, source, checkpoint, available_now=True, **limits).awaitTermination()


def ids(store):
    return [r["id"] for r in store.snapshot().logs().select("id").orderBy("id").collect()]


def test_twenty_requests_become_one_batch(setup):
    store, source, checkpoint = setup
    write(source, "a", [[entry(r * 50 + i) for i in range(50)] for r in range(20)])
    run(store, source, checkpoint)
    snapshot = store.snapshot()
    assert snapshot.manifest.streams == {"ingest": 0} and snapshot.manifest.version == 1
    assert [r[0] for r in snapshot.logs(segment=True).select("segment").distinct().collect()] == ["ingest-0000000000"]
    rows = snapshot.logs().orderBy("id").select("id", "message").collect()
    assert [tuple(r) for r in rows] == [(i + 1, f"m{i}") for i in range(1000)], "reading order"
    outcomes = snapshot.outcomes().collect()
    assert len(outcomes) == 20 and {(r["accepted"], r["status"]) for r in outcomes} == {(50, 200)}
    assert {r["request_id"].rsplit("#")[-1] for r in outcomes} == {str(i) for i in range(20)}


def test_micro_batches_and_late_logs(setup):
    store, source, checkpoint = setup
    for number in range(4):
        stamp = f"2026-0{8 - number}-{10 - 3 * number:02d}T10:00:59.999999Z"
        write(source, f"f{number}", [[entry(i, stamp) for i in range(30)], [5, entry(1, stamp)]])
    write(source, "old", [[entry(1, "1969-12-31T23:59:59.5Z")]])
    run(store, source, checkpoint, maxFilesPerTrigger=2)
    snapshot = store.snapshot()
    assert snapshot.manifest.streams == {"ingest": 2} and snapshot.manifest.version == 3
    assert ids(store) == list(range(1, 126))
    assert snapshot.rollups().agg(F.sum("count")).first()[0] == 125
    merged = merge_rollups(snapshot.rollups()).orderBy("bucket_start", "service").collect()
    expected = minute_rollup(snapshot.logs()).orderBy("bucket_start", "service").collect()
    assert merged == expected
    assert len(snapshot.day_rows()) == 5


def test_bad_requests_and_rejects(setup):
    store, source, checkpoint = setup
    write(source, "a", ['{"logs": [', "{}", "", [entry(1, level="x")], [5, entry(2), entry(3, service="")]])
    run(store, source, checkpoint)
    outcomes = {int(r["request_id"].rsplit("#")[-1]): r for r in store.snapshot().outcomes().collect()}
    assert [outcomes[i]["status"] for i in range(4)] == [400, 400, 400, 200]
    assert [outcomes[i]["error"] is None for i in range(4)] == [False, False, True, True]
    assert [x["index"] for x in outcomes[3]["rejected"]] == [0, 2]
    assert ids(store) == [1]


def test_a_batch_without_valid_logs(setup):
    store, source, checkpoint = setup
    write(source, "a", ["{}", [5]])
    run(store, source, checkpoint)
    snapshot = store.snapshot()
    assert snapshot.logs().count() == 0 and snapshot.outcomes().count() == 2
    assert snapshot.manifest.streams == {"ingest": 0}
    write(source, "b", [[entry(1)]])
    run(store, source, checkpoint)
    assert ids(store) == [1]


def test_replay_after_a_crash_before_the_commit(setup, monkeypatch):
    store, source, checkpoint = setup
    write(source, "a", [[entry(i) for i in range(40)]])
    run(store, source, checkpoint)
    write(source, "b", [[entry(i) for i in range(60)]])

    def crash(*args, **kwargs):
        raise OSError("disk gone")

    with monkeypatch.context() as patch:
        patch.setattr(LogStore, "commit", crash)
        with pytest.raises(Exception, match="disk gone"):
            run(store, source, checkpoint)
    assert store.snapshot().logs().count() == 40, "nothing of the failed batch shows"
    assert store.snapshot().outcomes().count() == 1
    run(store, source, checkpoint)
    assert ids(store) == list(range(1, 101))
    assert store.snapshot().rollups().agg(F.sum("count")).first()[0] == 100
    assert store.snapshot().outcomes().count() == 2


def test_replay_after_the_commit_changes_nothing(setup):
    store, source, _ = setup
    write(source, "a", [[entry(i) for i in range(40)]])
    requests = read_requests(store.spark, source)
    assert ingest_batch(store, requests, 0, as_of=NOW) is not None
    compact_logs(store)
    compact_rollups(store)
    before = store.manifest()
    assert ingest_batch(store, requests, 0, as_of=NOW) is None
    assert store.manifest() == before and ids(store) == list(range(1, 41))


def test_two_streams_have_their_own_batches(setup):
    store, source, _ = setup
    write(source, "a", [[entry(i) for i in range(5)]])
    requests = read_requests(store.spark, source)
    ingest_batch(store, requests, 0, "one", NOW)
    ingest_batch(store, requests, 0, "two", NOW)
    assert ids(store) == list(range(1, 11)), "the same body twice is two requests"


def test_ids_do_not_depend_on_how_files_are_packed(setup, spark, tmp_path):
    _, source, _ = setup
    for name in "abcde":
        write(source, name, [[entry(i, message=f"{name}{i}") for i in range(j * 30, j * 30 + 30)] for j in range(12)])
        os.utime(os.path.join(source, name), (1_700_000_000, 1_700_000_000))
    found = []
    for size in ("134217728", "30000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            store = LogStore(spark, str(tmp_path / f"store{size}"))
            ingest_batch(store, read_requests(spark, source), 0, as_of=NOW)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        rows = store.snapshot().logs().select("id", "message").orderBy("id").collect()
        found.append([tuple(r) for r in rows])
    expected = [f"{name}{i}" for name in "abcde" for i in range(360)]
    assert found[0] == list(enumerate(expected, 1))
    assert found[1] == found[0]


def test_whole_file_requests(setup):
    store, source, checkpoint = setup
    os.makedirs(source)
    for name in ("a", "b"):
        with open(os.path.join(source, name), "w") as out:
            out.write(json.dumps({"logs": [entry(1), entry(2)]}, indent=2))
    start_ingest(store, source, checkpoint, available_now=True, whole_files=True).awaitTermination()
    assert ids(store) == [1, 2, 3, 4]


def test_a_rollup_that_disagrees_stops_the_commit(setup, monkeypatch):
    store, source, _ = setup
    write(source, "a", [[entry(i) for i in range(5)]])
    monkeypatch.setattr(ingest, "minute_rollup", lambda logs: minute_rollup(logs.filter("message <> 'm1'")))
    with pytest.raises(RuntimeError, match="5 logs, 4 in the rollup"):
        ingest_batch(store, read_requests(store.spark, source), 0, as_of=NOW)
    assert store.manifest().version == 0


def test_reports_over_a_store(setup):
    store, source, _ = setup
    write(source, "a", [[entry(i) for i in range(30)]])
    ingest_batch(store, read_requests(store.spark, source), 0, as_of=NOW)
    snapshot = store.snapshot()
    status = reconcile(snapshot.logs(), snapshot.rollups()).select("status").distinct().collect()
    assert [r[0] for r in status] == ["CONSISTENT"]
    assert throughput(store.commits(), 2, 30).first()["logs_per_second"] == 15.0
    assert visibility_lag(snapshot.logs(segment=True), store.commits()).first()["logs"] == 30
    assert [r["message"] for r in snapshot.search(LogQuery(q="M29")).logs] == ["m29"]
    query = AggregateQuery("2026-08-10T00:00:00Z", "2026-08-11T00:00:00Z", "1d")
    assert [r["count"] for r in snapshot.aggregate(query).collect()] == [30]


def test_a_backlog_of_many_days_is_clustered(setup, monkeypatch):
    store, source, _ = setup
    for name in "abcd":
        stamps = [f"2026-0{1 + i % 7}-{1 + i % 28:02d}T10:00:00Z" for i in range(200)]
        write(source, name, [[entry(i, stamp, message=f"{name}{i}") for i, stamp in enumerate(stamps)]])
    monkeypatch.setattr(layout, "MAX_BATCH_FILES", 10)
    ingest_batch(store, read_requests(store.spark, source), 0, as_of=NOW)
    logs = store.snapshot().logs()
    rows = [r["message"] for r in logs.orderBy("id").select("message").collect()]
    assert rows == [f"{name}{i}" for name in "abcd" for i in range(200)]
    assert len(store.snapshot().day_rows()) == 28
    assert len(logs.inputFiles()) <= 28 + 4


def test_the_rollup_of_many_days_is_brought_together(setup):
    store, source, _ = setup
    stamps = [f"2026-0{1 + i % 7}-{1 + i % 28:02d}T{i % 24:02d}:{i % 60:02d}:00Z" for i in range(800)]
    write(source, "a", [[entry(i, stamp) for i, stamp in enumerate(stamps)]])
    ingest_batch(store, read_requests(store.spark, source), 0, as_of=NOW)
    rollups = store.snapshot().rollups()
    assert rollups.groupBy().sum("count").first()[0] == 800
    assert len(store.snapshot().day_rows()) == 28
    # A file a day, and one more for each border between tasks that falls into a day.
    assert len(rollups.inputFiles()) <= 28 + 4


def test_a_batch_done_again_is_judged_by_its_first_clock(setup, monkeypatch):
    store, source, _ = setup
    write(source, "a", [[entry(1), entry(2, "2026-08-10T12:04:00Z"), entry(3, "2026-08-10T12:06:00Z")]])
    requests = read_requests(store.spark, source)
    with monkeypatch.context() as patch:
        patch.setattr(LogStore, "commit", lambda *args, **kwargs: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            ingest_batch(store, requests, 0, as_of=NOW)
    later = NOW.replace(day=20)
    manifest = ingest_batch(store, requests, 0, as_of=later)
    assert manifest.next_id == 3, "six minutes ahead then, so not taken in now"
    assert store.snapshot().outcomes().first()["accepted"] == 2
    assert list(manifest.outcomes) == ["2026-08-10"]


def test_reading_order_over_batches(setup):
    store, source, checkpoint = setup
    for number, name in enumerate("cab"):
        write(source, name, [[entry(i, message=f"{name}{i}") for i in range(20)] for _ in range(3)])
        os.utime(os.path.join(source, name), (1_700_000_000 + 60 * number,) * 2)
    run(store, source, checkpoint, maxBytesPerTrigger=10)
    assert store.manifest().streams == {"ingest": 2}, "a batch takes one file; the others wait"
    rows = store.snapshot().logs().orderBy("id").select("message").collect()
    assert [r[0] for r in rows] == [f"{name}{i}" for name in "cab" for _ in range(3) for i in range(20)]
