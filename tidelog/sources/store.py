"""The log store: day-partitioned Parquet, made visible by one small manifest.

Rows lie in ``<table>/day=D/segment=S``: a segment holds what one batch of a stream, or
one maintenance job, wrote. A manifest version does not list segments. It says, for each
day, after which batch of each stream the day's rows are read in place, and which few
segments maintenance put there instead; the last committed batch of each stream bounds
them all. So it grows with the days kept, not with the commits, and a read lists the
folders of its days and drops by name what the version does not show. Readers resolve a
single version for all tables, so raw logs and rollups always agree. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timedelta
from functools import partial, reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import schema as S
from tidelog.functions.grams import GRAM, ROW_BITS, gram_bits, has_bit
from tidelog.functions.timeutil import MICROSECOND, UTC, format_iso, parse_iso, utc_day
from tidelog.operators.aggregate import aggregate
from tidelog.operators.search import Page, search_page
from tidelog.plans.params import AggregateQuery, LogQuery
from tidelog.sources import files

_MANIFEST_DIGITS = 12
_HISTORY = T.StructType([T.StructField("version", T.LongType()), *S.COMMIT.fields])
TABLES = ("logs", "rollups", "outcomes")
# More days than this are read by listing the table rather than each day.
MOST_DAY_PATHS = 400
# At most so many files are named as not to be opened.
MOST_SKIPPED = 50_000


def batch_segment(stream: str, batch: int) -> str:
    return f"{stream}-{batch:010d}"


@dataclass(frozen=True)
class DayView:
    """What shows of a day: batches of each stream later than ``after``, and ``extra`` segments."""

    rows: int = 0
    after: dict[str, int] = field(default_factory=dict)
    extra: list[str] = field(default_factory=list)

    def shows(self, streams: dict[str, int]) -> Column:
        """Whether the segment of a row is part of the day."""
        found = F.col("segment").isin(*self.extra) if self.extra else F.lit(False)
        for stream, last in streams.items():
            first = self.after.get(stream, -1) + 1
            if first <= last:
                inside = F.col("segment").between(batch_segment(stream, first), batch_segment(stream, last))
                found = found | (inside & (F.length("segment") == len(batch_segment(stream, last))))
        return found

    def holds(self, segment: str, streams: dict[str, int]) -> bool:
        if segment in self.extra:
            return True
        stream, _, number = segment.rpartition("-")
        known = stream in streams and len(number) == 10 and number.isdigit()
        return known and self.after.get(stream, -1) < int(number) <= streams[stream]


Days = dict[str, DayView]


def add_batch(days: Days, rows: dict[str, int], before: dict[str, int]) -> Days:
    """The days after a stream's batch; ``before``: the last batches committed before it.

    A day that is new shows nothing older: an earlier life of it may still lie in its folder.
    """
    known = {day: days.get(day, DayView(after=dict(before))) for day in rows}
    return {**days, **{day: replace(known[day], rows=known[day].rows + n) for day, n in rows.items()}}


def add_segment(days: Days, rows: dict[str, int], segment: str, streams: dict[str, int]) -> Days:
    """The days with one more segment beside what they show."""
    known = {day: days.get(day, DayView(after=dict(streams))) for day in rows}
    grown = {day: replace(v, rows=v.rows + rows[day], extra=[*v.extra, segment]) for day, v in known.items()}
    return {**days, **grown}


def put_segment(days: Days, rows: dict[str, int], segment: str, streams: dict[str, int]) -> Days:
    """The days with one segment in place of all that they show."""
    return {**days, **{day: DayView(n, dict(streams), [segment]) for day, n in rows.items()}}


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_id: int = 1
    newest: str | None = None
    streams: dict[str, int] = field(default_factory=dict)
    logs: Days = field(default_factory=dict)
    rollups: Days = field(default_factory=dict)
    outcomes: Days = field(default_factory=dict)
    commit: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def from_json(text: str) -> "Manifest":
        found = json.loads(text)
        return Manifest(**{**found, **{t: {day: DayView(**v) for day, v in found[t].items()} for t in TABLES}})


@dataclass(frozen=True)
class Snapshot:
    """One manifest version and the tables it shows."""

    store: "LogStore"
    manifest: Manifest

    def logs(
        self, since: datetime | None = None, until: datetime | None = None, segment: bool = False, q: str | None = None
    ) -> DataFrame:
        """Logs of the days that ``[since, until)`` touches; other days are not listed.

        With ``segment`` the name of the batch that wrote each row comes along. With ``q``
        files that surely hold no message with that text are left out, where
        ``index_messages`` has looked at them.
        """
        names = [*S.LOG.names, "segment"] if segment else S.LOG.names
        days = _within(self.manifest.logs, since, until)
        skip = self.store.files_without(days, q) if q and len(q) >= GRAM else []
        return self.store.read_days("logs", days, self.manifest.streams, names, skip)

    def rollups(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Minute deltas, not merged: one key may occur several times."""
        return self.store.read_days("rollups", _within(self.manifest.rollups, since, until), self.manifest.streams)

    def outcomes(self) -> DataFrame:
        """Outcomes of requests, kept under the day on which they were taken in."""
        return self.store.read_days("outcomes", self.manifest.outcomes, self.manifest.streams, S.OUTCOME.names)

    @property
    def newest(self) -> datetime | None:
        return None if self.manifest.newest is None else parse_iso(self.manifest.newest)

    def day_rows(self) -> dict[date, int]:
        """Rows per UTC day, from the manifest alone."""
        return {date.fromisoformat(day): self.manifest.logs[day].rows for day in sorted(self.manifest.logs)}

    def search(self, query: LogQuery) -> Page:
        return search_page(partial(self.logs, q=query.q), query, self.newest)

    def aggregate(self, query: AggregateQuery) -> DataFrame:
        return aggregate(partial(self.logs, q=query.q), self.rollups, query)


class LogStore:
    """Writers of the store; :meth:`snapshot` gives readers their view."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # reading

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.manifest())

    def manifest(self) -> Manifest:
        version = self._last_version()
        return Manifest.from_json(files.read_text(self.spark, self._manifest_path(version))) if version else Manifest()

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/{version:0{_MANIFEST_DIGITS}d}.json"

    def _last_version(self) -> int:
        """Found from the note the last commit left; later versions are looked up one by one.

        Without a note (a commit that was cut off before it, a first one) the folder is listed.
        """
        note = files.try_read_text(self.spark, f"{self.root}/manifest/_last")
        version = int(note) if note and note.isdigit() else 0
        if not version or not files.exists(self.spark, self._manifest_path(version)):
            version = max((int(name[:-5]) for name, _ in self._manifest_files()), default=0)
        while version and files.exists(self.spark, self._manifest_path(version + 1)):
            version += 1
        return version

    def commits(self) -> DataFrame:
        """The history of commits, one row per manifest version, those that are gone included."""
        if not self._manifest_files():
            return self.spark.createDataFrame([], _HISTORY)
        shape = T.StructType(
            [T.StructField("version", T.LongType()), T.StructField("commit", S.COMMIT)]
        )
        present = (
            self.spark.read.schema(shape)
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")
            .json(f"{self.root}/manifest/*.json")
            .select("version", "commit.*")
        )
        if not files.list_names(self.spark, f"{self.root}/history"):
            return present
        past = self.spark.read.schema(_HISTORY).parquet(f"{self.root}/history")
        # A vacuum that was cut off leaves versions in both places.
        return present.unionByName(past).dropDuplicates(["version"])

    def read_days(
        self, table: str, days: Days, streams: dict[str, int], names: list[str] | None = None,
        skip: list[str] | None = None,
    ) -> DataFrame:
        """The rows that show of the given days; other days are not listed, files to ``skip`` not opened."""
        shape = S.TABLES[table]
        names = names or shape.names
        if not days:
            return self.spark.createDataFrame([], T.StructType([shape[n] if n != "segment" else _SEGMENT for n in names]))
        alike: dict[str, list[str]] = {}
        for day, view in days.items():
            alike.setdefault(json.dumps([view.after, view.extra], sort_keys=True), []).append(day)
        shown = F.lit(False)
        for group in alike.values():
            shown = shown | (F.col("day").isin(*map(date.fromisoformat, group)) & days[group[0]].shows(streams))
        base = f"{self.root}/{table}"
        paths = [f"{base}/day={day}" for day in sorted(days)] if len(days) <= MOST_DAY_PATHS else [base]
        rows = self._read(table, paths).filter(shown)
        if skip:
            rows = rows.filter(~F.col("_metadata.file_name").isin(*skip))
        return rows.select(*names)

    def _read(self, table: str, paths: list[str]) -> DataFrame:
        shape = T.StructType([*(f for f in S.TABLES[table].fields if f.name != "day"), S.DAY, _SEGMENT])
        return self.spark.read.schema(shape).option("basePath", f"{self.root}/{table}").parquet(*paths)

    # the text index

    def index_messages(self, days: list[date] | None = None) -> int:
        """Note the grams of the messages of each file, for segments that compaction made.

        What a segment holds never changes, so neither does its index; segments that have
        one are left alone. Returns how many day folders were looked at.
        """
        manifest = self.manifest()
        wanted = None if days is None else {day.isoformat() for day in days}
        todo = {}
        for day, view in manifest.logs.items():
            if wanted is None or day in wanted:
                new = [s for s in view.extra if not files.exists(self.spark, f"{self.root}/grams/day={day}/segment={s}")]
                todo.update({day: DayView(extra=new)} if new else {})
        if todo:
            names = ["day", "segment", F.col("_metadata.file_name").alias("file"), F.explode(gram_bits(F.col("message"))).alias("bit")]
            bits = self.read_days("logs", todo, {}, names)
            row, at = (F.call_function(name, F.col("bit"), F.lit(ROW_BITS)) for name in ("div", "mod"))
            marked = bits.groupBy("day", "segment", "file", row.cast("int").alias("row")).agg(F.bitmap_construct_agg(at).alias("bitmap"))
            marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "segment").parquet(f"{self.root}/grams")
        return sum(len(view.extra) for view in todo.values())

    def files_without(self, days: Days, text: str) -> list[str]:
        """Files that were looked at and lack a gram of the text; ``MOST_SKIPPED`` of them at most.

        Any file that is not named may hold the text, so leaving some out costs time only.
        """
        noted = [path for day in days for path in files.find(self.spark, f"{self.root}/grams/day={day}/segment=*")] if len(days) <= MOST_DAY_PATHS else []
        if not noted:
            return []
        wanted = self.spark.sql("SELECT :text AS text", args={"text": text}).select(gram_bits(F.col("text"))).first()[0]
        if not wanted:
            return []
        shape = "file string, row int, bitmap binary, day date, segment string"
        rows = self.spark.read.schema(shape).option("basePath", f"{self.root}/grams").parquet(*noted)
        lacking = [((F.col("row") == bit // ROW_BITS) & has_bit(F.col("bitmap"), bit)).cast("int") for bit in wanted]
        held = rows.groupBy("file").agg(F.sum(reduce(add, lacking)).alias("bits")).filter(F.col("bits") < len(wanted))
        return [r["file"] for r in held.select("file").limit(MOST_SKIPPED).collect()]

    # writing

    def new_segment(self, kind: str, version: int) -> str:
        """A name of its own for what a maintenance job writes."""
        return f"{kind}-{version:0{_MANIFEST_DIGITS}d}-{uuid.uuid4().hex[:8]}"

    def clock(self, segment: str, now: datetime | None = None) -> datetime:
        """The moment a batch is judged at: the one noted when it was first begun, if it was.

        A batch that is done again after a crash then accepts the same logs and writes
        over the same folders.
        """
        path = f"{self.root}/begun/{segment}"
        note = files.try_read_text(self.spark, path)
        if note:
            return parse_iso(note)
        now = now or datetime.now(UTC)
        files.write_text(self.spark, path, format_iso(now), over=True)
        return now

    def write_logs(self, logs: DataFrame, segment: str) -> None:
        self._write(logs.select(*S.LOG.names), "logs", segment)

    def write_rollups(self, rollups: DataFrame, segment: str) -> None:
        self._write(rollups.select(*S.ROLLUP.names), "rollups", segment)

    def write_outcomes(self, outcomes: DataFrame, segment: str, day: date | None = None) -> None:
        """``day`` is the one all outcomes were taken in on, unless they say it themselves."""
        if day is not None:
            outcomes = outcomes.withColumn("day", F.lit(day))
        self._write(outcomes.select(*S.OUTCOME.names, "day"), "outcomes", segment)

    def _write(self, rows: DataFrame, table: str, segment: str) -> None:
        """Overwrites the days of the segment: doing a batch again leaves one copy of it."""
        (
            rows.withColumn("segment", F.lit(segment))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("day", "segment")
            .parquet(f"{self.root}/{table}")
        )

    def segment_rows(self, table: str, segment: str) -> dict[str, int]:
        """Logs per day of a segment as written, from its rows or its (much smaller) rollup."""
        days = files.find(self.spark, f"{self.root}/{table}/day=*/segment={segment}")
        if not days:
            return {}
        count = F.sum("count") if table == "rollups" else F.count(F.lit(1))
        rows = self._read(table, days).groupBy("day").agg(count.alias("n"))
        return {r["day"].isoformat(): r["n"] for r in rows.collect()}

    def commit(
        self,
        manifest: Manifest,
        kind: str,
        segment: str,
        rows: int,
        oldest: datetime | None = None,
        newest: datetime | None = None,
        now: datetime | None = None,
    ) -> Manifest:
        """Write the next manifest version; only now do readers see the change."""
        known = [m for m in (manifest.newest, newest and format_iso(newest)) if m is not None]
        record = {
            "kind": kind,
            "segment": segment,
            "rows": rows,
            "min_timestamp": oldest and format_iso(oldest),
            "max_timestamp": newest and format_iso(newest),
            "committed_at": format_iso(now or datetime.now(UTC)),
        }
        manifest = replace(
            manifest,
            version=manifest.version + 1,
            newest=max(known, default=None),
            commit=record,
        )
        text = json.dumps(asdict(manifest), separators=(",", ":"))
        files.write_text(self.spark, self._manifest_path(manifest.version), text)
        files.write_text(self.spark, f"{self.root}/manifest/_last", str(manifest.version), over=True)
        files.delete(self.spark, f"{self.root}/begun/{segment}")
        return manifest

    def vacuum(self, older_than: timedelta, now: datetime | None = None) -> int:
        """Delete folders no reader can see any more, and old manifest versions; their commits go to the history.

        Only what is older than ``older_than`` goes, so that a running reader
        or an unfinished write keeps its files. Returns the number of deletes.
        """
        before = int(((now or datetime.now(UTC)) - older_than).timestamp() * 1000)
        live = self.manifest()
        gone = [
            f"manifest/{name}"
            for name, changed in self._manifest_files()[:-1]
            if changed < before
        ]
        for table in (*TABLES, "grams"):
            days = live.logs if table == "grams" else getattr(live, table)
            for folder, _ in files.list_names(self.spark, f"{self.root}/{table}"):
                view = days.get(folder.removeprefix("day="))
                if not folder.startswith("day="):
                    continue
                for segment, changed in files.list_names(self.spark, f"{self.root}/{table}/{folder}"):
                    name = segment.removeprefix("segment=")
                    if changed < before and not (view and view.holds(name, live.streams)):
                        gone.append(f"{table}/{folder}/{segment}")
        versions = [int(name[9:-5]) for name in gone if name.startswith("manifest/")]
        if versions:
            past = self.commits().filter(F.col("version") <= max(versions))
            if files.list_names(self.spark, f"{self.root}/history"):
                past = past.join(self.spark.read.schema(_HISTORY).parquet(f"{self.root}/history"), "version", "left_anti")
            past.coalesce(1).write.mode("append").parquet(f"{self.root}/history")
        for path in gone:
            files.delete(self.spark, f"{self.root}/{path}")
        return len(gone)

    def _manifest_files(self) -> list[tuple[str, int]]:
        found = files.list_names(self.spark, f"{self.root}/manifest")
        return sorted(entry for entry in found if entry[0].endswith(".json"))


_SEGMENT = T.StructField("segment", T.StringType())


def _within(days: Days, since: datetime | None, until: datetime | None) -> Days:
    first = None if since is None else utc_day(since).isoformat()
    last = None if until is None else utc_day(until - MICROSECOND).isoformat()
    return {
        day: view for day, view in days.items()
        if (first is None or day >= first) and (last is None or day <= last)
    }
