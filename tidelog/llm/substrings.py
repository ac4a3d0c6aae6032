"""Removal of byte strings that occur more than once, by suffix order around anchors.

Every string of ``size`` bytes holds an anchor: of its ``ANCHOR_BYTES``-byte pieces
the one of least hash, the first of equal ones. Equal strings have equal anchors at
the same place, so matches are sought only among the surroundings of equal anchors:
the bytes that any string holding the anchor can reach (a chunk). Anchors are some
2 in ``size`` bytes, and they are all that is shuffled of the corpus.

1. Chunks met more than once are repeated throughout: counted by hash, combined
   before the shuffle.
2. Different chunks around one anchor are put in suffix order, aligned at the
   anchor, from the last byte to the first; neighbours in that order with a common
   prefix of ``size`` bytes form runs. Within a run the smaller positions in front
   of a suffix are its earlier matches (its longest previous factor reaches
   ``size``); with ``keep_first`` only suffixes with an earlier match are removed,
   else all of a run.
3. An anchor with more than ``GROUP_CHUNKS`` different chunks is never gathered: its
   strings are counted by hash, in ranges of ``RANGE`` starts first (what all strings
   of a range share, and what they cover together), one by one only in between.

Memory of a task: a batch of texts, or ``GROUP_CHUNKS`` chunks of under 2 * size bytes.

Defined results: a null text counts as empty; texts shorter than ``size`` lose
nothing; repeated rows, also of equal key, are copies of each other; a removed byte
may split a character, so what is kept is given as bytes; an empty table gives no
rows; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import by_batch, slices, stored
from tidelog.llm.neardup import mix

ANCHOR_BYTES = 64
GROUP_CHUNKS = 20_000
RANGE = 16
# Bytes of a text handled at a time.
SEGMENT = 1 << 19
# Rows sent to all tasks to be looked up by text; with more, or with more values, the join shuffles.
LOOKUP_ROWS, LOOKUP_VALUES = 200_000, 4_000_000
_PAD = 0xFF  # no byte of UTF-8
_PLACE_BITS = np.uint64((1 << 21) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _UP or len(_UP[0]) < n:
        size = max(n, 1 << 16)
        _UP[:] = [_powers(_MULTIPLIER, size), _powers(pow(_MULTIPLIER, -1, 1 << 64), size)]
    return _UP


class Hashes:
    """Hashes of any substrings of ``data``."""

    def __init__(self, data: bytes):
        up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((np.frombuffer(data, dtype=np.uint8) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts]) + (ends - starts).astype(np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of ``data``, their hashes, and the hashes of their chunks."""
    reach = size - ANCHOR_BYTES
    places, marks, chunks = [], [], []
    for start in range(0, max(0, len(data) - size + 1), SEGMENT):
        low = max(0, start - size)
        part = data[low : start + SEGMENT + 2 * size]
        h = Hashes(part)
        at = np.arange(len(part) - ANCHOR_BYTES + 1)
        pieces = h.of(at, at + ANCHOR_BYTES)
        first, last = start - low, min(start + SEGMENT, len(data) - size + 1) - low
        own = pieces[first : last + reach]
        packed = (own & ~_PLACE_BITS) | np.arange(first, first + len(own), dtype=np.uint64)
        found = np.unique(_least(packed, reach + 1) & _PLACE_BITS).astype(np.int64)
        places.append(found + low)
        marks.append(pieces[found])
        left, right = np.maximum(found - reach, 0), np.minimum(found + size, len(part))
        # How far the text goes on either side is part of the chunk.
        chunks.append(mix(h.of(left, right) ^ mix((found - left).astype(np.uint64))))
    if not places:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    place, keep = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(marks)[keep], np.concatenate(chunks)[keep]


def repeated_starts(chunks: np.ndarray, groups: np.ndarray, order: np.ndarray, size: int, keep_first: bool) -> np.ndarray:
    """For aligned chunks (rows, padded) whether the string from each start on is repeated in its group.

    ``groups``: group of each row; ``order``: rank of each row's position. The suffixes that
    begin in one column are ordered by their first byte and the order one column on.
    """
    n, width = chunks.shape
    starts = width - size + 1
    found = np.zeros((n, starts), dtype=bool)
    group = np.unique(groups, return_inverse=True)[1].astype(np.int64)
    rank = np.zeros(n, dtype=np.int64)
    for column in range(width - 1, -1, -1):
        key = (group * 256 + chunks[:, column]) * n + rank
        rows = np.argsort(key, kind="stable")
        rank[rows] = np.concatenate(([0], np.cumsum(key[rows[1:]] != key[rows[:-1]])))
        if column >= starts:
            continue
        near = np.flatnonzero((group[rows[1:]] == group[rows[:-1]]) & (chunks[rows[1:], column + size - 1] == chunks[rows[:-1], column + size - 1]))
        a, b = rows[near], rows[near + 1]
        common = (chunks[a, column : column + size] == chunks[b, column : column + size]).all(axis=1)
        near = near[common]
        if not len(near):
            continue
        joined = np.zeros(n, dtype=bool)
        joined[near + 1] = True
        run = np.cumsum(~joined)  # number of the run of each place in the order
        if keep_first:
            least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, run, order[rows])
            found[rows, column] = order[rows] > least[run]
        else:
            found[rows, column] = np.bincount(run)[run] > 1
    return found


def _spans(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def _lookup(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """Joins texts with what is wanted of them, without moving the texts if that is little."""
    state = wanted.agg(F.count("*"), F.sum(F.size("list"))).first()
    if state[0] <= LOOKUP_ROWS and (state[1] or 0) <= LOOKUP_VALUES:
        wanted = F.broadcast(wanted)
    same = docs.key.eqNullSafe(wanted.own) & (docs.mark == wanted.own_mark)
    return docs.join(wanted, same, how)


def repeats(docs: DataFrame, key: str, text: str, size: int = 400, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """``docs`` as ``key, mark, text``, and ``key, mark, start, end`` of repeated strings (overlapping, in bytes)."""
    reach = size - ANCHOR_BYTES
    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    docs = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))

    def find(batch: pa.RecordBatch) -> dict:
        out: dict = {"key": batch.column(0), "mark": batch.column(1), "place": [], "anchor": [], "chunk": []}
        for raw in batch.column(2).cast(pa.binary()):
            place, anchor, chunk = anchors(raw.as_py(), size)
            out["place"].append(place.tolist())
            out["anchor"].append(anchor.astype(np.int64))
            out["chunk"].append(chunk.astype(np.int64))
        return out

    schema = f"key {kind}, mark long, place array<long>, anchor array<long>, chunk array<long>"
    found = stored(by_batch(docs.select("key", "mark", "text"), schema, find).where(F.size("place") > 0), "anchors")
    each = found.select("key", "mark", F.explode(F.arrays_zip("place", "anchor", "chunk")).alias("a")).select("key", "mark", "a.*")
    counted = each.groupBy("anchor", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("key", "mark", "place")).alias("first"))
    groups = counted.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    chunks = stored(counted.join(groups, "anchor").select("anchor", "chunk", "n", "first", "kinds"), "chunks")

    # Chunks met more than once, throughout.
    twice = each.join(chunks.where("n > 1").select("anchor", "chunk", "first"), ["anchor", "chunk"])
    if keep_first:
        twice = twice.where(F.struct("key", "mark", "place") != F.col("first"))
    whole = twice.select("key", "mark", (F.col("place") - reach).alias("start"), (F.col("place") + size).alias("end"))

    # One of each of several different chunks, with its bytes.
    wanted = chunks.where("kinds > 1").select("first.key", "first.mark", F.struct("first.place", "anchor", "n", "kinds").alias("w"))
    wanted = stored(wanted.groupBy("key", "mark").agg(F.collect_list("w").alias("list")).select(F.col("key").alias("own"), F.col("mark").alias("own_mark"), "list"), "wanted")
    asked = _lookup(docs, wanted, "inner").dropDuplicates(["key", "mark"])

    def cut(batch: pa.RecordBatch) -> dict:
        names = ("key", "mark", "anchor", "n", "kinds", "place", "left", "content")
        out: dict[str, list] = {name: [] for name in names}
        keys, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for own, mark, raw, asked_for in zip(keys, marks, batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
            data = raw.as_py()
            for w in asked_for:
                left = min(reach, w["place"])
                values = (own, mark, w["anchor"], w["n"], w["kinds"], w["place"], left, data[w["place"] - left : w["place"] + size])
                for name, value in zip(names, values, strict=True):
                    out[name].append(value)
        return out

    cut_schema = f"key {kind}, mark long, anchor long, n long, kinds long, place long, left int, content binary"
    contents = stored(by_batch(asked.select("key", "mark", "text", "list"), cut_schema, cut), "contents")
    near = _by_suffix_order(contents.where(F.col("kinds") <= GROUP_CHUNKS), size, keep_first, kind)
    if not contents.where(F.col("kinds") > GROUP_CHUNKS).isEmpty():
        near = near.unionByName(_by_counting(contents.where(F.col("kinds") > GROUP_CHUNKS), size, keep_first, kind))
    return docs, stored(whole.unionByName(near), "repeats")


def _by_suffix_order(contents: DataFrame, size: int, keep_first: bool, kind: str) -> DataFrame:
    reach = size - ANCHOR_BYTES
    dealt = contents.repartition("anchor").sortWithinPartitions("anchor", "key", "mark", "place")
    dealt = dealt.select("anchor", "key", "mark", "place", "n", "left", "content")
    schema = f"key {kind}, mark long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        key_type = None

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            matrix = np.full((len(rows), reach + size), _PAD, dtype=np.uint8)
            for i, r in enumerate(rows):
                matrix[i, reach - r[5] : reach - r[5] + len(r[6])] = np.frombuffer(r[6], dtype=np.uint8)
            # Rows come sorted by position within a group, so their number is their rank.
            found = repeated_starts(matrix, np.array([r[0] for r in rows]), np.arange(len(rows)), size, keep_first)
            out: list[tuple] = []
            for i, r in enumerate(rows):
                if keep_first or r[4] == 1:
                    # A start is that of a string only if neither end is padding.
                    valid = slice(reach - r[5], max(0, reach - r[5] + len(r[6]) - size + 1))
                    for a, b in _spans(found[i, valid]):
                        at = r[3] - r[5]
                        out.append((r[1], r[2], at + a, at + b - 1 + size))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            return pa.record_batch([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", "mark", "start", "end"])

        for batch in slices(batches):
            key_type = batch.schema.field(1).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and len(waiting) >= GROUP_CHUNKS // 4 and row[0] != waiting[-1][0]:
                    yield solve(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield solve(waiting)

    return dealt.mapInArrow(run, schema)


def _by_counting(contents: DataFrame, size: int, keep_first: bool, kind: str) -> DataFrame:
    """The same for anchors with very many chunks: strings that hold the anchor, counted by hash."""
    reach = size - ANCHOR_BYTES

    def digest(data: bytes) -> bytes:
        return hashlib.blake2b(data, digest_size=12).digest()

    def ranges(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("row", "low", "high", "core", "cover")}
        for row, left, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            # Ranges are fixed by the anchor; texts that begin or end near it have only some of the starts.
            for begin in range(-reach, 1, RANGE):
                end = min(begin + RANGE - 1, 0)
                low, high = max(begin, -left), min(end, len(content) - left - size)
                if low > high:
                    continue
                core = digest(b"%d " % begin + content[left + end : left + begin + size])
                whole = (low, high) == (begin, end)
                cover = digest(b"%d " % begin + content[left + low : left + high + size] + (b"" if whole else b" %d" % row))
                for name, value in (("row", row), ("low", left + low), ("high", left + high), ("core", core), ("cover", cover)):
                    out[name].append(value)
        return out

    contents = stored(contents.withColumn("row", F.monotonically_increasing_id()), "hot")
    rows = stored(by_batch(contents.select("row", "left", "content"), "row long, low int, high int, core binary, cover binary", ranges), "ranges")
    cores = rows.groupBy("core").agg(F.count("*").alias("n_core")).where("n_core > 1")
    covers = rows.groupBy("cover").agg(F.count("*").alias("n_cover"), F.min("row").alias("one"))
    open_rows = stored(rows.join(cores, "core").join(covers, "cover").select("row", "low", "high", "n_cover", "one"), "open")
    place = F.col("place") - F.col("left")
    own = contents.select("row", "key", "mark", "place", "left", "content", "n")
    done = None
    if keep_first:
        fine = open_rows
    else:
        # Of ranges that are equal throughout, one is compared further, with those that differ.
        fine = open_rows.where("row = one")
        done = open_rows.where("n_cover > 1").join(own, "row").select("key", "mark", (place + F.col("low")).alias("start"), (place + F.col("high") + size).alias("end"))

    def strings(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("row", "start", "string")}
        for row, low, high, left, content in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            for at in range(low, high + 1):
                for name, value in (("row", row), ("start", at), ("string", digest(b"%d " % (at - left) + content[at : at + size]))):
                    out[name].append(value)
        return out

    single = by_batch(fine.join(own, "row").select("row", "low", "high", "left", "content"), "row long, start int, string binary", strings)
    single = stored(single.join(own.select("row", "key", "mark", "place", "left"), "row").select("key", "mark", (place + F.col("start")).alias("start"), "string"), "strings")
    met = single.groupBy("string").agg(F.count("*").alias("n"), F.min(F.struct("key", "mark", "start")).alias("first")).where("n > 1")
    again = single.join(met, "string")
    if keep_first:
        again = again.where(F.struct("key", "mark", "start") != F.col("first"))
    again = again.select("key", "mark", "start", (F.col("start") + size).alias("end"))
    return again if done is None else again.unionByName(done)


def remove_repeats(docs: DataFrame, key: str, text: str, size: int = 400, keep_first: bool = False) -> DataFrame:
    """Per row ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (removed runs) and ``kept`` (bytes)."""
    rows, found = repeats(docs, key, text, size, keep_first)
    merged = found.distinct().groupBy("key", "mark").agg(F.collect_list(F.struct("start", "end")).alias("list"))
    merged = stored(merged.select(F.col("key").alias("own"), F.col("mark").alias("own_mark"), "list"), "merged")
    kind = dict(docs.dtypes)[key].replace("bigint", "long")

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {"key": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for raw, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            data, kept, at, removed, runs = raw.as_py(), [], 0, 0, 0
            for start, end in sorted((max(0, s["start"]), min(len(data), s["end"])) for s in spans or ()):
                if end <= at and runs:
                    continue
                if start > at or not runs:
                    kept.append(data[at:start])
                    runs += 1
                    at = start
                removed += end - at
                at = end
            kept.append(data[at:])
            for name, value in (("n_bytes", len(data)), ("n_removed", removed), ("n_spans", runs), ("kept", b"".join(kept))):
                out[name].append(value)
        return out

    joined = _lookup(rows, merged, "left").select("key", "text", "list")
    return by_batch(joined, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary", work).withColumnRenamed("key", key)
