"""Near-duplicate documents by MinHash.

Each text becomes the set of its distinct word shingles (64-bit hashes) and, by
``BANDS * ROWS`` universal hash functions, as many minima. Texts with equal sets
are one class from then on. Classes that agree in a band of ``ROWS`` minima fall
into one bucket; at a similarity of 0.8 a pair shares no bucket with a probability
of 4e-7. A bucket compares its members with its first member, so it gives as many
candidates as it has members. Candidates are screened by size and by the share of
equal minima, far below the wanted similarity, then confirmed on the full sets.
Where a bucket still holds several components, members of different components are
compared too, but only those whose shared shingles allow the similarity at all.

A hot bucket or class is never gathered: minima and counts are combined before the
shuffle, and joins by bucket can be split. What remains on the driver is counts.

Defined results: a null or empty text, or one of white space, has an empty set and
is linked with nothing; a text of fewer words than a shingle is one shingle; of
rows with equal key the one first in the table is kept; null keys sort first;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import by_batch, slices, stored
from tidelog.llm.components import components

BANDS, ROWS = 80, 8
# All minima are kept, one byte each, to estimate the similarity of a candidate; an estimate
# may be this far below the wanted similarity (over six standard deviations).
SKETCH, SLACK = BANDS * ROWS, 0.1
# Members of a bucket compared with each other at a time.
BLOCK = 300
# Shingles hashed at a time, which bounds the memory for a long text.
CHUNK = 512
# Digests of candidate texts that are broadcast, 40 bytes each; with more the join shuffles.
BROADCAST_TEXTS = 200_000

_RANDOM = np.random.default_rng(20_240_817)
_A = (_RANDOM.integers(0, 1 << 32, size=(BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _RANDOM.integers(0, 1 << 32, size=(BANDS * ROWS, 1), dtype=np.uint32)
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BLOCK = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.ones(_BLOCK, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_PRIME), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash per word of ``data`` (lower-cased, parted by white space), in order."""
    parts = []
    if len(data) <= _BLOCK:
        parts = [data]
    else:  # cut between words; a word longer than a block is hashed by itself
        start = 0
        while start < len(data):
            end = start + _BLOCK
            if end < len(data):
                cut = max(data.rfind(c, start, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                end = cut + 1 if cut >= start else len(data)
                if cut < start:
                    tail = data[start:].split(None, 1)
                    end = len(data) - (len(tail[1]) if len(tail) > 1 else 0)
            parts.append(data[start:end])
            start = end
    found = []
    for part in parts:
        if len(part) > _BLOCK:
            digests = [hashlib.blake2b(w, digest_size=8).digest() for w in part.split()]
            found.append(np.frombuffer(b"".join(digests), dtype=np.uint64))
            continue
        x = np.frombuffer(part, dtype=np.uint8)
        blank = (x == 32) | ((x >= 9) & (x <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _UP[: len(x)], dtype=np.uint64)))
        found.append(mix((sums[ends] - sums[starts]) * _DOWN[starts]) + (ends - starts).astype(np.uint64))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words."""
    words = word_hashes(text.lower()) if text else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function over a set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(x), CHUNK):
        np.minimum(least, (_A * x[None, start : start + CHUNK] + _B).min(axis=1), out=least)
    return least


_BAND_FACTORS = (_RANDOM.integers(0, 1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint64)
_BAND_NUMBERS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Stored rows: ``row``, ``key``, ``n_shingles``, ``digest`` of the text, two hashes of the set, ``bands`` and ``sketch``."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {name: [] for name in ("n_shingles", "digest", "set_a", "set_b", "bands", "sketch")}
        last: dict[bytes, tuple] = {}
        for raw in batch.column(1).cast(pa.binary()).to_pylist():
            digest = hashlib.md5(raw or b"", usedforsecurity=False).digest()
            if digest not in last:
                found = shingles(raw, size)
                if len(found):
                    least = minima(found)
                    bands = mix((least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) ^ _BAND_NUMBERS)
                    sums = (int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mix(found), mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
                    last[digest] = (len(found), *sums, bands.astype(np.int64), (least[:SKETCH] >> np.uint32(7)).astype(np.uint8).tobytes())
                else:
                    last[digest] = (0, 0, 0, [], b"")
            for name, value in zip(out, (last[digest][0], digest, *last[digest][1:]), strict=True):
                out[name].append(value)
        return {"key": batch.column(0)} | out

    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    schema = f"key {kind}, n_shingles long, digest binary, set_a long, set_b long, bands array<long>, sketch binary"
    found = by_batch(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), schema, work)
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "signatures")


def _screened(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sizes and minima allow the similarity."""
    own = classes.select("node", F.col("n_shingles").alias("n"), "sketch")
    a, b = (own.select(*(F.col(c).alias(f"{c}_{side}") for c in own.columns)) for side in "ab")
    sized = (
        pairs.join(a, pairs.a == a.node_a).join(b, pairs.b == b.node_b)
        .where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
        .select("a", "b", "sketch_a", "sketch_b")
    )

    def work(batch: pa.RecordBatch) -> dict:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH) for c in (2, 3))
        keep = np.flatnonzero((x == y).mean(axis=1) >= similarity - SLACK) if batch.num_rows else []
        return {"a": batch.column(0).take(pa.array(keep, pa.int64())), "b": batch.column(1).take(pa.array(keep, pa.int64()))}

    return by_batch(sized, "a long, b long", work)


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Stored ``node`` and ``members`` (the whole set) for the given nodes, from their texts."""
    wanted = stored(classes.join(nodes, "node").select("node", "digest", F.col("key").alias("wanted_key")), "wanted")
    rows = docs.select(F.col(key).alias("own_key"), F.col(text).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    same = (rows.digest == wanted.digest) & rows.own_key.eqNullSafe(wanted.wanted_key)
    texts = rows.join(wanted, same).select("node", "text").dropDuplicates(["node"])

    def sets(batch: pa.RecordBatch) -> dict:
        found = [shingles(raw, size).astype(np.int64) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
        return {"node": batch.column(0), "members": found}

    return stored(by_batch(texts, "node long, members array<long>", sets), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    a, b = (sets.select(F.col("node").alias(f"node_{s}"), F.col("members").alias(f"members_{s}")) for s in "ab")
    both = pairs.join(a, pairs.a == a.node_a).join(b, pairs.b == b.node_b).select("a", "b", "members_a", "members_b")

    def check(batch: pa.RecordBatch) -> dict:
        keep = []
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        return {"u": batch.column(0).take(at), "v": batch.column(1).take(at)}

    return stored(by_batch(both, "u long, v long", check), "confirmed")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _across(rest: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one bucket that their shared shingles and minima allow.

    Of a set only the shingles that some other component holds too can be common to
    such a pair. With k of them, a set of n can have at most k in common with another
    one of m, so at most k / (n + m - k) of the union. A bucket is dealt in blocks: a
    task gets two blocks at a time and gives the pairs that pass, each pair in the first
    band that it shares.
    """
    labels = rest.select("node", "label").distinct()
    each = sets.select("node", F.explode("members").alias("member")).join(labels, "node")
    met = each.groupBy("member").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("member")
    open_members = each.join(met, "member").groupBy("node").agg(F.count("*").alias("k"))
    nodes = open_members.join(classes.select("node", F.col("n_shingles").alias("n"), "bands", "sketch"), "node")
    blocks = rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rest.join(blocks, "bucket").select("bucket", "node", "label", own.alias("own"), other.alias("other")).join(nodes, "node")
    dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label", "n", "k", "bands", "sketch")
    dealt = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    least = percent / 100 - SLACK

    def compare(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        _, x, y, own, node, label, n, k, bands, sketch = zip(*rows, strict=True)
        own, node, label, n, k = (np.array(c) for c in (own, node, label, n, k))
        bands = np.array(bands)
        sketch = np.frombuffer(b"".join(sketch), dtype=np.uint8).reshape(len(rows), SKETCH)
        bucket = np.array([r[0] for r in rows[:1]])
        band = int(np.argmax((bands == bucket).any(axis=0)))
        first, second = (np.flatnonzero(own == x[0]), np.flatnonzero(own == y[0]))
        out_a, out_b = [], []
        for i in first:
            j = second if x[0] != y[0] else second[second > i]
            j = j[label[j] != label[i]]
            common = np.minimum(k[i], k[j])
            j = j[100 * common >= percent * (n[i] + n[j] - common)]
            j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
            j = j[(sketch[j] == sketch[i]).mean(axis=1) >= least]
            out_a.append(np.minimum(node[i], node[j]))
            out_b.append(np.maximum(node[i], node[j]))
        return np.concatenate(out_a or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def done() -> pa.RecordBatch:
            a, b = compare(waiting)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and row[:3] != waiting[-1][:3]:
                    yield done()
                    waiting = []
                waiting.append(row)
        if waiting:
            yield done()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``key``, ``n_shingles``, ``component_id`` (least key of its component), ``kept`` (one row of each
    component) and ``digest`` (MD5 of the text).

    Two texts are linked if their shingle sets share ``percent`` of their union.
    """
    similarity = percent / 100
    rows = signatures(docs, key, text, size)
    classes = rows.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row").alias("node"))
    member = stored(
        rows.where("n_shingles > 0").select("row", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("row", "node"), "members"
    )
    reps = rows.join(member.where("row = node").select("row", "node"), "row")
    reps = stored(reps.select("node", "key", "digest", "n_shingles", "bands", "sketch"), "classes")
    buckets = reps.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    placed = stored(buckets.join(shared.select("bucket", "center"), "bucket"), "buckets")
    pairs = placed.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(_screened(pairs, reps, similarity), "candidates")
    links = _confirmed(pairs, _sets(_ends(pairs), reps, docs, key, text, size), percent)
    labels = components(links)

    # Buckets that hold more than one component: members of different ones, but for the pairs with the center.
    labelled = placed.join(labels, "node", "left").select("bucket", "center", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    rest = stored(labelled.join(mixed, "bucket").where("node <> center").select("bucket", "node", "label"), "mixed")
    sets = _sets(rest.select("node").distinct(), reps, docs, key, text, size)
    more = _across(rest, sets, reps, percent)
    again = _confirmed(stored(more, "candidates"), sets, percent)
    if not again.isEmpty():
        labels = components(links.unionByName(again))

    placed_rows = rows.select("row", "key", "n_shingles", "digest").join(member, "row", "left").join(labels, "node", "left")
    placed_rows = placed_rows.select("row", "key", "n_shingles", "digest", F.coalesce("label", "node", "row").alias("label"))
    first = placed_rows.groupBy("label").agg(F.min(F.struct("key", "row")).alias("first"))
    return placed_rows.join(first, "label").select(
        F.col("key").alias(key), "n_shingles", F.col("first.key").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "digest"
    )
