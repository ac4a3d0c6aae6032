"""Benchmark decontamination by a positional inverted index.

The index holds, per document, the benchmark terms and their word positions;
terms that cannot be part of a match (they stand in a run of benchmark terms
shorter than any window they belong to) are left out while it is built. A window
takes its rarest term by document frequency, shifts that term's positions by the
term's offset to get start candidates, and keeps those where the postings of all
its other terms, shifted alike, agree. ``slop`` above 0 lets each term stand that
many words from its place (proximity).

Joins are by term and by (row, term, position); candidates are as many as the
rarest terms have postings, never pairs of documents or items.

Defined results: a null or empty text has no words; an item without words, or
without an id, has no window; equal windows of several items count for each item;
repeated documents are separate rows with equal results; only the named columns
are read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import by_batch, small, stored

# Up to this many distinct benchmark terms go to every task; beyond it all terms are indexed.
VOCABULARY_TERMS = 500_000
# Bytes to lower case, and what parts words to a space: fixed by [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _binary(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def item_windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``item``, ``window``, ``terms``: every run of ``size`` words, or a shorter item as it is."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"item": [], "terms": []}
        for item, raw in zip(batch.column(0).to_pylist(), _binary(batch, 1), strict=True):
            own = [w.decode() for w in words(raw)]
            for at in range(max(1, len(own) - size + 1) if own else 0):
                out["item"].append(item)
                out["terms"].append(own[at : at + size])
        return out

    kept = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL")
    found = by_batch(kept, "item string, terms array<string>", work)
    return stored(found.distinct().withColumn("window", F.monotonically_increasing_id()), "windows")


def _kept_places(need: np.ndarray) -> np.ndarray:
    """Positions whose run of benchmark terms is as long as the shortest window of the term; need: that length, 0 elsewhere."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], need > 0, [0]))))
    starts, ends = edges[::2], edges[1::2]
    length = np.zeros(len(need), dtype=np.int64)
    for a, b in zip(starts, ends, strict=True):
        length[a:b] = b - a
    return np.flatnonzero((need > 0) & (length >= need))


def index(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int] | None) -> DataFrame:
    """``row`` (unique), ``key``, ``n_words``, ``terms`` and ``places`` (parallel) for each document.

    ``vocabulary``: per term the least run of terms it must stand in; None keeps every word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch: pa.RecordBatch) -> dict:
        known = shared.value
        out: dict = {"key": batch.column(0), "n_words": [], "terms": [], "places": []}
        least = min(known.values(), default=1) if known is not None else 1
        for raw in _binary(batch, 1):
            own = words(raw)
            if known is None:
                places = range(len(own))
            elif known and own:
                need = np.fromiter(map(known.get, own, repeat(0)), dtype=np.int64, count=len(own))
                places = []
                if len(own) >= least:
                    hits = np.concatenate(([0], np.cumsum(need > 0)))
                    # A run of `least` known words at least, before anything finer.
                    if (hits[least:] - hits[:-least] == least).any():
                        places = _kept_places(need).tolist()
            else:
                places = []
            out["n_words"].append(len(own))
            out["terms"].append([own[p].decode() for p in places])
            out["places"].append(list(places))
        return out

    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    found = by_batch(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), f"key {kind}, n_words long, terms array<string>, places array<int>", work)
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "index")


def matches(indexed: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """``row``, ``item``, ``start``, ``length`` of every window occurrence."""
    postings = indexed.where(F.size("terms") > 0).select("row", F.explode(F.arrays_zip("terms", "places")).alias("p"))
    postings = postings.select("row", F.col("p.terms").alias("term"), F.col("p.places").alias("place"))
    frequency = postings.groupBy("term", "row").count().groupBy("term").agg(F.count("*").alias("df"))
    terms = windows.select("window", F.posexplode("terms").alias("at", "term"))
    # A window with a term that no document has cannot occur; its list stays shorter than the window.
    ranked = (
        terms.join(frequency, "term")
        .groupBy("window")
        .agg(F.array_sort(F.collect_list(F.struct("df", "at", "term"))).alias("ranked"))
        .join(windows.select("window", "item", F.size("terms").alias("length")), "window")
        .where(F.size("ranked") == F.col("length"))
    )
    first = ranked.select("window", "item", "length", "ranked", F.col("ranked")[0]["term"].alias("term"), F.col("ranked")[0]["at"].alias("at"))
    starts = (
        postings.join(small(first), "term")
        .select("row", "window", "item", "length", (F.col("place") - F.col("at")).alias("start"), F.slice("ranked", 2, 1_000_000).alias("rest"))
        .where("start >= 0")
    )
    alone = starts.where("length = 1").select("row", "item", "start", "length")
    wanted = starts.where("length > 1").select("row", "window", "item", "start", "length", F.explode("rest").alias("r"))
    place = F.col("start") + F.col("r.at")
    if slop:
        places = F.sequence(place - slop, place + slop)
        wanted = wanted.select("*", F.explode(places).alias("place"))
    else:
        wanted = wanted.withColumn("place", place)
    agreed = (
        wanted.select("row", "window", "item", "start", "length", F.col("r.term").alias("term"), F.col("r.at").alias("at"), "place")
        .join(postings, ["row", "term", "place"])
        .groupBy("row", "window", "item", "start", "length")
        .agg((F.count_distinct("at") if slop else F.count("*")).alias("n"))
        .where("n = length - 1")
        .select("row", "item", "start", "length")
    )
    return agreed.unionByName(alone)


def decontaminate(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, size: int = 10, slop: int = 0) -> DataFrame:
    """Per document ``key``, ``n_words``, ``n_hit`` (words inside a match), ``items`` (sorted ids) and ``contaminated``."""
    windows = item_windows(items, item_key, item_text, size)
    terms = windows.select(F.explode("terms").alias("term"), F.size("terms").alias("length")).groupBy("term").agg(F.min("length").alias("length"))
    vocabulary = None
    if terms.count() <= VOCABULARY_TERMS:
        vocabulary = {r.term.encode(): 1 if slop else r.length for r in terms.collect()}
    indexed = index(docs, key, text, vocabulary)
    found = stored(matches(indexed, windows, slop), "matches")
    places = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place"))
    hit = places.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    names = found.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = indexed.select("row", "key", "n_words").join(hit.join(names, "row"), "row", "left")
    return joined.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
