"""Hard-negative mining over lists that clusters of anchors share.

Anchors are clustered by direction. No member of a cluster can have a larger inner
product with a row x than ``|member| * |x| * cos(angle(center, x) - widest)``, where
``widest`` is the largest angle between the center and a member. Sorting all rows by
the factor of x and the center gives one list per cluster; each member walks it, scores
the rows it meets, and stops once its bound for the next row is below the least score
that still counts. That certifies the result: the search is exact.

A list is dealt in pages of falling bounds, the next one for members that are not done
only; a page is dealt in blocks of rows and its members in groups, so a task holds one
block and a slice of members, whatever shares a direction. Two walks are made: for the
positives (same label), and, within the bands of score that they set, for the negatives.

Scores are exact: the matrix products run in a floating type only where no sum can leave
its integers. Centers are fitted on at most ``SAMPLE`` anchors; all else covers all rows.

Defined results: rows with a null label or vector, a null or non-finite component, or
one that times 256 is 2^27 or more (scores would not fit) take no part; shorter vectors
count as filled up with zeros; a row without id comes after all others of its score
and is no anchor; rows of equal id are separate rows; an anchor without positives, or a
positive without rows in its band, gives no rows; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import ship, stored

# Components are multiplied by this and rounded down.
SCALE = 256
LARGEST = 1 << 27
# Anchors that centers are fitted on, at most; centers, at most; anchors there should be for each.
SAMPLE, CENTERS, PER_CENTER, STEPS = 4096, 64, 64, 10
# Rows of the first page of a list, and how much longer each further page may be.
PAGE_ROWS, PAGE_GROWTH = 32_768, 8
# Rows of a block of a page, members of a group, members handled at once, rows a member meets between two looks at its bound.
BLOCK_ROWS, GROUP_MEMBERS, MEMBERS, STRIDE = 16_384, 65_536, 512, 1024
# Taken off angles and added to bounds, far above what rounding adds up to.
SLACK = 1e-6
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """What the packed vectors of a table share."""

    size: int
    kind: str
    exact: str

    def rows(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), dtype=self.kind).reshape(len(packed), self.size).astype(self.exact)


def prepare(rows: DataFrame, key: str, vector: str, label: str, anchor: Column) -> tuple[DataFrame, Shape]:
    """``row`` (unique), ``id``, ``label``, ``anchor``, ``v`` (packed integers), ``norm`` of the rows that take part."""
    ship(rows.sparkSession)
    scaled = F.transform(vector, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE))
    own = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        (F.coalesce(anchor, F.lit(False)) & F.col(key).isNotNull()).alias("anchor"),
        F.when(F.col(vector).isNotNull() & fit, F.transform(scaled, lambda x: F.floor(x))).alias("v"),
    ).where("label IS NOT NULL AND v IS NOT NULL")
    largest = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0).cast("long")))
    square = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    size, most, norm = own.agg(F.max(F.size("v")), largest, F.max(square)).first()
    norm = norm or 0.0
    exact = "float32" if norm < 1 << 23 else "float64" if norm < 1 << 52 else "int64"
    shape = Shape(max(size or 0, 1), "<i2" if (most or 0) < 1 << 15 else "<i4", exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(4)
            lengths = np.diff(np.concatenate(([0], np.cumsum([len(v) for v in vectors]))))
            packed = np.zeros((batch.num_rows, shape.size), dtype=shape.kind)
            inside = np.arange(shape.size)[None, :] < lengths[:, None]
            packed[inside] = vectors.flatten().to_numpy(zero_copy_only=False)
            norms = np.sqrt((packed.astype(np.float64) ** 2).sum(axis=1))
            arrays = [*batch.columns[:4], pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(norms)]
            yield pa.record_batch(arrays, names=["row", "id", "label", "anchor", "v", "norm"])

    numbered = own.select(F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(_LAST)).alias("id"), "label", "anchor", "v")
    packed = numbered.mapInArrow(run, "row long, id long, label string, anchor boolean, v binary, norm double")
    return stored(packed, "vectors"), shape


def _directions(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-300)


def fit_centers(x: np.ndarray, number: int) -> np.ndarray:
    """Unit centers by spherical k-means, the same for the same rows."""
    x = _directions(x)
    # Each further start is the row that is farthest from those there are.
    starts, near = [0], x @ x[0]
    while len(starts) < number:
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    centers = x[starts]
    for _ in range(STEPS):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        empty = (sums**2).sum(axis=1) < 1e-12
        sums[empty] = centers[empty]
        centers = _directions(sums)
    return centers


def _angles(v: np.ndarray, norms: np.ndarray, centers: np.ndarray) -> np.ndarray:
    cosines = (v.astype(np.float64) @ centers.T) / np.maximum(norms, 1e-300)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def assign(vectors: DataFrame, shape: Shape) -> tuple[DataFrame, np.ndarray, np.ndarray, list[int]]:
    """The anchors with their ``cluster``; centers, widest angles and members of the clusters."""
    anchors = vectors.where("anchor")
    sample = anchors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()
    number = min(CENTERS, max(1, anchors.count() // PER_CENTER))
    centers = fit_centers(shape.rows([bytes(r.v) for r in sample]), min(number, len(sample))) if sample else np.zeros((1, shape.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = batch.column(4).to_numpy()
            angles = _angles(shape.rows(batch.column(3).to_pylist()), norms, centers)
            own = angles.argmin(axis=1)
            # A vector of zeros has no direction and no score but 0: any bound holds for it.
            widths = np.where(norms > 0, angles[np.arange(len(own)), own], 0.0)
            yield pa.record_batch([*batch.columns, pa.array(own, pa.int32()), pa.array(widths)], names=["row", "id", "label", "v", "norm", "cluster", "width"])

    shaped = "row long, id long, label string, v binary, norm double, cluster int, width double"
    members = stored(anchors.select("row", "id", "label", "v", "norm").mapInArrow(run, shaped), "members")
    widest, sizes = np.zeros(len(centers)), [0] * len(centers)
    for r in members.groupBy("cluster").agg(F.max("width").alias("width"), F.count("*").alias("n")).collect():
        widest[r.cluster], sizes[r.cluster] = r.width, r.n
    return members.drop("width"), centers, widest, sizes


# shared lists


def _bounds(v: np.ndarray, norms: np.ndarray, centers: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """Rows by clusters: a member's norm times this is at least its product with the row."""
    angles = np.maximum(_angles(v, norms, centers) - widest[None, :] - SLACK, 0)
    return norms[:, None] * (np.cos(angles) + SLACK)


def _bins(bounds: np.ndarray) -> np.ndarray:
    """Bounds on a scale of 128 steps for each doubling; -1 for none above zero."""
    return np.where(bounds > 0, bounds.astype(np.float32).view(np.int32) >> 16, -1)


def _top(bin_: int) -> float:
    """No bound of the bin is above this."""
    return float(np.array([(bin_ + 1) << 16], dtype=np.int32).view(np.float32)[0]) * (1 + SLACK) + SLACK


@dataclass(frozen=True)
class Lists:
    """Per cluster: the page of each bin, the rows of each page, and the largest bound beyond each page."""

    centers: np.ndarray
    widest: np.ndarray
    pages: list[dict[int, int]]
    rows: list[list[int]]
    beyond: list[list[float]]

    @property
    def length(self) -> int:
        return max((len(rows) for rows in self.rows), default=0)


def share_lists(vectors: DataFrame, shape: Shape, centers: np.ndarray, widest: np.ndarray) -> Lists:
    """Where the pages of every list begin and end; the driver sees counts by bin."""
    clusters = len(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            bins = _bins(_bounds(shape.rows(batch.column(0).to_pylist()), batch.column(1).to_numpy(), centers, widest))
            for cluster in range(clusters):
                for bin_, n in zip(*(x.tolist() for x in np.unique(bins[:, cluster], return_counts=True)), strict=True):
                    seen[cluster, bin_] = seen.get((cluster, bin_), 0) + n
        keys = list(seen)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["cluster", "bin", "n"])

    counted = vectors.select("v", "norm").mapInArrow(run, "cluster int, bin int, n long").groupBy("cluster", "bin").agg(F.sum("n").alias("n")).collect()
    pages: list[dict[int, int]] = [{} for _ in range(clusters)]
    rows: list[list[int]] = [[] for _ in range(clusters)]
    beyond: list[list[float]] = [[] for _ in range(clusters)]
    for cluster in range(clusters):
        above = 0
        for bin_, n in sorted(((r.bin, r.n) for r in counted if r.cluster == cluster), reverse=True):
            page = max(0, math.ceil(math.log((above + 1) / PAGE_ROWS, PAGE_GROWTH))) if above >= PAGE_ROWS else 0
            if page >= len(rows[cluster]):
                beyond[cluster] += [_top(bin_)] * (page - len(beyond[cluster]))
                rows[cluster] += [0] * (page + 1 - len(rows[cluster]))
            pages[cluster][bin_] = page
            rows[cluster][page] += n
            above += n
        beyond[cluster] += [-math.inf] * (len(rows[cluster]) - len(beyond[cluster]))
    return Lists(centers, widest, pages, rows, beyond)


def _parts(amount: int, most: int) -> int:
    return max(1, -(-amount // most))


def _page(vectors: DataFrame, shape: Shape, lists: Lists, page: int, groups: dict[int, int]) -> DataFrame:
    """The rows of one page of the lists of ``groups``' clusters: ``cluster, part, block, bound`` and the row."""
    wanted = [c for c in sorted(groups) if page < len(lists.rows[c])]
    blocks = {c: _parts(lists.rows[c][page], BLOCK_ROWS) for c in wanted}
    centers, widest = lists.centers[wanted], lists.widest[wanted]
    bins_of = [np.array(sorted(b for b, p in lists.pages[c].items() if p == page), dtype=np.int64) for c in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = _bounds(shape.rows(batch.column(3).to_pylist()), batch.column(4).to_numpy(), centers, widest)
            bins = _bins(bounds)
            dealt = batch.column(5).to_numpy()
            for place, cluster in enumerate(wanted):
                at = np.flatnonzero(np.isin(bins[:, place], bins_of[place]))
                taken = batch.take(pa.array(at))
                block = pa.array(dealt[at] % blocks[cluster], pa.int32())
                for part in range(groups[cluster]):
                    fixed = [pa.array(np.full(len(at), x), pa.int32()) for x in (cluster, part)]
                    yield pa.record_batch([*fixed, block, pa.array(bounds[at, place]), *taken.columns[:5]], names=["cluster", "part", "block", "bound", "row", "id", "label", "v", "norm"])

    shaped = "cluster int, part int, block int, bound double, row long, id long, label string, v binary, norm double"
    return vectors.select("row", "id", "label", "v", "norm", F.pmod(F.xxhash64("row"), F.lit(1 << 30)).alias("dealt")).mapInArrow(run, shaped)


# walks


class _Block:
    """Rows of a page, in falling order of their bounds, that members walk along."""

    def __init__(self, shape: Shape, same: bool, most: int) -> None:
        self.shape, self.same, self.most = shape, same, most
        self.columns: dict[str, list] = {"bound": [], "row": [], "id": [], "label": [], "v": []}
        self.ready = False

    def add(self, columns: dict[str, list]) -> None:
        for name, values in self.columns.items():
            values.extend(columns[name])

    def _close(self) -> None:
        self.bound = np.array(self.columns["bound"])
        order = np.argsort(-self.bound, kind="stable")
        self.bound = self.bound[order]
        self.row, self.id = (np.array(self.columns[name], dtype=np.int64)[order] for name in ("row", "id"))
        self.codes = {label: code for code, label in enumerate(dict.fromkeys(self.columns["label"]))}
        self.label = np.array([self.codes[x] for x in self.columns["label"]], dtype=np.int64)[order]
        self.x = self.shape.rows(self.columns.pop("v"))[order]
        self.columns = {}
        self.ready = True

    def walk(self, members: dict[str, list]) -> tuple[np.ndarray, ...]:
        """``member, band, place, score`` of the ``most`` best rows of each member and band."""
        if not self.ready:
            self._close()
        number = len(members["row"])
        a = self.shape.rows(members["v"])
        norm, row = np.array(members["norm"]), np.array(members["row"], dtype=np.int64)
        label = np.array([self.codes.get(x, -1) for x in members["label"]], dtype=np.int64)
        bands = max((len(x) for x in members["lows"]), default=0)
        # Where a member has fewer bands, no score is in the band.
        low, high = np.full((number, bands), _LAST), np.full((number, bands), -_LAST)
        for i, (lows, highs) in enumerate(zip(members["lows"], members["highs"], strict=True)):
            low[i, : len(lows)], high[i, : len(highs)] = lows, highs
        kept = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        for start in range(0, len(self.bound), STRIDE):
            reach = np.nextafter(norm * self.bound[start], np.inf)
            going = np.flatnonzero((low <= reach[:, None]).any(axis=1))
            if not len(going):
                break
            end = min(start + STRIDE, len(self.bound))
            scores = a[going] @ self.x[start:end].T
            scores = scores if scores.dtype == np.int64 else scores.astype(np.int64)
            fits = (label[going, None] == self.label[None, start:end]) == self.same
            fits &= row[going, None] != self.row[None, start:end]
            found = []
            for band in range(bands):
                at, place = np.nonzero(fits & (scores >= low[going, band, None]) & (scores <= high[going, band, None]))
                found.append((going[at], np.full(len(at), band), place + start, scores[at, place]))
            new = tuple(np.concatenate(x) for x in zip(*found, strict=True))
            if len(new[0]):
                kept = self._best(tuple(np.concatenate(x) for x in zip(kept, new, strict=True)), low)
        return kept

    def _best(self, found: tuple[np.ndarray, ...], low: np.ndarray) -> tuple[np.ndarray, ...]:
        """The first ``most`` of each member and band; raises the least score of those that are full."""
        member, band, place, score = found
        order = np.lexsort((self.row[place], self.id[place], -score, band, member))
        member, band, place, score = (x[order] for x in (member, band, place, score))
        first = np.flatnonzero(np.concatenate(([True], (np.diff(member) != 0) | (np.diff(band) != 0))))
        rank = np.arange(len(member)) - np.repeat(first, np.diff(np.concatenate((first, [len(member)]))))
        full = rank == self.most - 1
        low[member[full], band[full]] = np.maximum(low[member[full], band[full]], score[full])
        return tuple(x[rank < self.most] for x in (member, band, place, score))


_MEMBER = "row long, id long, label string, v binary, norm double"
_FOUND = "row long, band int, score long, id long, other long"


def _walk_page(page: DataFrame, members: DataFrame, shape: Shape, same: bool, most: int) -> DataFrame:
    """``row, band, score, id, other`` found by each member in each block of the page."""
    none = F.array().cast("array<long>")
    columns = ["cluster", "part", "block", "kind", "bound", "row", "id", "label", "v", "norm", "lows", "highs"]
    listed = page.select("*", F.lit(0).alias("kind"), none.alias("lows"), none.alias("highs")).select(columns)
    walkers = members.select("*", F.lit(1).alias("kind"), F.lit(0.0).alias("bound")).select(columns)
    dealt = listed.unionByName(walkers).repartition("cluster", "part", "block")
    dealt = dealt.sortWithinPartitions("cluster", "part", "block", "kind", F.desc("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if tuple(keys[:3, start]) != at:
                    at, block = tuple(keys[:3, start]), _Block(shape, same, most)
                step = end - start if keys[3, start] == 0 else MEMBERS
                for begin in range(start, end, step):
                    part = batch.slice(begin, min(step, end - begin))
                    values = {name: part.column(i).to_pylist() for i, name in enumerate(columns) if i > 3}
                    if keys[3, start] == 0:
                        block.add(values)
                        continue
                    if not block.ready and not block.columns["row"]:
                        continue
                    member, band, place, score = block.walk(values)
                    rows = np.array(values["row"], dtype=np.int64)[member]
                    arrays = [pa.array(rows), pa.array(band, pa.int32()), pa.array(score), pa.array(block.id[place]), pa.array(block.row[place])]
                    yield pa.record_batch(arrays, names=["row", "band", "score", "id", "other"])

    return dealt.mapInArrow(run, _FOUND)


def _first(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("row", "band").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def walk_lists(vectors: DataFrame, shape: Shape, lists: Lists, members: DataFrame, sizes: list[int], same: bool, most: int) -> DataFrame:
    """``row, band, score, id, other, rank``: the first ``most`` rows of each member in each of its bands.

    ``members`` have ``lows`` and ``highs``, the bands of scores that count. A round walks
    one page; members whose bound beyond it is below all that still counts are done.
    """
    spark = vectors.sparkSession
    state = spark.createDataFrame([], f"{_FOUND}, rank int")
    groups = {c: _parts(n, GROUP_MEMBERS) for c, n in enumerate(sizes) if n}
    open_ = members
    for page in range(lists.length):
        if not groups:
            break
        layout = [(c, groups[c], _parts(lists.rows[c][page], BLOCK_ROWS)) for c in groups if page < len(lists.rows[c])]
        layout = F.broadcast(spark.createDataFrame(layout, "cluster int, parts int, blocks int"))
        dealt = open_.join(layout, "cluster").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = _walk_page(_page(vectors, shape, lists, page, groups), dealt, shape, same, most)
        state = stored(_first(state.drop("rank").unionByName(found), most), "found")
        if page + 1 == lists.length:
            break
        beyond = F.broadcast(spark.createDataFrame([(c, float(x[page])) for c, x in enumerate(lists.beyond) if page < len(x)], "cluster int, reach double"))
        full = state.groupBy("row", "band").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == most)
        least = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("band", "least"))).alias("least"))
        # The least score that counts is the one of the last of a full band.
        raised = F.transform("lows", lambda x, i: F.greatest(x, F.try_element_at("least", i)))
        open_ = members.join(least, "row", "left").withColumn("lows", F.when(F.col("least").isNull(), F.col("lows")).otherwise(raised)).drop("least")
        open_ = open_.join(beyond, "cluster")
        open_ = stored(open_.where(F.exists("lows", lambda x: x.cast("double") <= F.col("norm") * F.col("reach") * (1 + SLACK) + SLACK)).drop("reach"), "open")
        groups = {r.cluster: _parts(r["count"], GROUP_MEMBERS) for r in open_.groupBy("cluster").count().collect()}
    return state


def mine(
    rows: DataFrame, key: str, vector: str, label: str, anchor: Column,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The positives of an anchor are the first rows of its label, the negatives of each the first
    rows of other labels between ``low`` and ``high`` percent of the positive's score.
    """
    vectors, shape = prepare(rows, key, vector, label, anchor)
    members, centers, widest, sizes = assign(vectors, shape)
    lists = share_lists(vectors, shape, centers, widest)
    any_score = members.withColumn("lows", F.array(F.lit(-_LAST))).withColumn("highs", F.array(F.lit(_LAST)))
    near = walk_lists(vectors, shape, lists, any_score, sizes, True, positives)
    # Percents of a score, rounded into the band; a band of a negative score is empty.
    score = F.col("score").cast("decimal(38,0)")
    near = near.withColumn("low", F.ceil(score * low / 100).cast("long")).withColumn("high", F.floor(score * high / 100).cast("long"))
    near = stored(near.where("low <= high").withColumn("band", F.col("rank") - 1), "bands")
    bands = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("band", "low", "high"))).alias("bands"))
    # Bands without a score keep their place, so that the place is the positive's.
    place = F.sequence(F.lit(0), F.lit(positives - 1))
    own = F.map_from_entries(F.transform("bands", lambda b: F.struct(b["band"], b)))
    banded = members.join(bands, "row").withColumn("own", own)
    banded = banded.withColumn("lows", F.transform(place, lambda i: F.coalesce(F.try_element_at("own", i)["low"], F.lit(_LAST))))
    banded = banded.withColumn("highs", F.transform(place, lambda i: F.coalesce(F.try_element_at("own", i)["high"], F.lit(-_LAST)))).drop("own", "bands")
    hard = walk_lists(vectors, shape, lists, stored(banded, "banded"), sizes, False, negatives)
    named = near.select("row", "band", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = hard.select("row", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = hard.join(named, ["row", "band"]).join(members.select("row", F.col("id").alias("anchor_id")), "row")
    unnamed = [F.when(F.col(c) != _LAST, F.col(c)).alias(c) for c in ("positive_id", "negative_id")]
    return joined.select("anchor_id", unnamed[0], "rank", unnamed[1], "positive_score", "negative_score")
