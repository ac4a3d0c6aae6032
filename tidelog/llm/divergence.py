"""How far the sources of a language differ in their words: a K-squared quadtree over counts.

The counts of each language are a matrix of groups (its sources) by terms. Rows are
numbered by size, columns by document frequency, so what is empty lies together, and
the matrix is cut into quadrants of K by K parts, level by level; a quadrant without a
count is not kept. Two sources are compared by going down the tree for their two row
blocks at once, a Spark join per level: where both quadrants are empty, all their cells
have the price of a count of zero and the whole width is priced by one multiplication;
elsewhere the pair goes on to the parts, and at the leaves the K by K cells of both are
compared. All arithmetic is in integers.

Texts are counted where they are read, with a bounded table per task that is passed on
when full; counts of one term meet in one place, at most one row per source and table.
No task holds a group, a language or the matrix; the driver sees the height of the tree.

Defined results: a null text, language or source counts as empty; equal documents all
count; a group without terms has the price of zero throughout; a language without kept
terms has differences of 0; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import ship, slices, stored
from tidelog.operators.numbering import number_rows

# Parts of a quadrant each way; fixed by the 64 cells of a leaf.
K = 8
# Entries and bytes of text a task counts before it passes the counts on.
TABLE_ENTRIES = 300_000
TABLE_BYTES = 1 << 26
# Pairs of row blocks whose sums a task holds before it passes them on.
HELD_PAIRS = 5_000
# Ranks of terms are taken within so many parts of a group first.
SALTS = 32
# What is not part of a term becomes a space: fixed by [^\x00-\x40\x5B-\x60\x7B-\x7F]+.
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_COUNTS = "lang string, source string, term binary, n long, docs long"


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, several rows for a term."""

    def rows(table: dict) -> Iterator[pa.RecordBatch]:
        for (own_lang, own_source), (n, held) in table.items():
            size = len(n)
            arrays = [pa.array([own_lang] * size, pa.string()), pa.array([own_source] * size, pa.string())]
            arrays += [pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([held[t] for t in n], pa.int64())]
            yield pa.record_batch(arrays, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        held_bytes = 0
        for batch in slices(batches):
            for own_lang, own_source, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, held = table.setdefault((own_lang, own_source), (Counter(), Counter()))
                terms = body.translate(_FOLD).split()
                n.update(terms)
                held.update(set(terms))
                held_bytes += len(body)
                if held_bytes > TABLE_BYTES:
                    yield from rows(table)
                    table, held_bytes = {}, 0
            if sum(len(n) for n, _ in table.values()) > TABLE_ENTRIES:
                yield from rows(table)
                table, held_bytes = {}, 0
        yield from rows(table)

    ship(docs.sparkSession)
    empty = F.lit("")
    read = docs.select(F.coalesce(lang, empty).alias("lang"), F.coalesce(source, empty).alias("source"), F.coalesce(text, empty).cast("binary").alias("text"))
    return read.mapInArrow(run, _COUNTS)


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 * (count + 5) / (total + 5 * kept))`` in two steps, exact to counts of 10^13."""
    above, below = count + 5, F.greatest(total + 5 * kept, F.lit(1).cast("long"))
    high = above * 100_000
    whole = _div(high, below)
    return 1 + whole * 10_000 + _div((high - whole * below) * 10_000, below)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``name`` counts from 0 within each language along ``order``; ``df`` has no two equal rows."""
    placed = stored(number_rows(df, ["lang", *order], name, 0), name)
    first = placed.groupBy("lang").agg(F.min(name).alias("first"))
    return placed.join(first, "lang").withColumn(name, F.col(name) - F.col("first")).drop("first")


def matrix(docs: DataFrame, text: str, lang: str, source: str, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """``groups`` (lang, source, row, rows, kept, total, zero) and ``cells`` (lang, source, term,
    row, col, p, q): the counts above zero of the kept terms, as shares of the group and of the language."""
    # One exchange: rows of a term meet, and both the sums per source and those per language follow from it.
    met = term_counts(docs, text, lang, source).repartition("lang", "term")
    sums = met.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    sums = sums.withColumn("all_n", F.sum("n").over(whole)).withColumn("all_docs", F.sum("docs").over(whole))
    kept = stored(sums.where(F.col("all_docs") >= least_docs).withColumn("term", F.col("term").cast("string")), "counts")

    terms = kept.groupBy("lang", "term").agg(F.max("all_n").alias("all_n"), F.max("all_docs").alias("all_docs"))
    terms = _numbered(terms, [F.desc("all_docs"), "term"], "col")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total"))
    names = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    groups = _numbered(groups, [F.desc("total"), "source"], "row")
    size = groups.groupBy("lang").agg(F.count("*").alias("rows"))
    groups = groups.join(size, "lang").join(langs, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    groups = groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    groups = stored(groups, "groups")
    cells = kept.select("lang", "source", "term", "n").join(terms, ["lang", "term"]).join(groups.drop("zero"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all_n"), F.col("lang_total"), F.col("kept"))
    cells = stored(cells.select("lang", "source", "term", "row", "col", p.alias("p"), q.alias("q")), "cells")
    return groups.select("lang", "source", "row", "rows", "kept", "total", "zero"), cells


def _down(cells: DataFrame, groups: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves to compare (lang, ra, rb, c, kept) and, per level, the empty widths of pairs of row blocks."""
    most = groups.agg(F.max(F.greatest("rows", "kept"))).first()[0] or 1
    height = 1
    while K**height < most:
        height += 1
    sizes = groups.select("lang", "rows", "kept").distinct()
    zero = F.lit(0).cast("long")
    front = sizes.where("kept > 0").select("lang", "rows", "kept", zero.alias("ra"), zero.alias("rb"), zero.alias("c"))
    priced = []
    blocks = cells.select("lang", _div(F.col("row"), F.lit(K)).alias("r"), _div(F.col("col"), F.lit(K)).alias("c")).distinct()
    for level in range(height - 1, 0, -1):
        side = K**level
        step = F.lit(K ** (level - 1))
        nodes = blocks.select("lang", _div(F.col("r"), step).alias("r"), _div(F.col("c"), step).alias("c")).distinct()

        def parts(name: str, end: str, side: int = side) -> Column:
            last = _div(F.col(end) - 1, F.lit(side))
            return F.explode(F.sequence(F.col(name) * K, F.least(F.col(name) * K + (K - 1), last)))

        children = (
            front.withColumn("ra", parts("ra", "rows")).withColumn("rb", parts("rb", "rows")).where("ra <= rb").withColumn("c", parts("c", "kept"))
        )
        left = nodes.select("lang", F.col("r").alias("ra"), "c", F.lit(True).alias("in_a"))
        right = nodes.select("lang", F.col("r").alias("rb"), "c", F.lit(True).alias("in_b"))
        met = children.join(left, ["lang", "ra", "c"], "left").join(right, ["lang", "rb", "c"], "left")
        met = stored(met.withColumn("live", F.col("in_a").isNotNull() | F.col("in_b").isNotNull()).drop("in_a", "in_b"), "front")
        width = F.least(F.lit(side), F.col("kept") - F.col("c") * side)
        priced.append(met.where("NOT live").groupBy("lang", "rows", "ra", "rb").agg(F.sum(width).alias("width")).withColumn("side", F.lit(side)))
        front = met.where("live").drop("live")
    return front, priced


def _leaf_sums(front: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value``: differences over the columns of leaves, several rows for a pair (a < b)."""
    by = F.lit(K)
    entry = F.struct((F.col("row") % K).cast("int").alias("i"), (F.col("col") % K).cast("int").alias("j"), "p")
    leaves = cells.groupBy("lang", _div(F.col("row"), by).alias("r"), _div(F.col("col"), by).alias("c")).agg(F.collect_list(entry).alias("cells"))
    leaves = leaves.select("lang", "r", "c", F.transform("cells", lambda e: (e["i"] * K + e["j"]).cast("long")).alias("at"), F.col("cells.p").alias("p"))
    zeros = groups.groupBy("lang", _div(F.col("row"), by).alias("r")).agg(F.array_sort(F.collect_list(F.struct("row", "zero")))["zero"].alias("zeros"))
    for side in ("a", "b"):
        front = front.join(zeros.select("lang", F.col("r").alias(f"r{side}"), F.col("zeros").alias(f"zeros_{side}")), ["lang", f"r{side}"])
        own = leaves.select("lang", F.col("r").alias(f"r{side}"), "c", F.col("at").alias(f"at_{side}"), F.col("p").alias(f"p_{side}"))
        front = front.join(own, ["lang", f"r{side}", "c"], "left")
    width = F.least(by.cast("long"), F.col("kept") - F.col("c") * K)
    front = front.select("lang", "ra", "rb", width.alias("width"), *(f"{x}_{s}" for s in ("a", "b") for x in ("zeros", "at", "p")))

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        out: tuple = ([], [], [], [])
        for (own, ra, rb), sums in held.items():
            for i, line in enumerate(sums.tolist()):
                for j, value in enumerate(line):
                    if value and ra * K + i < rb * K + j:
                        for column, x in zip(out, (own, ra * K + i, rb * K + j, value), strict=True):
                            column.append(x)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["lang", "a", "b", "value"])

    def side(zeros: list, at: list | None, p: list | None, width: int) -> np.ndarray:
        block = np.zeros((K, K), dtype=np.int64)
        block[: len(zeros)] = np.array(zeros, dtype=np.int64)[:, None]
        if at:
            block.reshape(-1)[at] = p
        return block[:, :width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for own, ra, rb, width, zeros_a, at_a, p_a, zeros_b, at_b, p_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = side(zeros_a, at_a, p_a, width), side(zeros_b, at_b, p_b, width)
                # Rows of the last block that no group has must stay without a value.
                gap = np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
                gap[len(zeros_a) :] = 0
                gap[:, len(zeros_b) :] = 0
                key = (own, ra, rb)
                held[key] = held[key] + gap if key in held else gap
            if len(held) > HELD_PAIRS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    ship(front.sparkSession)
    return front.mapInArrow(run, "lang string, a long, b long, value long")


def _empty_sums(priced: list[DataFrame], groups: DataFrame) -> DataFrame | None:
    """``lang, a, b, value``: what the empty quadrants come to, for every pair of rows in them."""
    found = None
    for widths in priced:
        side = F.col("side")

        def rows(block: str, side: Column = side) -> Column:
            return F.explode(F.sequence(F.col(block) * side, F.least(F.col(block) * side + side - 1, F.col("rows") - 1)))

        pairs = widths.withColumn("a", rows("ra")).withColumn("b", rows("rb")).where("a < b").select("lang", "a", "b", "width")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return None
    found = found.groupBy("lang", "a", "b").agg(F.sum("width").alias("width"))
    for name in ("a", "b"):
        found = found.join(groups.select("lang", F.col("row").alias(name), F.col("zero").alias(f"zero_{name}")), ["lang", name])
    return found.select("lang", "a", "b", (F.col("width") * F.abs(F.col("zero_a") - F.col("zero_b"))).alias("value"))


def source_pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang, source, item, value``: every ordered pair of the sources of a language."""
    front, priced = _down(cells, groups)
    sums = _leaf_sums(front, cells, groups)
    empty = _empty_sums(priced, groups)
    sums = (sums if empty is None else sums.unionByName(empty)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("other")).where("row <> other")
    pairs = pairs.withColumn("a", F.least("row", "other")).withColumn("b", F.greatest("row", "other")).join(sums, ["lang", "a", "b"], "left")
    items = groups.select("lang", F.col("row").alias("other"), F.col("source").alias("item"))
    return pairs.join(items, ["lang", "other"]).select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def _ranked(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", place)
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def source_terms(cells: DataFrame, most: int) -> DataFrame:
    """``lang, source, item, value, rank``: the terms a group has above its language, the first ``most`` of them."""
    above = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    salted = above.withColumn("salt", F.pmod(F.hash("item"), F.lit(SALTS)))
    return _ranked(_ranked(salted, ["lang", "source", "salt"], most).drop("salt", "rank"), ["lang", "source"], most)


def audit(docs: DataFrame, text: str, lang: str, source: str, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source against the others of its language
    (``pair``, all ranks) and the terms it has above its language (``term``, ``most_terms`` ranks)."""
    groups, cells = matrix(docs, text, lang, source, least_docs)
    pairs = _ranked(source_pairs(groups, cells), ["lang", "source"]).withColumn("part", F.lit("pair"))
    terms = source_terms(cells, most_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
