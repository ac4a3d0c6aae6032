"""Document fingerprints: a digest of the quartiles of hashed byte triplets.

Three gapped triplets start at every byte of the UTF-8 text; their hashes are
counted in 256 buckets. The digest holds, in hex, the length on a log scale, how
the quartiles of the counts relate, and for each bucket the quartile that its
count falls into. The difference of two digests is a bounded sum over the three.

Comparing neighbours in descending order of the key takes one shuffle: keys are
cut into parts at approximate quantiles, a part is sorted within one task, and
the first row of the following part is added to its end. Memory of a task: two
texts and one batch; the driver sees the cut points only.

Defined results: a null text counts as empty; texts under three bytes have no
triplets (all buckets in the lowest quartile); rows of equal key are ordered by
descending text; null keys come last; a single row is its own neighbour; an empty
table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import sha256, slices, small

BUCKETS = 256
# Offsets of the second and third byte of a triplet.
TRIPLETS = ((1, 2), (1, 3), (2, 3))
# A difference of this much or more is a likeness of 0.
MOST_DIFFERENT = 400
# Bytes counted at a time, which bounds the memory for a long text.
CHUNK = 1 << 18


def counts(data: bytes) -> np.ndarray:
    """Triplets in each bucket."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(data), CHUNK):
        x = np.frombuffer(data, dtype=np.uint8, offset=start, count=min(CHUNK + 3, len(data) - start)).astype(np.uint32)
        for salt, (i, j) in enumerate(TRIPLETS):
            n = min(len(x) - j, CHUNK)
            if n > 0:
                mixed = (x[:n] * np.uint32(0x01000193) + x[i : i + n] * np.uint32(0x0001F35B) + x[j : j + n] + np.uint32(salt)) * np.uint32(0x9E3779B1)
                out += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(data: bytes) -> str:
    c = counts(data)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    body = (codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]).astype(np.uint8).tobytes()
    length = min(255, round(math.log1p(len(data)) / math.log(1.1)))
    ratios = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    return bytes((length, ratios)).hex() + body.hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests, ``MOST_DIFFERENT`` at most."""
    x, y = (np.frombuffer(bytes.fromhex(d), dtype=np.uint8).astype(np.int16) for d in (a, b))
    head = min(40, 2 * abs(int(x[0]) - int(y[0]))) + abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))
    body = sum(int(np.abs((x[2:] >> s & 3) - (y[2:] >> s & 3)).sum()) for s in (0, 2, 4, 6))
    return min(MOST_DIFFERENT, int(head) + body)


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / MOST_DIFFERENT


def half_replaced(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows ``part, border, key, text`` dealt so that each part is in one task, sorted
    downwards, and ends with a border row: the first row of the next part."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("key"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", F.when(F.col("key").isNull(), len(cuts) + 1).otherwise(part))
    tops = {r.part: r.top for r in rows.groupBy("part").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops)
    follows = spark.createDataFrame([(b, a) for a, b in zip(order, order[1:] + order[:1], strict=True)], "part int, before int")
    first = small(spark.createDataFrame(list(tops.items()), f"part int, top {dict(docs.dtypes)[key]}"), len(tops))
    edge = rows.join(first, (rows.part == first.part) & rows.key.eqNullSafe(first.top)).select(rows.part, rows.key, rows.text)
    edge = edge.groupBy("part").agg(F.max(F.struct("key", "text")).alias("m")).join(small(follows, len(order)), "part")
    edge = edge.select(F.col("before").alias("part"), F.lit(True).alias("border"), "m.key", "m.text")
    both = rows.select("part", F.lit(False).alias("border"), "key", "text").unionByName(edge)
    dealt = both.repartition("part").sortWithinPartitions("part", "border", F.desc("key"), F.desc("text"))
    return dealt, len(order)


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's digest, that of its half-replaced text, and their likeness and that to the next row."""
    dealt, _ = with_next(docs, key, text)
    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    schema = f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches):
            out: dict[str, list] = {name: [] for name in names}
            for part, border, own, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = digest(body.encode())
                if last is not None and last[0] == part:
                    _, before, old, old_mark = last
                    edited = half_replaced(old, body).encode()
                    edited_mark = digest(edited)
                    made = (before, len(old), sha256(edited), old_mark, edited_mark, likeness(old_mark, edited_mark), likeness(old_mark, mark))
                    for name, value in zip(names, made, strict=True):
                        out[name].append(value)
                last = None if border else (part, own, body, mark)
            arrays = [pa.array(out[key], batch.column(2).type), pa.array(out["n_chars"], pa.int64())]
            arrays += [pa.array(out[n], pa.string()) for n in names[2:5]] + [pa.array(out[n], pa.float64()) for n in names[5:]]
            yield pa.record_batch(arrays, names=names)

    return dealt.mapInArrow(run, schema)
