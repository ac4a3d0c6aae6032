"""Hard negatives against a plain search, over several pages, blocks and groups, and odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, cluster int, norm string"


def plainly(rows, positives=5, many=10):
    """The search as the contract words it; ``rows``: (id, vector, label)."""
    part = [
        (key, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for key, v, label in rows
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    last = math.inf
    for a, (key, v, label) in enumerate(part):
        if key is None or key % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last if k is None else k, i, k, own) for i, (k, w, own) in enumerate(part) if i != a]
        scored.sort(key=lambda s: s[:3])
        for minus, _, _, positive, _ in [s for s in scored if s[4] == label][:positives]:
            band = [s for s in scored if s[4] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus]
            out += [(key, positive, rank, s[3], -minus, -s[0]) for rank, s in enumerate(band[:many], 1)]
    return sorted(out, key=str)


def found_in(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in negatives.mine(docs, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0, **more).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    centers = r.normal(size=(5, 12))
    made = []
    for i in range(700):
        v = centers[i % 5] + r.normal(size=12) * 0.7
        made.append((i, (v / np.linalg.norm(v) * r.choice([0.5, 1, 3])).tolist(), int(r.integers(4))))
    # A third of all rows are one vector, over several labels: ties all along.
    made += [(1000 + i, [0.25] * 12, i % 3) for i in range(350)]
    return made


def test_against_a_plain_search(spark, rows):
    assert found_in(spark, rows) == plainly(rows)


def test_pages_blocks_and_groups_do_not_matter(spark, rows, monkeypatch):
    for name, value in (("PAGE_ROWS", 32), ("PAGE_GROWTH", 4), ("BLOCK_ROWS", 50), ("GROUP_MEMBERS", 5), ("PER_CENTER", 16), ("SAMPLE", 40)):
        monkeypatch.setattr(negatives, name, value)
    assert found_in(spark, rows[::3]) == plainly(rows[::3])


def test_members_stop_before_the_end_of_their_lists(spark, rows):
    vectors, shape = negatives.prepare(spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA), "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0)
    members, centers, widest, _ = negatives.assign(vectors, shape)
    listed = vectors.collect()
    x = shape.rows([bytes(r.v) for r in listed])
    bounds = negatives._bounds(x, np.array([r.norm for r in listed]), centers, widest)
    for m in members.collect():
        assert (x @ shape.rows([bytes(m.v)])[0] <= m.norm * bounds[:, m.cluster]).all()


def test_nulls_and_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.5], 1), (10, [0.0, 0.0], 1), (20, [1.0, 0.5, 0.25], 1), (None, [1.0, 0.4], 1), (None, [0.6, 0.2], 2), (3, [0.5, 0.1], 2), (4, [], 2), (5, None, 2),
        (6, [0.7, None], 2), (7, [0.7, float("nan")], 2), (8, [float("inf"), 1.0], 2), (30, [0.7, 0.3], None), (0, [1.0, 0.5], 1), (9, [0.5, 0.1], 2), (40, [-1.0, -1.0], 3), (41, [1.0, 1.0], 3),
    ]
    assert found_in(spark, rows) == plainly(rows)
    # Products that floating types cannot hold are exact all the same.
    large = [(i, [float(2**19 - i), 0.125 + i, -1.0], i % 2) for i in range(21)]
    assert found_in(spark, large) == plainly(large)
    tiny = [(i, [2.0**12 + i / 256, 1.0], i % 2) for i in range(21)]
    assert found_in(spark, tiny, high=100) != [] and found_in(spark, tiny) == plainly(tiny)


def test_tables_without_rows_or_anchors(spark):
    assert found_in(spark, [(1, [1.0], 1), (2, [0.5], 2)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0).collect() == []
    assert found_in(spark, [(10, [], 1), (20, [], 1), (1, [], 2)]) == plainly([(10, [], 1), (20, [], 1), (1, [], 2)])
