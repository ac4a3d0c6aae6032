"""Language-model scores and the pipeline, against plain versions."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import lm
from tidelog.llm.catalog import QUERIES
from tidelog.llm.common import fold, stored

FOLDER = "/root/testdata/sf0.001"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 3, "w") for i, t in enumerate(texts)], "doc_id long, text string, n long, word string")


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_lm_query_base_scores_and_held_out_gain(spark):
    found = {r.doc_id: r for r in QUERIES["op10_lm_scoring"](spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    assert {i for i, r in found.items() if r.held_out} == held and found.keys() == texts.keys()
    counts = Counter(t for i, x in texts.items() if i not in held for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for i, x in texts.items():
        own = tokens(x)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    # Words of a text turned around are spelled as no word of the language is.
    some = sorted(held)[:5]
    turned = [" ".join(w[::-1] for w in (texts[i] or "").split()) for i in some]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(turned)], "doc_id long, text string")
    again = {r.doc_id: r.score for r in lm.score(docs.union(extra), "doc_id", "text", (fold("doc_id", 5) != 1) & (F.col("doc_id") < 10**9)).collect()}
    assert all(again[10**9 + k] < again[i] for k, i in enumerate(some))


def test_lm_cases(spark):
    docs = documents(spark, [None, "", "  ", "a b a", "a b a", "zq", "x" * 5000])
    found = {r.doc_id: r for r in lm.score(docs, "doc_id", "text", F.col("doc_id") < 5).collect()}
    assert [found[i].n_tokens for i in range(7)] == [1, 1, 1, 4, 4, 2, 2]
    assert found[0].score == found[1].score == found[2].score > found[5].score > found[6].score
    assert [found[i].n_known for i in (3, 5)] == [4, 1] and found[3].train_tokens == 11
    assert lm.score(docs.limit(0), "doc_id", "text", F.lit(True)).count() == 0
    untrained = lm.score(docs, "doc_id", "text", F.lit(False)).collect()
    assert len(untrained) == 7 and all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)


def test_lm_scores_of_long_spellings(spark):
    """No least score: ten times as many unlikely characters cost ten times as much."""
    docs = documents(spark, ["a b a", "a c", *("中文" * n for n in (200, 2000))])
    found = {r.doc_id: r.score for r in lm.score(docs, "doc_id", "text", F.col("doc_id") < 2).collect()}
    assert found[2] < -1000 and found[3] == pytest.approx(10 * found[2], rel=0.02)


def test_probabilities_sum_to_one():
    """Of the spelling model: over all next characters in a context."""
    r = np.random.default_rng(1)
    import pandas as pd

    triples = np.unique(r.integers(97, 102, (60, 3)) @ np.array([65536, 256, 1]))
    triples = triples[(triples >> 8 & 255) == 98]
    frame = pd.DataFrame({"triple": triples, "n": r.integers(1, 500, len(triples))})
    found = lm._gibbs_characters(frame, np.full(256, 1 / 256), 3)
    part = {k: x.set_index("at")["value"] for k, x in found.groupby("kind")}
    single = part["single"].to_numpy()
    assert single.sum() == pytest.approx(1)
    for pair, weight in part["pair"].items():
        known = part["triple"][[t for t in part["triple"].index if t >> 8 == pair]]
        rest = single[[x for x in range(256) if (pair << 8 | x) not in known.index]].sum() * weight
        assert known.sum() + rest == pytest.approx(1)


def test_seating_counts():
    r = np.random.default_rng(2)
    counts = np.array([0, 1, 2, 30, 1000, 100_000], dtype=np.float64)
    tables = np.mean([lm.seat(counts, np.full(6, 5.0), 0.0, r) for _ in range(300)], axis=0)
    # Without a discount: expected tables of a Chinese restaurant of strength 5.
    expected = [sum(5 / (5 + k) for k in range(int(c))) for c in counts]
    assert tables == pytest.approx(expected, rel=0.06)


def test_reseating_draws_from_the_exact_distribution():
    """Against all partitions of a dish's customers, priced table by table."""

    def partitions(n):
        if n == 0:
            yield []
            return
        for rest in partitions(n - 1):
            yield [*rest, 1]
            for k in range(len(rest)):
                yield [*rest[:k], rest[k] + 1, *rest[k + 1 :]]

    r = np.random.default_rng(4)
    discount, p, others, n = 0.6, 0.2, 7.0, 5
    chances = np.zeros(n + 1)
    for tables in partitions(n):
        chance = math.prod((lm.STRENGTH + discount * (others + k)) * p for k in range(len(tables)))
        chance *= math.prod(math.prod(k - discount for k in range(1, size)) for size in tables)
        chances[len(tables)] += chance
    rows = 40_000
    drawn = lm.reseat(np.full(rows, float(n)), np.full(rows, 2.0), others + 2, np.full(rows, math.log(p)), discount, r)
    assert np.bincount(drawn.astype(int), minlength=n + 1) / rows == pytest.approx(chances / chances.sum(), abs=0.01)
    few = lm.reseat(np.array([0.0, 1.0, 500.0]), np.array([0.0, 1.0, 3.0]), 9.0, np.log(np.full(3, 0.1)), discount, r)
    assert few[0] == 0 and few[1] == 1 and 1 <= few[2] <= 500


def test_lm_scores_depend_on_order(spark):
    known = "the quick brown fox jumps over the lazy dog while the slow red hen sleeps under a tall green tree"
    docs = documents(spark, [known] * 4 + ["a red tree sleeps", known, " ".join(reversed(known.split()))])
    found = {r.doc_id: r for r in lm.score(docs, "doc_id", "text", F.col("doc_id") < 5).collect()}
    assert found[5].base_score == pytest.approx(found[6].base_score)
    assert found[5].score > found[6].score + 5 and found[5].score == pytest.approx(found[0].score)
    assert found[5].score > found[5].base_score


def test_lm_probabilities_of_next_words_sum_to_one(spark):
    """Over the known words after a known one, with the rest left to spellings of unknown words."""
    texts = ["a b a c a b", "b a c c a", "c a b b b a", "a", "b c"]
    vocabulary = ["a", "b", "c"]
    asked = [f"a {w}" for w in vocabulary] + ["a"]
    docs = documents(spark, texts + asked + ["a zz"])
    found = {r.doc_id: r.score for r in lm.score(docs, "doc_id", "text", F.col("doc_id") < len(texts)).collect()}
    # Texts of one and two words: what is left of each first word for further words is not negative.
    one = 10 ** found[len(texts) + 3]
    two = [10 ** found[len(texts) + k] for k in range(3)]
    assert 0 < one + sum(two) < 1 and 10 ** found[len(texts) + 4] < min(two)


def test_lm_blocks_are_told_by_parts_of_their_pairs(spark):
    """A block asks with a row for each part of its pairs, not for each pair, and is told what it does not know itself."""
    r = np.random.default_rng(4)
    docs = documents(spark, [" ".join(f"w{k}" for k in r.integers(0, 12, 30)) for _ in range(40)]).repartition(5, "doc_id").cache()
    blocks = lm._blocks(docs, "doc_id", "text", F.col("doc_id") < 30)
    pairs = [tuple(x) for x in lm._pairs(blocks).collect()]
    counts = Counter()
    for _, _, u, w, n in pairs:
        counts[u, w] += n
    seated = {x: c - 0.5 + (0.25 if c > 2 else 0) for x, c in counts.items() if c}
    expected = {(b, number): seated[u, w] for b, number, u, w, n in pairs if (u, w) in seated and seated[u, w] != (n - 0.5 if n else 0.0)}
    frame = spark.createDataFrame([(u, w, e) for (u, w), e in seated.items()], "u long, w long, e double")
    n_blocks = blocks.count()
    assert n_blocks > 1 and 0 < len(expected) < len(pairs)
    for parts in (1, 7):
        assert lm._packed_blocks(blocks, parts).count() <= n_blocks * parts < len(pairs)
        found = {}
        for row in lm._told(blocks, frame, parts, 0.5).collect():
            for piece in row.x:
                found |= {(row.block, k): e for k, e in zip(np.frombuffer(piece.numbers, dtype=np.int32).tolist(), np.frombuffer(piece.e), strict=True)}
        assert found == pytest.approx(expected)
    # Passes over the blocks give every row once.
    rows = lm.score(docs.union(docs.where("doc_id < 10")), "doc_id", "text", F.col("doc_id") < 30).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(40), *range(10)])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_lm_columns_named_like_its_own_and_odd_keys(spark):
    rows = [(None, "x y", 1, "k"), (3, "x y", 2, "k"), (3, "x y", None, None), (4, None, 1, "k")]
    docs = spark.createDataFrame(rows, "id int, body string, block int, word string").withColumn("hash", F.lit(1)).withColumn("u", F.lit(2))
    found = lm.score(docs, "id", "body", F.col("id") < 4)
    assert found.columns == ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = sorted(found.collect(), key=lambda r: (r.id or 0))
    assert [(r.id, r.held_out, r.n_tokens, r.train_tokens) for r in rows] == [(None, False, 3, 9), (3, False, 3, 9), (3, False, 3, 9), (4, True, 1, 9)]
    assert rows[0].score == rows[1].score == rows[2].score


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_lm_is_above_the_base_on_held_out_text(spark):
    found = QUERIES["op10_lm_scoring"](spark, FOLDER.replace("sf0.001", "sf0.1")).where("held_out")
    ours, base = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert ours > base


def test_pipeline_stages(spark):
    from test_llm_maps import plain_spans
    from test_llm_pairs import joined, shingle_sets

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34 !", None, "s", 7), (10**6 + 1, None, None, None, None), (10**6 + 2, "the " * 9, None, "s", 36)], docs.schema)
    docs = stored(docs.unionByName(odd), "input")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        kept.append(rows)
        docs = stored(stage(spark, docs, FOLDER), name)
        if name != "tokens":
            assert docs.columns == names
    first, second, third, fourth, fifth = kept
    last = {r.doc_id: r for r in docs.collect()}
    # Language: all but the text without letters and the missing one stay.
    assert first.keys() - second.keys() == {10**6, 10**6 + 1} and second[10**6 + 2].lang
    # One of each group of near-duplicates stays.
    ids = sorted(second)
    sets = shingle_sets([second[i].text for i in ids], 5)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert third.keys() == {ids[i] for i in set(joined(len(ids), links))}
    # Documents with a window of a benchmark item go.
    hit = {r.doc_id for r in QUERIES["op8_decontaminate"](spark, FOLDER).where("contaminated").collect()}
    assert fourth.keys() == third.keys() - hit
    # All stay; what the patterns find is gone, and texts without a match are as they were or lost a span.
    assert fifth.keys() == fourth.keys() == last.keys()
    for i, r in fifth.items():
        assert plain_spans(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == fourth[i].text or "[secret]" in r.text
        assert last[i].n_tokens == len(last[i].ids)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and found.count() > 100


def test_stages_keep_columns_named_like_their_own(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "keep", 7, "k"), (2, words, "en", "drop", 8, "k"), (3, "other words here", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, name string, hash long, NAME_ string")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        found = {r.doc_id: (r.name, r.hash, r.NAME_) for r in kept.collect()}
        assert found[1] == ("keep", 7, "k") and found[3] == (None, None, None)
        assert (2 in found) == (stage is corpus_pipeline.drop_contaminated)


def test_language_stage_keeps_columns_of_any_name_and_type(spark):
    rows = [(i, f"the cat and the dog number {i}", "en", "mine", 0.5, [1, 2], {"a": 1}) for i in range(3)] + [(9, "12", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, `a b` array<int>, m map<string,int>")
    kept = corpus_pipeline.identify_language(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.lang_pred, r.score, tuple(r["a b"]), r.m["a"]) for r in kept.collect()} == {(i, "mine", 0.5, (1, 2), 1) for i in range(3)}


def test_blocks_come_to_a_worker_one_by_one(spark):
    """Also those of one partition, while tables over blocks are stored; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def rows(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["id"])

    with lm._block_by_block(spark):
        assert {r.id for r in spark.range(0, 5, 1, 1).mapInArrow(rows, "id long").collect()} == {1}
    assert spark.conf.get(name) == before
