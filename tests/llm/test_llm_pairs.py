"""Operators that compare texts: near-duplicates, repeated strings, passages, decontamination, components."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, differences

from tidelog.llm import decontaminate, neardup, passages, substrings
from tidelog.llm.catalog import ORACLES, QUERIES
from tidelog.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 2, "z") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, row string, node long, key string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert os.path.isdir(FOLDER)
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []


def joined(n, links):
    """Least node reachable from each."""
    own = list(range(n))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 230)] + [(300, i) for i in range(301, 330)]
    found = {x.node: x.label for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    labels = joined(340, links)
    assert found == {x: labels[x] for pair in links if pair[0] != pair[1] for x in pair}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_sets(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def near_texts(r):
    """Families of edited copies, some by more than the limit, so that buckets hold several components."""
    texts = [None, "", "  ", "One two", "one TWO", "one", "x" * 70_000 + " y"]
    for _ in range(4):
        first = [f"w{r.randrange(4000)}" for _ in range(r.randint(60, 160))]
        texts.append(" ".join(first))
        for k in range(14):
            copy = list(first)
            for _ in range(k % 7 + (k > 9) * 3):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts + texts[10:14]


@pytest.mark.parametrize(("seed", "block"), [(1, 300), (2, 3)])
def test_near_duplicates(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_texts(random.Random(seed))
    sets = shingle_sets(texts, 4)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    labels = joined(len(texts), links)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(spark, texts), "doc_id", "text", 4, 80).collect()}
    assert found == {i: (len(sets[i]), labels[i], labels[i] == i) for i in range(len(texts))}


def test_near_duplicates_of_repeated_rows(spark):
    rows = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, None], [7, 7, None, 7, None])
    found = neardup.near_duplicates(rows, "doc_id", "text").collect()
    assert len(found) == 5 and sum(r.kept for r in found) == 3
    assert neardup.near_duplicates(rows.limit(0), "doc_id", "text").count() == 0


def test_word_hashes_of_long_texts():
    words = [b"w%d" % i for i in range(40_000)] + [b"q" * 200_000, b"tail"]
    found = neardup.word_hashes(b" ".join(words))
    assert len(found) == len(words) == len(set(found.tolist()))
    assert found[39_000] == neardup.word_hashes(words[39_000])[0] and found[-1] == neardup.word_hashes(b"tail")[0]


def plain_removal(texts, size, keep_first):
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for d, b in enumerate(data):
        for i in range(len(b) - size + 1):
            places[b[i : i + size]].append((d, i))
    out = []
    for d, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            found = places[b[i : i + size]]
            if (min(found) < (d, i)) if keep_first else len(found) > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return out


def repeating_texts(r):
    def noise(n):
        return "".join(r.choice("abcdé ") for _ in range(n))

    shared = [noise(n) for n in (70, 90, 150, 400)]
    texts = [None, "", "short", "a" * 500, "ab" * 200]
    for _ in range(25):
        texts.append("".join(r.choice([noise(r.randint(0, 60)), r.choice(shared), r.choice(shared)[: r.randint(40, 140)]]) for _ in range(r.randint(1, 5))))
    return texts + texts[8:11]


@pytest.mark.parametrize(("seed", "group", "keep_first"), [(1, 20_000, False), (2, 20_000, True), (3, 2, False), (4, 2, True)])
def test_substring_removal(spark, monkeypatch, seed, group, keep_first):
    monkeypatch.setattr(substrings, "GROUP_CHUNKS", group)
    texts = repeating_texts(random.Random(seed))
    found = substrings.remove_repeats(documents(spark, texts), "doc_id", "text", 80, keep_first).collect()
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert rows == plain_removal(texts, 80, keep_first)
    assert sum(r[2] for r in rows) > 1000


def test_substring_removal_of_repeated_rows(spark):
    text = "".join(random.Random(9).choices("abcdefgh", k=300))
    found = substrings.remove_repeats(documents(spark, [text, text, "x"], [4, 4, None]), "doc_id", "text", 100).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in found) == [(1, 0), (300, 300), (300, 300)]
    assert substrings.remove_repeats(documents(spark, [text]).limit(0), "doc_id", "text", 100).count() == 0


def test_anchors_do_not_depend_on_segments(monkeypatch):
    data = bytes(random.Random(2).choices(b"abcd", k=3000)) + b"z" * 500 + bytes(random.Random(3).choices(b"abcd", k=2000))
    whole = substrings.anchors(data, 100)
    monkeypatch.setattr(substrings, "SEGMENT", 256)
    for a, b in zip(whole, substrings.anchors(data, 100), strict=True):
        assert (a == b).all()


def test_substring_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = sorted(texts)
    plain = [(ids[r[0]], *r[1:]) for r in plain_removal([texts[i] for i in ids], 400, False)]
    assert sorted(tuple(r) for r in QUERIES["op6_substring_removal"](spark, FOLDER).collect()) == plain


def test_compact_windows_are_the_long_nodes_of_the_cartesian_tree():
    r = np.random.default_rng(4)
    for n in (3, 10, 11, 60, 200):
        tokens = r.integers(0, 40, n, dtype=np.uint64)
        salt = np.uint64(77)
        values = (neardup.mix(tokens ^ salt) | np.uint64(1 << 63)).tolist()
        expected = []
        for p in range(n):
            left = right = p
            while left and values[left - 1] > values[p]:
                left -= 1
            while right + 1 < n and values[right + 1] >= values[p]:
                right += 1
            if right - left + 1 >= 10:
                expected.append((left, p, right))
        found = passages.compact_windows([tokens[:0], tokens, tokens[:7], tokens], 10, salt)
        rows = list(zip(*(f.tolist() for f in found[:4]), strict=True))
        assert rows == [(1, *x) for x in expected] + [(3, *x) for x in expected]


def passage_texts(r):
    def words(n):
        return [f"w{r.randrange(50_000)}" for _ in range(n)]

    shared = [words(60), words(80)]
    edited = list(shared[1])
    edited[40] = "changed"
    texts = [words(100) + shared[0] + words(30), words(10) + shared[0], shared[1] + words(300), words(40) + edited + words(5), words(200), words(49), words(55)]
    texts += [texts[6], texts[5], words(30) + shared[0][:30] + words(30)]
    return [" ".join(t) for t in texts] + [None, ""]


def test_passages(spark):
    texts = passage_texts(random.Random(8))
    found = {r.doc_id: r for r in passages.repeated_passages(documents(spark, texts), "doc_id", "text").collect()}
    assert [found[i].component_id for i in range(12)] == [0, 0, 2, 2, 4, 5, 6, 6, 8, 9, 10, 11]
    assert [(s.start, s.end) for s in found[0].spans] == [(100, 160)] and [(s.start, s.end) for s in found[1].spans] == [(10, 70)]
    assert found[2].n_repeated >= 75 and found[3].n_repeated >= 75
    assert [found[i].n_repeated for i in (4, 5, 6, 7, 8, 9, 10, 11)] == [0, 0, 55, 55, 0, 0, 0, 0]
    assert passages.repeated_passages(documents(spark, texts).limit(0), "doc_id", "text").count() == 0


def test_passage_query_finds_all_exact_repeats(spark):
    words = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    holders = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(d)
    repeated = {d for found in holders.values() if len(found) > 1 for d in found}
    found = {r.doc_id: r for r in QUERIES["op9_passage_dedup"](spark, FOLDER).collect()}
    assert found.keys() == words.keys()
    assert {d for d in repeated if found[d].n_repeated == 0} == set()
    # What else is found shares most of a passage with another document.
    pairs = Counter(found[d].component_id for d in words)
    assert all(pairs[r.component_id] > 1 for r in found.values() if r.n_repeated)


def test_decontamination_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item), (2, item), (3, "Rare-Pair"), (4, ""), (5, None), (None, "alpha")], "item_id long, text string")
    texts = [f"x {item.upper()}! y", "the rare pair rare; pair", item.replace("zeta", "nu"), None, "", item.replace("epsilon", "epsilon um"), item + " " + item]
    run = lambda **k: {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, texts), "doc_id", "text", items, "item_id", "text", **k).collect()}
    found = run()
    assert [(found[i].n_words, found[i].n_hit, found[i].items) for i in range(7)] == [
        (13, 11, ["1", "2"]), (5, 4, ["3"]), (11, 0, []), (0, 0, []), (0, 0, []), (12, 0, []), (22, 22, ["1", "2"]),
    ]
    assert run(slop=1)[5].contaminated and not run(slop=1)[2].contaminated
    none = decontaminate.decontaminate(documents(spark, texts), "doc_id", "text", items.limit(0), "item_id", "text")
    assert none.where("contaminated").count() == 0 and none.count() == 7
    assert decontaminate.decontaminate(documents(spark, texts).limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_decontamination_beyond_the_vocabulary_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "VOCABULARY_TERMS", 3)
    name = "op8_decontaminate"
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []


def test_stretches_are_fetched_once(spark):
    """However many pairs ask for a stretch of a text."""
    docs = documents(spark, [" ".join(f"w{i}" for i in range(100))]).selectExpr("doc_id AS key", "text", "xxhash64(text) AS mark")
    texts = docs.selectExpr("key AS row", "key AS own", "mark AS own_mark")
    wanted = spark.createDataFrame([(0, 5, 60)] * 500 + [(0, 7, 20)], "text long, low int, high int")
    found = {(r.text, r.low, r.high): len(r.tokens) // 8 for r in passages._fetch(docs, texts, wanted, 5).collect()}
    assert found == {(0, 5, 60): 56, (0, 7, 20): 14} and passages._fetch(docs, texts, wanted, 5).count() == 2


def test_passage_groups_are_compared_in_passes(spark, monkeypatch):
    """Every group falls into one pass, whatever the sign of its hash; all pairs that share a second hash are met."""
    r = np.random.default_rng(7)
    hashes = [int(h) for h in r.integers(-(1 << 63), 1 << 63, 12)]
    texts = [sorted(r.choice(12, 5, replace=False).tolist()) for _ in range(20)]
    each = spark.createDataFrame([(row, hashes[k], k % 7, 0, 60) for row, own in enumerate(texts) for k in own], "row long, hash long, f int, l int, r int")
    expected = []
    for b in range(20):
        for a in range(b):
            both = set(texts[a]) & set(texts[b])
            expected += [(a, b, k % 7, 0, 60, 0, 60) for k in both if any(j % 7 != k % 7 for j in both)]
    for passes in (1, passages.PASSES):
        monkeypatch.setattr(passages, "PASSES", passes)
        assert sorted(tuple(x) for x in passages._collisions(each).collect()) == sorted(expected)


def test_edited_passages_are_verified_wherever_the_edit_is():
    r = np.random.default_rng(3)
    for at in range(0, 50, 3):
        a = r.integers(0, 1 << 60, 50, dtype=np.uint64)
        b = a.copy()
        b[at] = 7
        noise = [" ".join(f"n{x}" for x in r.integers(0, 1 << 40, 60)) for _ in range(4)]
        u, v = (passages.shingle_sequence(f"{x} {' '.join(map(str, y))} {z}".encode(), 5) for x, y, z in ((noise[0], a, noise[1]), (noise[2], b, noise[3])))
        assert passages.best_stretch(u, v, 46, 80)


def test_stretches_of_both_sides_and_after_a_failed_one():
    r = np.random.default_rng(4)
    passage, other, *pieces = (r.integers(0, 1 << 60, n, dtype=np.uint64) for n in (60, 90, *[20] * 6))
    noise = lambda n: r.integers(0, 1 << 60, n, dtype=np.uint64)
    # A passage that stands once in one text and twice in the other.
    found = passages.stretches(np.concatenate([noise(30), passage, noise(30)]), np.concatenate([passage, noise(70), passage]), 46, 80)
    assert {x[2:] for x in found} == {(0, 60), (130, 190)}
    # Pieces that lie scattered in the other text share more than the passage does.
    u = np.concatenate([*pieces, noise(100), passage])
    v = np.concatenate([x for p in pieces for x in (p, noise(60))] + [passage])
    assert any(x[0] <= 222 and x[1] >= 278 for x in passages.stretches(u, v, 46, 80))


def test_members_of_a_group_are_compared_with_each_other(spark):
    """A line that leads most groups stands first and last in texts that do not hold the passage."""
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    texts, pairs = [], []
    for _ in range(40):
        line, shared = words(30), words(30)
        first = len(texts)
        texts += [words(60) + line + words(60), words(60) + shared[:10] + line + shared[10:] + words(60)]
        texts += [words(60) + shared[:10] + line + shared[10:] + words(60), words(60) + line + words(60)]
        pairs.append(first)
    found = {x.doc_id: x for x in passages.repeated_passages(documents(spark, [" ".join(t) for t in texts]), "doc_id", "text").collect()}
    assert all(found[i + 1].n_repeated == found[i + 2].n_repeated == 60 and found[i + 1].component_id == found[i + 2].component_id == i + 1 for i in pairs)


def test_all_texts_that_hold_a_passage_are_linked(spark):
    """Each with each, also where one component holds them all; two of them share a second passage."""
    r = random.Random(15)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line, own = words(80), words(70)
    texts = [words(60) + line + words(70) + (own if i in (4, 7) else words(70)) + words(60) for i in range(12)]
    found = {x.doc_id: x for x in passages.repeated_passages(documents(spark, [" ".join(t) for t in texts]), "doc_id", "text").collect()}
    assert [found[i].n_links for i in range(12)] == [11] * 12
    assert [found[i].n_repeated for i in range(12)] == [150 if i in (4, 7) else 80 for i in range(12)]
    assert {x.component_id for x in found.values()} == {0}


def test_many_windows_of_one_hash_are_compared_as_one():
    hashes, f = np.array([5, 9, 5, 5, 7] * 4), np.array([0, 1, 0, 0, 2] * 4)
    left = np.arange(20) * 10
    found = passages._few(hashes, f, left, left + 50)
    spans = sorted(zip(*(x.tolist() for x in found), strict=True))
    assert spans == [(5, 0, 0, 230), *((7, 2, 40 + 50 * i, 90 + 50 * i) for i in range(4)), *((9, 1, 10 + 50 * i, 60 + 50 * i) for i in range(4))]


def test_windows_of_enough_functions_meet():
    """At a similarity of 0.8 and with one window in common, all but one pair in a thousand."""
    n = passages.FUNCTIONS
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(passages.ENOUGH)) < 1e-3


def test_pairs_without_enough_in_common_are_not_searched(monkeypatch):
    """Neither texts that share few shingles, nor parts whose common ones lie too far apart."""
    searched = []
    best = passages._best
    monkeypatch.setattr(passages, "_best", lambda *args: searched.append(args) or best(*args))
    rng = np.random.default_rng(4)
    noise = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    common = noise(50)
    few = [np.concatenate([noise(100), common[:20], noise(100)]) for _ in range(2)]
    apart = [np.insert(noise(400), np.arange(0, 400, 8), common) for _ in range(2)]
    linked = [np.concatenate([noise(100), common, noise(100)]) for _ in range(2)]
    marks = [x.astype(np.uint16) for x in (*few, *apart, *linked)]
    assert passages._promising(marks, np.array([0, 2, 4]), np.array([1, 3, 5]), 46 * 0.8).tolist() == [False, True, True]
    assert passages.stretches(*apart, 46, 80) == [] and not searched
    assert passages.stretches(*linked, 46, 80) and searched


@pytest.mark.parametrize("deals", [1_000_000, 1])
def test_verified_stretches_in_blocks(spark, monkeypatch, deals):
    """Every pair is verified once, however stretches and pairs are dealt."""
    monkeypatch.setattr(passages, "STRETCH_BYTES", 1000)
    monkeypatch.setattr(passages, "STRETCH_BLOCKS", 3)
    monkeypatch.setattr(passages, "GROUP_PAIRS", deals)
    passage = [f"w{i}" for i in range(60)]
    texts = [" ".join([*(f"x{n}.{i}" for i in range(n)), *passage]) for n in range(6)]
    docs = documents(spark, texts).selectExpr("doc_id AS key", "text", "xxhash64(text) AS mark")
    rows = docs.selectExpr("key AS row", "key AS own", "mark AS own_mark")
    pairs = [(m, n, 0, 55 + m, 0, 55 + n) for m in range(6) for n in range(m + 1, 6)]
    frame = spark.createDataFrame(pairs, "a long, b long, a0 int, a1 int, b0 int, b1 int")
    found = sorted(tuple(r) for r in passages._verified(frame, docs, rows, 5, 46, 80).collect())
    assert found == [(m, n, m, m + 60, n, n + 60) for m, n, *_ in pairs]


def test_windows_of_a_pair_are_brought_together_over_batches(spark, monkeypatch):
    """Windows that overlap, of two functions, make one stretch; those apart or of one function none."""
    rows = [(1, 2, 0, 0, 50, 5, 60), (1, 2, 1, 40, 99, 0, 70), (1, 2, 0, 100, 150, 0, 50), (1, 3, 0, 0, 50, 0, 50), (1, 3, 1, 60, 99, 0, 50), (2, 3, 4, 7, 60, 9, 60), (2, 3, 5, 7, 55, 8, 55)]
    frame = spark.createDataFrame(rows, "a long, b long, f int, la int, ra int, lb int, rb int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = sorted(tuple(r) for r in passages._candidates(frame).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == [(1, 2, 0, 99, 0, 70), (2, 3, 7, 60, 8, 60)]
