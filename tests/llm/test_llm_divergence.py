"""Source divergence against a plain count, over several blocks of rows and columns, and odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tidelog.llm import divergence


def plainly(rows, least, most):
    """Both parts as the contract words them; ``rows``: (text, lang, source)."""
    counts, seen, held = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        group = (lang or "", source or "")
        held.add(group)
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[group].update(terms)
        seen[group[0]].update(set(terms))
    out = set()
    for lang in {g[0] for g in held}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        groups = sorted(g for g in held if g[0] == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((counts[g] for g in groups), Counter()))
        p = {g: shares(counts[g]) for g in groups}
        for g in groups:
            pairs = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h[1]) for h in groups if h != g]
            terms = [(p[g][t] - q[t], t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(*g, part, name, value, i + 1) for i, (value, name) in enumerate(found) if part == "pair" or i < most}
    return out


def found_in(docs, **names):
    names = {"text": "text", "lang": "lang", "source": "source", **names}
    return {tuple(r) for r in divergence.audit(docs, least_docs=2, most_terms=5, **names).collect()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    made = []
    for i in range(400):
        lang = ["aa", "bb", None][i % 3]
        source = f"s{int(r.random() ** 2 * 19)}" if lang == "aa" else r.choice(["é", "z", None])
        words = [r.choice("Aa") + "".join(r.choice("bcdé") for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 25))]
        made.append((" ".join(words) + r.choice(["", "!", "\n12", " 中文 x"]), lang, source))
    made += [("", "aa", "quiet"), (None, "aa", "still"), ("only once", "cc", "x"), ("never twice", "cc", "y"), (None, None, None), ("9 9 9", "dd", "alone")]
    return made


def test_against_a_plain_count(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found_in(docs) == plainly(rows, 2, 5)


def test_small_tables_and_blocks_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "TABLE_ENTRIES", 3)
    monkeypatch.setattr(divergence, "TABLE_BYTES", 50)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 1)
    some = rows[:60]
    docs = spark.createDataFrame(some, "text string, lang string, source string").repartition(7)
    assert found_in(docs) == plainly(some, 2, 5)


def test_names_that_clash_and_long_texts(spark):
    rows = [("w " * 60_000 + "v", "l", "a"), ("v v", "l", "b"), ("w x", "l", "b"), ("w x", "l", "b"), ("x", "l", "c")]
    table = [(text, source, lang, "p", 1, 2) for text, lang, source in rows]
    docs = spark.createDataFrame(table, "row string, col string, n string, term string, rank int, value int")
    assert found_in(docs, text="row", lang="n", source="col") == plainly(rows, 2, 5)


def test_empty_table(spark):
    assert found_in(spark.createDataFrame([], "text string, lang string, source string")) == set()


def test_shares_are_exact_beyond_a_long(spark):
    values = [(0, 0, 1), (7, 123, 45), (9 * 10**12, 8 * 10**13, 10**6), (1, 8 * 10**13, 3)]
    df = spark.createDataFrame(values, "n long, total long, kept long")
    found = [r[0] for r in df.select(divergence.share(df.n, df.total, df.kept)).collect()]
    assert found == [1 + 10**9 * (n + 5) // (total + 5 * kept) for n, total, kept in values]
