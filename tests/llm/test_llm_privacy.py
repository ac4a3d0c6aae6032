"""Personal data: base spans against the plain patterns, planted disguises, odd tables."""

import hashlib
import random
import re

import pytest

from tidelog.llm import privacy
from tidelog.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plainly(text):
    """The base spans as the contract words them."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))] if digits else []
            fits = (
                True,
                kind == 1 and all(int(part) <= 255 for part in match[0].split(".")),
                13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0,
                9 <= len(digits) <= 15,
            )
            if fits[kind]:
                found.append((kind, *match.span()))
    return found


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(5)
    for letters in ("aB1234567890.@+-() %_", "ab.@-1", "01.25", "+1 4-(", "0123456789 -"):
        for _ in range(4000):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
            assert privacy.plain_spans(text) == plainly(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to mara [at] nest [dot] org today", "email", "mara [at] nest [dot] org"),
        ("it is kim dot lo at hill dot example", "email", "kim dot lo at hill dot example"),
        ("bо@exаmple.com", "email", "bо@exаmple.com"),
        ("a​da＠hill．example", "email", "a​da＠hill．example"),
        ("host 10[.]20(dot)30 dot 40!", "ip", "10[.]20(dot)30 dot 40"),
        ("one zero dot two zero dot three dot nine", "ip", "one zero dot two zero dot three dot nine"),
        ("ring plus four nine three zero double one two 3 4 5 6 now", "phone", "plus four nine three zero double one two 3 4 5 6"),
        ("tel +４４ 20–7946–0958.", "phone", "+４４ 20–7946–0958"),
        ("n° 4O12 8888 8888 l88l", "card", "4O12 8888 8888 l88l"),
        ("\U0001d7d2\U0001d7ce12-8888-8888-1881", "card", "\U0001d7d2\U0001d7ce12-8888-8888-1881"),
        ("quatre zéro un deux huit huit huit huit huit huit huit huit un huit huit un", "card", "quatre zéro un deux huit huit huit huit huit huit huit huit un huit huit un"),
    ],
)
def test_disguised_identifiers_come_back_at_their_source(text, kind, span):
    added = [(privacy.KINDS[k], text[a:b]) for k, a, b, new in privacy.find(text) if new]
    assert added == [(kind, span)]


@pytest.mark.parametrize(
    "text",
    ["see you at example.com", "a polka dot dress at home", "one two three four five six", "the 3 of us at 5 point 2", "Привет, как дела", "+1 (848) 555-1373 Un un",
     "½ cup², 10³ and №5", "he was born in l9 5O", "(.) [@] {dot}", "un un un deux un un", "1 000 000 000 001"],
)
def test_clean_texts_stay_clean(text):
    assert [s for s in privacy.find(text) if s[3]] == []


def test_base_spans_stay_beside_wider_ones():
    text = "kо.x@hill.example"
    assert privacy.find(text) == [(0, 0, 17, True), (0, 2, 17, False)]
    assert privacy.find("x@hill.example [dot] org")[-1] == (0, 0, 24, True)


def test_long_texts_take_linear_time():
    for piece in ("a", "1", "1 ", "+", "@", "+1", "(", "a@b.", "1.1.", "1l", "a at ", "@a.b ", "о", "[ "):
        privacy.find(piece * (200_000 // len(piece)))
    assert len(privacy.find("one two " * 5000)) == 0


def test_odd_tables(spark):
    rows = [(None, None, "a"), (1, "", "b"), (1, "mail a@b.co", "c"), (1, "mail a@b.co", "c"), (2, "x" * 300_000 + " 10.0.0.1", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    found = privacy.scan(docs, "doc_id", "text").collect()
    assert sorted(((r.doc_id or 0), r.kinds, r.starts) for r in found) == [(0, [], []), (1, [], []), (1, [0], [5]), (1, [0], [5]), (2, [1], [300_001])]
    assert privacy.scan(docs.limit(0), "doc_id", "text").collect() == []
    hidden = privacy.redact(docs, "text")
    assert hidden.columns == docs.columns
    assert [r.text for r in hidden.orderBy("kinds").collect()][:4] == [None, "", "mail [email]", "mail [email]"]
    both = spark.createDataFrame([("kо.x@hill.example 10.0.0.1",)], "text string")
    assert privacy.redact(both, "text").first().text == "[email] [ip]"


def test_query_against_the_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op12_pii"](spark, FOLDER).collect()}
    assert found.keys() == texts.keys()
    for key, text in texts.items():
        base = plainly(text)
        named = [f"{privacy.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert [found[key][f"n_{name}"] for name in privacy.KINDS] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert found[key].base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(found[key].spans.split(","))
    assert sum(r.n_email for r in found.values()) > 0
