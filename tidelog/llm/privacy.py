"""Personal data in texts, disguised or plain, by offset-preserving transducers.

A text goes through a chain of transducers: lookalike characters become ASCII,
invisible ones go, ``[at]`` and ``dot`` become ``@`` and ``.``, spelled digits and
letters that pose as digits become digits. Each of them carries, for every
character it writes, the span of the source it came from and whether it was
rewritten. The detectors run over the source and over the normalised text; a match
of the latter that holds a rewritten character is mapped back to the source and
added, unless it lies inside a match of its kind that the source gave.

All of it is linear in the text, and most texts hold no disguise: one search tells.

Defined results: a null text counts as empty and has no spans; rows of equal or null
key are separate rows; an empty table gives no rows; spans are in code points, end
exclusive, sorted by kind, start and end; only the two named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import by_batch, ship

KINDS = ("email", "ip", "card", "phone")
# A run of spelled digits counts from so many digits on (4 if it has dots), a third of them in words.
LEAST_SPELLED = 7
# A run of digits with lookalike letters needs so many real digits.
LEAST_DIGITS = 8

# Letters of other scripts that look like ASCII letters, and what they look like.
LOOKALIKES = "аеіјорсухѕԁһӏԛԝАВЕІЈКМНОРСТХЅԌԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧονа"
LOOK_LIKE = "aeijopcyxsdhlqwABEIJKMHOPCTXSGQWABEZHIKMNOPTYXova"
# The words for the signs, and for the digits from 0 on, by language.
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punto", "point", "punkt")
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)

# detectors over plain text: spans of a kind, leftmost, without overlap

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with a domain, and the run of local characters before it: as a search
    for the whole pattern gives, but without trying each start of a long run."""
    taken = 0
    for found in _DOMAIN.finditer(text):
        at = found.start()
        least = max(taken, text.rfind("@", 0, at) + 1)
        start = at - _LOCAL.match(text[least:at][::-1]).end()
        if start < at:
            yield start, found.end()
            taken = found.end()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found.groups()):
            yield found.span()


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(found[0])) <= 15:
            yield found.span()


DETECTORS: tuple[Callable[[str], Iterator[tuple[int, int]]], ...] = (_emails, _addresses, _cards, _phones)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the matches in the text as it is."""
    return [(kind, *span) for kind, detect in enumerate(DETECTORS) for span in detect(text)]


# transducers


@dataclass(frozen=True)
class Traced:
    """A text whose characters know the span of the source they stand for."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    rewritten: np.ndarray

    @staticmethod
    def of(source: str) -> Traced:
        places = np.arange(len(source) + 1)
        return Traced(source, places[:-1], places[1:], np.zeros(len(source), dtype=bool))

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])

    def replaced(self, edits: list[tuple[int, int, str]]) -> Traced:
        """``edits``: ``(start, end, new)``, in order and apart. What is written anew stands
        for the whole of what it replaces; a deletion marks the character after it."""
        if not edits:
            return self
        texts, starts, ends, marks, at, cut = [], [], [], [], 0, False

        def keep(upto: int) -> None:
            nonlocal cut
            texts.append(self.text[at:upto])
            starts.append(self.starts[at:upto])
            ends.append(self.ends[at:upto])
            mark = self.rewritten[at:upto]
            if cut and len(mark):
                mark = mark.copy()
                mark[0], cut = True, False
            marks.append(mark)

        for start, end, new in edits:
            keep(start)
            texts.append(new)
            if new:
                starts.append(np.full(len(new), self.starts[start]))
                ends.append(np.full(len(new), self.ends[end - 1]))
                marks.append(np.ones(len(new), dtype=bool))
            else:
                cut = True
            at = end
        keep(len(self.text))
        return Traced("".join(texts), np.concatenate(starts), np.concatenate(ends), np.concatenate(marks))


def _folding() -> dict[int, str]:
    """Characters that compatibility or looks make one ASCII character; raised and lowered digits stay."""
    table = {}
    for code in [*range(0x80, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x1FBF0, 0x1FBFA)]:
        char = chr(code)
        if unicodedata.decomposition(char).startswith(("<super>", "<sub>")):
            continue
        digit = unicodedata.decimal(char, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if unicodedata.category(char) == "Pd":
            plain = "-"
        if len(plain) == 1 and plain.isascii():
            table[code] = plain
    table.update({ord(a): b for a, b in zip(LOOKALIKES, LOOK_LIKE, strict=True)})
    table.update({0x2212: "-", 0x3002: ".", 0x2024: "."})
    return table


_FOLD = _folding()
# Code points that are not seen, first and last of each range.
_UNSEEN = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x2060, 0x2064), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _UNSEEN) + "]+")
_ODD = frozenset([*map(chr, _FOLD), *(chr(code) for a, b in _UNSEEN for code in range(a, b + 1))])


def _one_of(words: tuple[str, ...] | list[str]) -> str:
    return "(?i:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + ")"


_GAP = "[ \t]{0,3}"
_IN_BRACKETS = rf"{_GAP}[\[({{<]{_GAP}%s{_GAP}[\])}}>]{_GAP}"
_DOT = re.compile(
    _IN_BRACKETS % rf"(?:{_one_of(DOT_WORDS)}|\.)" + rf"|(?<=[A-Za-z0-9])[ \t]{{1,3}}{_one_of(DOT_WORDS)}[ \t]{{1,3}}(?=[A-Za-z0-9])"
)
_AT = re.compile(_IN_BRACKETS % f"(?:{_one_of(AT_WORDS)}|@)")
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}{_one_of(AT_WORDS)}[ \t]{{1,3}}(?=((?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])))")
_VALUES = {word: str(value) for words in DIGIT_WORDS for value, word in enumerate(words.split())}
_WORD = _one_of(list(_VALUES))
_TIMES = {"double": 2, "triple": 3}
_TOKEN = rf"(?:(?i:double|triple)[ -])?{_WORD}(?![^\W\d_])|[0-9]+"
_RUN = re.compile(rf"(?<![^\W_])(?:(?i:plus)[ -])?(?:{_TOKEN})(?:(?:[ \t]{{1,2}}|[.-])(?:{_TOKEN}))+")
_PART = re.compile(rf"(?P<plus>(?i:plus)[ -])|(?:(?P<times>(?i:double|triple))[ -])?(?P<word>{_WORD})(?![^\W\d_])|(?P<digits>[0-9]+)|(?P<gap>.)", re.S)
_GROUP = "[OolI]*[0-9][0-9OolI]*"
_POSED = re.compile(rf"(?<![A-Za-z0-9]){_GROUP}(?:[ -]{_GROUP})*(?![A-Za-z0-9])")
_LETTERS = re.compile("[OolI]")
_POSES = {"O": "0", "o": "0", "l": "1", "I": "1"}
# What a lower-case text must hold for any transducer but the first two to write something.
_WORDS = "|".join(_VALUES)
_TRIGGER = re.compile(
    rf"(?:{_WORDS})[ \t.-]{{1,2}}(?:[0-9]|{_WORDS}|double|triple)|[0-9][ \t.-]{{1,2}}(?:{_WORDS}|double|triple)"
    rf"|[0-9][ -]?[oil]|[oil][0-9]|[\[({{<]{_GAP}(?:{'|'.join([*AT_WORDS, *DOT_WORDS])}|[.@]){_GAP}[\])}}>]|[ \t](?:{'|'.join(DOT_WORDS)})[ \t]"
)


def fold(traced: Traced) -> Traced:
    """Lookalikes become ASCII, one for one."""
    text = traced.text
    if text.isascii():
        return traced
    plain = text.translate(_FOLD)
    changed = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) != np.frombuffer(plain.encode("utf-32-le"), dtype=np.uint32)
    return Traced(plain, traced.starts, traced.ends, traced.rewritten | changed)


def drop_invisible(traced: Traced) -> Traced:
    return traced.replaced([(*found.span(), "") for found in _INVISIBLE.finditer(traced.text)])


def dots(traced: Traced) -> Traced:
    return traced.replaced([(*found.span(), ".") for found in _DOT.finditer(traced.text)])


def ats(traced: Traced) -> Traced:
    """A bracketed sign always; a bare word only before a domain with a disguised dot."""
    edits = [(*found.span(), "@") for found in _AT.finditer(traced.text)]
    for found in _BARE_AT.finditer(traced.text):
        domain = found[1]
        signs = [found.start(1) + i for i, char in enumerate(domain) if char == "."]
        if traced.rewritten[signs].any():
            edits.append((*found.span(), "@"))
    return traced.replaced(sorted(edits))


def spelled_digits(traced: Traced) -> Traced:
    """Runs of digit words, with numerals among them; gaps between two words go."""
    edits = []
    for run in _RUN.finditer(traced.text):
        parts = list(_PART.finditer(run[0]))
        spelled = sum(_TIMES.get((p["times"] or "").lower(), 1) for p in parts if p["word"])
        count = spelled + sum(len(p["digits"] or "") for p in parts)
        if 3 * spelled < count or spelled < 3 or count < (4 if "." in run[0] else LEAST_SPELLED):
            continue
        for place, part in enumerate(parts):
            start, end = (run.start() + x for x in part.span())
            if part["word"]:
                edits.append((start, end, _VALUES[part["word"].lower()] * _TIMES.get((part["times"] or "").lower(), 1)))
            elif part["plus"]:
                edits.append((start, end, "+"))
            elif part["gap"] and part["gap"] != ".":
                sides = [p for p in (parts[max(0, place - 2) : place][::-1], parts[place + 1 : place + 3])]
                near = [next((p for p in side if not p["gap"]), None) for side in sides]
                if all(p is not None and p["word"] for p in near):
                    edits.append((start, end, ""))
    return traced.replaced(edits)


def posing_letters(traced: Traced) -> Traced:
    """O, o, l and I in a run that is mostly digits."""
    edits = []
    for run in _POSED.finditer(traced.text):
        letters = list(_LETTERS.finditer(run[0]))
        digits = len(_DIGIT.findall(run[0]))
        if letters and digits >= max(LEAST_DIGITS, 2 * len(letters)):
            edits += [(run.start() + f.start(), run.start() + f.end(), _POSES[f[0]]) for f in letters]
    return traced.replaced(edits)


TRANSDUCERS = (fold, drop_invisible, dots, ats, spelled_digits, posing_letters)


def normalised(text: str) -> Traced | None:
    """The text after all transducers; None where none of them can write anything."""
    if (text.isascii() or _ODD.isdisjoint(text)) and not _TRIGGER.search(text.lower()):
        return None
    traced = Traced.of(text)
    for transducer in TRANSDUCERS:
        traced = transducer(traced)
    return traced if traced.rewritten.any() else None


def find(text: str) -> list[tuple[int, int, int, bool]]:
    """``(kind, start, end, added)`` in the source, sorted; ``added``: behind a disguise."""
    base = plain_spans(text)
    traced = normalised(text)
    added = set()
    if traced is not None:
        marks = np.concatenate(([0], np.cumsum(traced.rewritten)))
        for kind, start, end in plain_spans(traced.text):
            if marks[end] > marks[start]:
                added.add((kind, *traced.source_span(start, end)))
    if added:
        inside = _inside(sorted(added), base)
        added = {span for span, within in zip(sorted(added), inside, strict=True) if not within}
    return sorted([(*span, False) for span in base] + [(*span, True) for span in added])


def _inside(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Whether a base span of the same kind covers each span; base spans of a kind do not overlap."""
    keys = np.array([(kind << 40) + start for kind, start, _ in base], dtype=np.int64)
    found = []
    for kind, start, end in spans:
        at = int(np.searchsorted(keys, (kind << 40) + start, side="right")) - 1
        found.append(at >= 0 and base[at][0] == kind and base[at][2] >= end)
    return found


# over tables


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row ``key`` and the parallel arrays ``kinds`` (places in ``KINDS``), ``starts``, ``ends`` and ``added``."""
    kind = dict(docs.dtypes)[key].replace("bigint", "long")

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {key: batch.column(0), "kinds": [], "starts": [], "ends": [], "added": []}
        for body in batch.column(1).to_pylist():
            spans = find(body) if body else []
            for name, values in zip(("kinds", "starts", "ends", "added"), zip(*spans, strict=True) if spans else [()] * 4, strict=True):
                out[name].append(list(values))
        return out

    schema = f"{key} {kind}, kinds array<int>, starts array<int>, ends array<int>, added array<boolean>"
    return by_batch(docs.select(key, text), schema, work)


def redact(docs: DataFrame, text: str) -> DataFrame:
    """All columns as they are, with every span of ``text`` replaced by its kind in brackets; null stays null."""
    place = docs.columns.index(text)

    def hide(body: str | None) -> str | None:
        if not body:
            return body
        parts, at = [], 0
        for start, end, kind in sorted((start, end, kind) for kind, start, end, _ in find(body)):
            if end <= at:
                continue
            if start >= at:
                parts += [body[at:start], f"[{KINDS[kind]}]"]
            at = end
        return "".join([*parts, body[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.columns
            arrays[place] = pa.array(list(map(hide, arrays[place].to_pylist())), arrays[place].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
