"""Language identification by words first, character n-grams for words not known.

Training counts the words of all distinct labelled texts in Spark, and from the words
their character n-grams of one to four letters, and keeps the log frequency of each
per language. Copies of a text count once in a language.
A word of a text scores by its log frequency; a word never seen scores by the mean
of its longest n-grams of which any is known.

Prediction is a map over all rows with the model broadcast (at most twice
``MODEL_TERMS`` terms, those of the greatest share in any language, so that a rare
language keeps its own); nothing is shuffled. Only the text is an input.

Defined results: a null text, one without any letter, or one met by an empty model
gives ``und`` with score 0; ties go to the language that sorts first; repeated rows
give repeated results; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import by_batch, stored

MODEL_TERMS = 200_000
LONGEST = 4
UNKNOWN = "und"
# Evidence of this many words decides as much as any longer text.
MOST_WORDS = 20
# Words whose scores a worker keeps.
CACHE_WORDS = 100_000

_LETTERS = re.compile(r"[^\W\d_]+")


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def train(docs: DataFrame, text: str, lang: str, where: Column | None = None) -> dict:
    """The model learned from rows with a language (and ``where``): names, and per term a row of log frequencies."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows if where is None else rows.where(where)
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.dropDuplicates(["lang", "h"]).select("lang", "text")

    def words(batch: pa.RecordBatch) -> dict:
        found: defaultdict[str, Counter] = defaultdict(Counter)
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[name].update(_LETTERS.findall(body.lower()))
        sizes = [len(c) for c in found.values()]
        names = np.repeat(np.array([*found], dtype=object), sizes)
        return {"lang": names, "term": [w for c in found.values() for w in c], "n": [n for c in found.values() for n in c.values()]}

    def grams(batch: pa.RecordBatch) -> dict:
        """Each word and its n-grams, as often as the word was met: counted from words, which are far fewer than texts hold."""
        found: defaultdict[str, list[defaultdict[str, int]]] = defaultdict(lambda: [defaultdict(int) for _ in range(LONGEST + 1)])
        for name, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole, *by_size = found[name]
            whole[word] += n
            for size, counts in enumerate(by_size, 1):
                for gram in _grams(word, size):
                    counts[gram] += n
        parts = [(name, size, counts) for name, by_size in found.items() for size, counts in enumerate(by_size)]
        lengths = [len(counts) for *_, counts in parts]
        names = np.repeat(np.array([p[0] for p in parts], dtype=object), lengths)
        sizes = np.repeat(np.array([p[1] for p in parts], dtype=np.int32), lengths)
        return {"lang": names, "size": sizes, "term": [t for *_, c in parts for t in c], "n": [n for *_, c in parts for n in c.values()]}

    met = by_batch(rows, "lang string, term string, n long", words).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    counted = by_batch(met, "lang string, size int, term string, n long", grams).groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))
    counted = stored(counted, "terms")
    totals = {(r.lang, r["size"]): r.n for r in counted.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({name for name, _ in totals})
    if not langs:
        return {"langs": [], "rows": Rows(pa.array([], pa.string())), "values": np.zeros((0, 1), dtype=np.float32)}
    by = [F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, name in enumerate(langs)]
    terms = counted.groupBy("size", "term").agg(F.sum("n").alias("n"), *by)
    # Words met once tell little; their n-grams do.
    share = F.array_max(F.array(*[F.col(f"n{i}") / F.create_map(*[F.lit(x) for n in range(LONGEST + 1) for x in (n, float(totals.get((name, n), 1)))])[F.col("size")] for i, name in enumerate(langs)]))
    # Stored before it is read, so that the driver does not merge the first terms of every task.
    ranked = terms.where("size > 0 OR n > 1").orderBy(share.desc(), "size", "term").limit(2 * MODEL_TERMS)
    # Taken over as columns: as Python objects the terms would be several times as large on the driver.
    top = stored(ranked, "top").orderBy("size", "term").toArrow()
    sizes = top["size"].to_numpy()
    of = np.array([[totals.get((name, size), 0) for name in langs] for size in range(LONGEST + 1)], dtype=np.float64)
    values = np.empty((len(sizes), len(langs)), dtype=np.float32)
    for i in range(len(langs)):
        found, all_of = top[f"n{i}"].to_numpy().astype(np.float64), of[sizes, i]
        values[:, i] = np.where(found > 0, np.log(np.maximum(found, 1) / np.maximum(all_of, 1)), np.log(0.5 / (all_of + 1)))
    marks = pc.if_else(pc.equal(top["size"], 0), "=", "")
    terms = pc.binary_join_element_wise(marks, top["term"], "").combine_chunks()
    return {"langs": langs, "rows": Rows(terms), "values": values}


class Rows(Mapping):
    """Row of each term: sent as a column, looked up in a dictionary that is made where it is first asked for."""

    def __init__(self, terms: pa.StringArray):
        self.terms = terms

    def __getstate__(self) -> dict:
        return {"terms": self.terms}

    @cached_property
    def found(self) -> dict[str, int]:
        return {term: i for i, term in enumerate(self.terms.to_pylist())}

    def __getitem__(self, term: str) -> int:
        return self.found[term]

    def __iter__(self) -> Iterator[str]:
        return iter(self.found)

    def __len__(self) -> int:
        return len(self.terms)


class Scorer:
    """Scores texts by a model; keeps the scores of tokens met before as rows of a matrix.

    It is what is broadcast: a worker keeps it, with all that it met, for as long as
    its tasks name the broadcast.
    """

    def __init__(self, model: dict):
        self.langs, self.rows, self.values = model["langs"], model["rows"], model["values"]
        self._forget()

    def _forget(self) -> None:
        # Row 0 is that of tokens without letters known in any way.
        self.scores, self.used = np.zeros((1024, len(self.langs))), 1
        self.places: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "rows": self.rows, "values": self.values}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state)

    def _known(self, word: str) -> list[int]:
        """Rows that a word scores by: its own, or those of its longest n-grams of which any is known."""
        get = self.rows.found.get
        at = get("=" + word)
        if at is not None:
            return [at]
        padded = f" {word} "
        for size in range(LONGEST, 0, -1):
            known = [at for i in range(len(padded) - size + 1) if (at := get(padded[i : i + size])) is not None]
            if known:
                return known
        return []

    def learn(self, tokens: list[str]) -> None:
        """Scores tokens not met yet, all at once: log score per language of the words in a token."""
        met, of_word, known, sizes = [], [], [], []
        for token in tokens:
            first = len(sizes)
            for word in _LETTERS.findall(token):
                if found := self._known(word):
                    known += found
                    sizes.append(len(found))
            if len(sizes) > first:
                met.append(token)
                of_word.append(first)
            else:
                self.places[token] = 0
        if not met:
            return
        ends = np.cumsum(sizes)
        words = np.add.reduceat(self.values[known], ends - sizes, axis=0) / np.array(sizes, dtype=np.float32)[:, None]
        words -= words.max(axis=1, keepdims=True)
        new = np.add.reduceat(words, of_word, axis=0)
        while self.used + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.used : self.used + len(new)] = new
        self.places.update(zip(met, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.places) > CACHE_WORDS:
            self._forget()
        # Every token of the slice is looked up once; the texts hold numbers of tokens.
        split = pc.utf8_split_whitespace(pa.array([text.lower() if text else "" for text in texts], pa.large_string()))
        offsets = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        tokens, numbers = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        self.learn([token for token in tokens if token not in self.places])
        places = np.fromiter(map(self.places.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return [self._predict(text, places[numbers[start:end]]) for text, start, end in zip(texts, offsets, offsets[1:])]

    def _predict(self, text: str | None, places: np.ndarray) -> tuple[str, float]:
        places, counts = np.unique(places[places > 0], return_counts=True)
        n = counts.sum()
        if not n:
            # Letters of a script that training never met are letters all the same.
            return (self.langs[0], 1 / len(self.langs)) if text and any(c.isalpha() for c in text) else (UNKNOWN, 0.0)
        total = counts @ self.scores[places]
        odds = np.exp((total - total.max()) * min(n, MOST_WORDS) / n)
        best = int(np.argmax(total))
        return self.langs[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, key: str, text: str, model: dict, keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``key`` and the language and its score (called as in ``names``) for every row; ``keep`` names further columns of ``docs`` to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model))
    columns = [*dict.fromkeys((key, *keep))]
    rows = docs.select(*columns, F.col(text).alias(names[0]))

    def work(batch: pa.RecordBatch) -> dict:
        found = shared.value.predict(batch.column(len(columns)).to_pylist())
        out = {name: batch.column(i) for i, name in enumerate(columns)}
        return out | {names[0]: [f[0] for f in found], names[1]: [f[1] for f in found]}

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return by_batch(rows, schema, work)
