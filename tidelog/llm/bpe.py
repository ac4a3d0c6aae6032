"""Byte-level BPE by DuckDB inside the tasks of a Spark job.

A task splits its texts into pieces and gives the pieces it has not seen to a
recursive query: one row per token and position, joined with the merge table,
contracts in each piece the pair of lowest rank until no pair is left. Decoding
joins ids with the vocabulary and aggregates their bytes in order; the round trip
does so once for each distinct piece.

A piece over ``CUT_PIECE`` bytes is contracted in blocks of ``BLOCK`` bytes. A row of
tokens is the contraction of its bytes if every two neighbours are that of theirs, so
only the pairs at the cuts are tried; blocks at a cut that fails become one block,
until all hold. In the worst case that is the piece itself.

Each document is handled by itself, so nothing is shuffled and a lost task is
simply run again. Memory of a task: one slice of texts, the piece cache
(``CACHE_PIECES``), and DuckDB under its own limit.

Defined results: a null or empty text has no tokens and decodes to no bytes;
rows are independent, so repeated rows give repeated results; input columns
other than the two named are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidelog.llm.common import by_batch

# Pieces with their ids kept by a worker, and pieces given to one recursive query.
CACHE_PIECES = 300_000
QUERY_PIECES = 25_000
# Pieces over this many bytes merge all places of their best pair in one step.
LONG_PIECE = 48
CUT_PIECE = 512
BLOCK = 64
# Steps of a recursive query whose rows are held at once; a next query goes on from the last one.
STEPS = 64

# Texts of these characters only can be split by ranges instead of Unicode classes.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏ"
_OTHER_TEXT = re.compile(f"[^\\x00-\\x1b\\x20-\\x7e{_LETTERS}]")
_CLASSES = {r"\p{L}": _LETTERS, r"\p{N}": "0-9"}

# Position in the lower bits of a key, rank above it: the least key is the leftmost pair of least rank.
# A word without a pair is given once more, as ended: the rows of its other steps need not be looked through for the last.
_STEP = """
WITH RECURSIVE parts(word, pos, id, ended) AS (
  SELECT word, pos, id, false FROM base
  UNION ALL
  (WITH p AS MATERIALIZED (
    SELECT q.word, q.pos, q.id, q.before, CAST(m.merged AS BIGINT) << 32 | q.pos AS merge
    FROM (SELECT word, pos, id, lead(id) OVER w AS next_id, lag(pos) OVER w AS before
          FROM parts WHERE NOT ended WINDOW w AS (PARTITION BY word ORDER BY pos)) q
    LEFT JOIN merges m ON m.left_id = q.id AND m.right_id = q.next_id
  )
  SELECT word, pos, CASE WHEN pos = best & 4294967295 THEN CAST(best >> 32 AS INTEGER) ELSE id END, best IS NULL
  FROM p JOIN (SELECT word, min(merge) AS best FROM p GROUP BY word) USING (word)
  WHERE best IS NULL OR before IS NULL OR before <> best & 4294967295)
)
SELECT word, pos, id FROM parts WHERE ended
"""
# The same with every place of the least rank at once (of overlapping places every second one, from
# the left), where that merge cannot make a pair of lower rank than its own.
_STEP_LONG = f"""
WITH RECURSIVE parts(step, word, pos, id) AS (
  SELECT 0, word, pos, id FROM base
  UNION ALL
  SELECT step + 1, word, pos, CASE WHEN taken THEN best ELSE id END
  FROM (
    SELECT *, lag(taken) OVER (PARTITION BY word ORDER BY pos) AS gone
    FROM (
      SELECT *, coalesce(merged = best, false)
                AND CASE WHEN safe
                         THEN row_number() OVER (PARTITION BY word, merged IS NOT DISTINCT FROM best, run ORDER BY pos) % 2 = 1
                         ELSE pos = min(CASE WHEN merged = best THEN pos END) OVER (PARTITION BY word) END AS taken
      FROM (
        SELECT *, nth - row_number() OVER (PARTITION BY word, merged IS NOT DISTINCT FROM best ORDER BY pos) AS run
        FROM (
          SELECT p.*, m.merged, m.safe, min(m.merged) OVER (PARTITION BY word) AS best
          FROM (SELECT parts.*, lead(id) OVER w AS next_id, row_number() OVER w AS nth
                FROM parts WINDOW w AS (PARTITION BY word ORDER BY pos)) p
          LEFT JOIN merges m ON m.left_id = p.id AND m.right_id = p.next_id
        )
      )
    )
  )
  WHERE best IS NOT NULL AND NOT coalesce(gone, false) AND step < {STEPS}
)
SELECT word, pos, id, step FROM parts QUALIFY step = max(step) OVER (PARTITION BY word)
"""
# Ids of each piece as text, and the bytes that they stand for.
_GATHER = """
SELECT string_agg(CAST(c.id AS VARCHAR), ' ' ORDER BY c.pos), string_agg(v.bytes, '' ORDER BY c.pos)
FROM contracted c JOIN vocab v ON v.id = c.id GROUP BY c.word ORDER BY c.word
"""
_DECODE = """
SELECT d.doc, coalesce(string_agg(v.bytes, '' ORDER BY d.pos), '') AS bytes
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM docs) d
JOIN vocab v ON v.id = d.id GROUP BY d.doc
"""


class Codec:
    """Encoder and decoder of one worker; built from the rank file on first use."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.split = regex.compile(pattern).findall
        for name, plain in _CLASSES.items():
            pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m, p=plain: m[1] + p, pattern)
            pattern = pattern.replace(name, f"[{plain}]")
        self.split_plain = None if "\\p" in pattern else re.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.by_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        # Tokens that are part of a merge of lower rank than their own.
        unsafe = {part for *parts, rank in merges for part in parts if part > rank}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        left, right, merged = (pa.array(column, pa.int32()) for column in zip(*merges, strict=True))
        self._table("merges", {"left_id": left, "right_id": right, "merged": merged, "safe": [m[2] not in unsafe for m in merges]})
        # One character a byte, so that text functions of the database can carry bytes.
        self._table("vocab", {"id": pa.array(ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]})
        self.cache: dict[str, tuple[str, str]] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def pieces(self, text: str) -> list[str]:
        if self.split_plain and not _OTHER_TEXT.search(text):
            return self.split_plain(text)
        return self.split(text)

    def _contract(self, raw: list[bytes], query: str) -> list[tuple[str, str]]:
        """Per run of bytes its ids as text, and the bytes that they stand for."""
        sizes = np.array([len(r) for r in raw])
        starts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        base = pa.table({
            "word": np.repeat(np.arange(len(raw), dtype=np.int32), sizes),
            "pos": (np.arange(total) - np.repeat(starts, sizes)).astype(np.int32),
            "id": self.by_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)],
        })
        self._query(base, f"CREATE OR REPLACE TEMP TABLE contracted AS {query}")
        while query is _STEP_LONG:
            rest = self.con.execute(f"SELECT word, pos, id FROM contracted WHERE step = {STEPS}").to_arrow_table()
            if not rest.num_rows:
                break
            self.con.execute(f"DELETE FROM contracted WHERE step = {STEPS}")
            self._query(rest, f"INSERT INTO contracted {query}")
        return self.con.execute(_GATHER).fetchall()

    def _query(self, base: pa.Table, query: str) -> None:
        self.con.register("base", base)
        self.con.execute(query)
        self.con.unregister("base")

    def _in_groups(self, raw: list[bytes]) -> list[tuple[str, str]]:
        """``_contract`` of runs sorted by length, so many at once as a query should hold."""
        found: list[tuple[str, str]] = []
        while len(found) < len(raw):
            start = len(found)
            size = len(raw[start])
            if size <= LONG_PIECE:
                part, query = raw[start : start + max(1, QUERY_PIECES * 8 // max(8, size))], _STEP
            else:
                part, query = raw[start : start + max(1, QUERY_PIECES // size)], _STEP_LONG
            found += self._contract([p for p in part if len(p) <= max(16, 2 * size)], query)
        return found

    def _contract_all(self, raw: set[bytes]) -> dict[bytes, tuple[str, str]]:
        order = sorted(raw, key=len)
        return dict(zip(order, self._in_groups(order), strict=True))

    def _contract_long(self, pieces: list[bytes]) -> list[tuple[str, str]]:
        """Long pieces by blocks, joined where their cuts do not hold."""
        cuts = [[*range(0, len(p), BLOCK), len(p)] for p in pieces]
        known: dict[bytes, tuple[str, str]] = {}
        pairs: dict[tuple[int, int], bool] = {}
        while True:
            blocks = [[p[a:b] for a, b in zip(c, c[1:])] for p, c in zip(pieces, cuts, strict=True)]
            known |= self._contract_all({b for bs in blocks for b in bs} - known.keys())
            ends = []
            for bs in blocks:
                ids = [known[b][0] for b in bs]
                ends.append([(int(x[x.rfind(" ") + 1 :]), int(y.split(" ", 1)[0])) for x, y in zip(ids, ids[1:])])
            new = {pair for e in ends for pair in e} - pairs.keys()
            whole = self._contract_all({self.tokens[a] + self.tokens[b] for a, b in new})
            pairs |= {(a, b): whole[self.tokens[a] + self.tokens[b]][0] == f"{a} {b}" for a, b in new}
            if all(pairs[pair] for e in ends for pair in e):
                return [(" ".join(known[b][0] for b in bs), "".join(known[b][1] for b in bs)) for bs in blocks]
            cuts = [[0, *(at for at, pair in zip(c[1:-1], e, strict=True) if pairs[pair]), c[-1]] for c, e in zip(cuts, ends, strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces not seen yet into the cache."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = {p: self.cache[p] for p in pieces if p in self.cache}
        raw = [p.encode("utf-8") for p in new]
        # By bytes, as pieces of few characters can have many.
        order = sorted(range(len(new)), key=lambda i: len(raw[i]))
        short = [i for i in order if len(raw[i]) <= CUT_PIECE]
        self.cache.update(zip([new[i] for i in short], self._in_groups([raw[i] for i in short]), strict=True))
        for i in order[len(short) :]:
            self.cache[new[i]] = self._contract_long([raw[i]])[0]

    def code(self, texts: list[str | None]) -> tuple[list[str], list[bytes]]:
        """Per text its ids as decimal numbers joined by one space, and the bytes decoded from them."""
        split = [self.pieces(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        get = self.cache.__getitem__
        found = [list(map(get, pieces)) for pieces in split]
        return [" ".join([x[0] for x in f]) for f in found], ["".join([x[1] for x in f]).encode("latin-1") for f in found]

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """Per list of ids the bytes they stand for."""
        self.con.register("docs", pa.table({"doc": np.arange(len(ids), dtype=np.int32), "ids": ids}))
        found = self.con.execute(_DECODE).fetchall()
        self.con.unregister("docs")
        out = [b""] * len(ids)
        for doc, text in found:
            out[doc] = text.encode("latin-1")
        return out


class RankFile:
    """A rank file as it is broadcast, with the codec that a worker makes of it; both go
    once no task of the worker names the broadcast any more."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern = data, pattern
        self.own: Codec | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"own": None}

    def codec(self) -> Codec:
        if self.own is None:
            self.own = Codec(self.data, self.pattern)
        return self.own


def _rank_file(df: DataFrame, path: str, pattern: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(RankFile(file.read(), pattern))  # a vocabulary: fixed size


def _as_ids(lines: list[str]) -> pa.ListArray:
    """Lists of ids from their decimal texts."""
    flat = np.array(" ".join(x for x in lines if x).split(), dtype=np.int32)
    ends = np.cumsum([x.count(" ") + 1 if x else 0 for x in lines])
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), flat)


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """``key``, ``ids`` (array of int) for each row; ``path`` is a rank file, read on the driver."""
    ranks = _rank_file(df, path, pattern)

    def work(batch: pa.RecordBatch) -> dict:
        lines, _ = ranks.value.codec().code(batch.column(1).to_pylist())
        return {key: batch.column(0), "ids": _as_ids(lines)}

    return by_batch(df.select(key, text), f"{key} {dict(df.dtypes)[key].replace('bigint', 'long')}, ids array<int>", work)


def decode(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """``key``, ``bytes`` for each row of ids; null ids give no bytes, an id outside the vocabulary is left out."""
    ranks = _rank_file(df, path, pattern)

    def work(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(0), "bytes": ranks.value.codec().decode(batch.column(1).fill_null([]))}

    return by_batch(df.select(key, ids), f"{key} {dict(df.dtypes)[key].replace('bigint', 'long')}, bytes binary", work)


def round_trip(df: DataFrame, key: str, text: str, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row ``n_tokens`` and the digests of the ids and of the bytes decoded from them, in one pass;
    with ``with_ids`` the ids as well."""
    ranks = _rank_file(df, path, pattern)

    def work(batch: pa.RecordBatch) -> dict:
        lines, decoded = ranks.value.codec().code(batch.column(1).to_pylist())
        return {
            key: batch.column(0),
            "ids": _as_ids(lines) if with_ids else None,
            "n_tokens": [x.count(" ") + 1 if x else 0 for x in lines],
            "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in lines],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
        }

    schema = f"{key} {dict(df.dtypes)[key].replace('bigint', 'long')}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_batch(df.select(key, text), schema + ", ids array<int>" * with_ids, work)
