"""Secret scans: fixed patterns, and a character convolutional network for the rest.

One pass finds the pattern matches of each text and its candidates: runs of at
least ``CANDIDATE_CHARS`` characters of the usual key alphabets with a digit. A
candidate inside a pattern match is a labelled finding, one outside a labelled
non-finding; of long candidates each window is labelled so. The network (numpy) is
trained on all distinct labelled windows; a held-out part calibrates its output (Platt)
and sets the threshold: the highest one that still finds ``RECALL`` of the findings.
A second pass scores every candidate with its surrounding characters; candidates
over the threshold that lie in no pattern match become spans of kind ``model``.

Both passes are maps; the first leaves a table of spans and windows in the shared
folder. The network is a few kilobytes. Long candidates are scored in windows along
their whole length, the best window counts.

Training windows are dealt by hash into blocks of about ``TRAINING`` of each label, a
row of a stored table each; of the rarer label every block gets a part, so parts of it
are in several blocks. ``EPOCHS`` times every block takes the network on by a part of its
passes over its rows, and the mean of these networks is what the next part begins with. The driver sees sums
and states of networks, of which at most ``MERGED`` blocks share one. One block is
trained on the driver.

Defined results: a null or empty text has no spans; without findings or without
non-findings to learn from there is no network and only pattern matches are given;
repeated rows give repeated results; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import by_batch, stored

# Fixed patterns, least lengths (of the group named) and their order.
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of hex digits is one match, so shorter ones can be left out at once
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

CANDIDATE_CHARS = 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE_CHARS)
_DIGIT = re.compile(r"[0-9]")
# About this many training windows of each label are a block; networks of so many blocks are added up before the driver.
TRAINING, MERGED = 3000, 32
# Files that hold the blocks, and the bits that one count of the search for the threshold settles.
FILES, DIGIT = 1000, 16
RECALL = 0.95
# Characters of a window: before the place scored, from it on.
BEFORE, AFTER = 32, 64
WIDTH, EMBED, FILTERS, HIDDEN = 5, 8, 32, 16
# Passes over the training rows, and the least number of steps when these are few.
EPOCHS, STEPS, BATCH = 6, 500, 64
_SYMBOLS = 100


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches as (start, kind number, end), sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0])]


def places(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that have a window each."""
    return [(at, min(end, at + AFTER)) for at in range(start, end, AFTER)]


def windows(text: str, start: int, end: int) -> list[str]:
    """What is around each place of a candidate; a tab marks where the candidate begins and ends."""
    out = []
    for at, stop in places(start, end):
        before = text[max(0, at - BEFORE) : at].rjust(BEFORE)
        out.append(before + "\t" + text[at:stop] + "\t" + text[end : max(end, at + AFTER)])
    return out


def codes(texts: list[str]) -> np.ndarray:
    """Symbols of windows: printable ASCII, the mark, any other letter; padded to one length."""
    size = BEFORE + AFTER + 2
    padded = "".join(t[:size].ljust(size) for t in texts)
    x = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64).reshape(len(texts), size)
    used = np.arange(size) < np.array([len(t) for t in texts], dtype=np.int64)[:, None]
    return np.where(used, np.where(x == 9, 1, np.where((x >= 32) & (x < 127), x - 30, 98)), 0)


class Network:
    """Embedding, convolution over characters, greatest value over places, one hidden layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.3, (_SYMBOLS, EMBED)),
            "conv": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "conv_b": np.zeros(FILTERS),
            "hidden": r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)),
            "hidden_b": np.zeros(HIDDEN),
            "out": r.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
            "out_b": np.zeros(1),
        }
        self.first = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.step = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def _forward(self, x: np.ndarray) -> tuple:
        w = self.w
        places = x.shape[1] - WIDTH + 1
        spread = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
        patches = w["embed"][spread].reshape(len(x), places, WIDTH * EMBED)
        maps = patches @ w["conv"] + w["conv_b"]
        where = maps.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(maps, where[:, None, :], axis=1)[:, 0], 0)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden_b"], 0)
        return spread, patches, where, pooled, hidden, hidden @ w["out"] + w["out_b"][0]

    def logits(self, texts: list[str]) -> np.ndarray:
        parts = [self._forward(codes(texts[i : i + 256]))[-1] for i in range(0, len(texts), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated probability that a window shows a secret."""
        return self.calibrated(self.logits(texts))

    def learn(self, texts: list[str], labels: np.ndarray, part: int) -> Network:
        """Part ``part`` of ``EPOCHS`` of the passes over the rows."""
        x, w = codes(texts), self.w
        r = np.random.default_rng(11)
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
        passes = max(EPOCHS, -(-STEPS // -(-len(x) // BATCH)))
        orders = [r.permutation(len(x)) for _ in range((part + 1) * passes // EPOCHS)][part * passes // EPOCHS :]
        for order, at in ((order, at) for order in orders for at in range(0, len(x), BATCH)):
            rows = order[at : at + BATCH]
            spread, patches, where, pooled, hidden, logit = self._forward(x[rows])
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
            g = {"out": hidden.T @ slope, "out_b": np.array([slope.sum()])}
            down = np.outer(slope, w["out"]) * (hidden > 0)
            g["hidden"], g["hidden_b"] = pooled.T @ down, down.sum(axis=0)
            down = (down @ w["hidden"].T) * (pooled > 0)
            # The gradient reaches one place per filter, the one with the greatest value.
            chosen = np.take_along_axis(patches, where[:, :, None], axis=1)
            g["conv"] = np.einsum("nfk,nf->kf", chosen, down)
            g["conv_b"] = down.sum(axis=0)
            back = (down[:, :, None] * w["conv"].T[None]).reshape(len(rows), FILTERS, WIDTH, EMBED)
            symbols = np.take_along_axis(spread, where[:, :, None], axis=1)
            g["embed"] = np.zeros_like(w["embed"])
            np.add.at(g["embed"], symbols.ravel(), back.reshape(-1, EMBED))
            self.step += 1
            for k in w:
                self.first[k] += 0.1 * (g[k] - self.first[k])
                self.second[k] += 0.001 * (g[k] ** 2 - self.second[k])
                w[k] -= 0.003 * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)
        return self

    def state(self) -> np.ndarray:
        """Weights, both moments and the number of steps as one array."""
        return np.concatenate([v.ravel() for part in (self.w, self.first, self.second) for v in part.values()] + [[self.step]])

    @classmethod
    def at(cls, state: np.ndarray) -> Network:
        network, done = cls(), 0
        for part in (network.w, network.first, network.second):
            for k, v in part.items():
                part[k] = state[done : done + v.size].reshape(v.shape).copy()
                done += v.size
        network.step = float(state[done])
        return network


def survey(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored rows: ``key``, pattern matches (``starts``, ``kinds``, ``ends``) and candidates with their windows, which are labelled."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {name: [] for name in ("starts", "kinds", "ends", "c_starts", "c_ends", "c_sizes", "c_windows", "c_labels")}
        for body in batch.column(1).to_pylist():
            body = body or ""
            base = base_spans(body)
            found = candidates(body)
            shown = [windows(body, *c) for c in found]
            values = (
                [b[0] for b in base], [b[1] for b in base], [b[2] for b in base], [c[0] for c in found], [c[1] for c in found],
                [len(s) for s in shown], [w for s in shown for w in s], _touching([p for c in found for p in places(*c)], base),
            )
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return {"key": batch.column(0)} | out

    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    schema = f"key {kind}, starts array<long>, kinds array<int>, ends array<long>, c_starts array<long>, c_ends array<long>, c_sizes array<int>, c_windows array<string>, c_labels array<int>"
    return stored(by_batch(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), schema, work), "survey")


def _touching(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """1 for each place that overlaps a match; both are sorted by start."""
    out, at, reach = [], 0, -1
    for start, end in found:
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][2])
            at += 1
        out.append(int(reach > start))
    return out


def _inside(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Whether a match holds the whole candidate; both are sorted by start."""
    out, at, reach = [], 0, -1
    for start, end in found:
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][2])
            at += 1
        out.append(reach >= end)
    return out


Blocks = DataFrame | list[dict]


def _blocks(surveyed: DataFrame) -> Blocks | None:
    """All distinct labelled windows in blocks (``block``, ``labels``, ``shown`` sorted by label and hash, and
    ``firsts``: whether the window is in no block before); None without both labels."""
    pairs = F.explode(F.arrays_zip("c_labels", "c_windows")).alias("c")
    labelled = surveyed.where(F.size("c_windows") > 0).select(pairs).select(F.col("c.c_labels").alias("label"), F.col("c.c_windows").alias("shown"))
    labelled = stored(labelled.distinct(), "labelled")
    counts = dict(labelled.groupBy("label").count().collect())
    if len(counts) < 2:
        return None
    parts = {label: -(-count // TRAINING) for label, count in counts.items()}
    number = max(parts.values())
    by = F.when(F.col("label") == 0, parts[0]).otherwise(parts[1])
    part = F.pmod(F.xxhash64("shown", F.lit("block")), by)
    row = F.struct("label", F.xxhash64("shown").alias("hash"), "shown", (F.col("block") == F.col("part")).alias("first"))
    dealt = labelled.withColumn("part", part).withColumn("block", F.explode(F.sequence("part", F.lit(number - 1).cast("long"), by.cast("long"))))
    dealt = dealt.repartitionByRange(min(number, FILES), "block").groupBy("block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    dealt = dealt.selectExpr("block", "rows.label AS labels", "rows.shown AS shown", "rows.first AS firsts")
    return stored(dealt, "blocks") if number > 1 else [r.asDict() for r in dealt.collect()]


def _each(blocks: Blocks, schema: str, work: Callable[[dict], dict]) -> Blocks:
    """``work`` on every block: its columns besides ``block``, which are named in ``schema``."""
    if isinstance(blocks, list):
        return [{"block": b["block"]} | work(b) for b in blocks]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        found = [work(batch.slice(i, 1).to_pylist()[0]) for i in range(batch.num_rows)]
        return {"block": batch.column(batch.schema.get_field_index("block"))} | {name: [f[name] for f in found] for name in names}

    return by_batch(blocks, f"block long, {schema}", run)


def _kept(blocks: Blocks, name: str) -> Blocks:
    return blocks if isinstance(blocks, list) else stored(blocks, name)


def _total(blocks: Blocks) -> np.ndarray:
    """The sum of column ``sums`` over the blocks, always in the same order."""
    if isinstance(blocks, list):
        return reduce(np.add, (np.array(b["sums"]) for b in blocks))

    def add(batch: pa.RecordBatch) -> dict:
        sums = ([np.array(r["sums"]) for r in batch.column(1).slice(i, 1).to_pylist()[0]] for i in range(batch.num_rows))
        return {"block": batch.column(0), "sums": [reduce(np.add, s) for s in sums]}

    groups = blocks.groupBy(F.expr(f"block DIV {MERGED}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("block", "sums"))).alias("rows"))
    rows = by_batch(groups, "block long, sums array<double>", add).collect()
    return reduce(np.add, (np.array(r.sums) for r in sorted(rows)))


def _fit(blocks: Blocks, rows: Callable[[dict], list[tuple[list[str], np.ndarray] | None]], networks: int) -> list[Network | None]:
    """Networks, each trained on the rows of all blocks: ``rows`` gives those of a block, or None, for each network."""
    fitted: list[Network | None] = [Network()] * networks
    for part in range(EPOCHS):
        states = [n and n.state() for n in fitted]

        def work(block: dict, states=states, part=part) -> dict:
            learned = [own and Network.at(state).learn(*own, part) for state, own in zip(states, rows(block), strict=True) if state is not None]
            none = np.zeros(len(Network().state()) + 1)
            return {"sums": np.concatenate([none if n is None else [*n.state(), 1] for n in learned])}

        total = iter(_total(_each(blocks, "sums array<double>", work)).reshape(sum(s is not None for s in states), -1))
        means = [None if state is None else next(total) for state in states]
        fitted = [Network.at(m[:-1] / m[-1]) if m is not None and m[-1] else None for m in means]
        if not any(fitted):
            break
    return fitted


def train(surveyed: DataFrame) -> Network | None:
    """The network learned from all distinct labelled windows; None without both labels."""
    blocks = _blocks(surveyed)
    if blocks is None:
        return None

    def halves(block: dict) -> list[tuple[list[str], np.ndarray] | None]:
        labels = np.array(block["labels"])
        values = [" " * BEFORE + s[BEFORE:] for s in block["shown"]]
        own = [np.arange(len(labels)) % 2 == half for half in (0, 1)]
        return [([v for v, o in zip(values, x, strict=True) if o], labels[x]) if 0 < labels[x].sum() < x.sum() else None for x in own]

    # Findings that no pattern names are labelled wrongly. Networks that see the value alone, each
    # judging the half it was not trained on, tell them; what they take for a finding is not learned from.
    judges = _fit(blocks, halves, 2)

    def chosen(block: dict) -> dict:
        labels, firsts, shown = np.array(block["labels"]), np.array(block["firsts"]), block["shown"]
        # Every fourth row of either label is held out for calibration.
        held = np.zeros(len(labels), dtype=bool)
        for label in (0, 1):
            held[np.flatnonzero(labels == label)[::4]] = True
        if held[labels == 1].all() or held[labels == 0].all():
            held[:] = False
        check = held if held.any() else ~held
        wrong = np.zeros(len(labels), dtype=bool)
        values = [" " * BEFORE + s[BEFORE:] for s in shown]
        for half, judge in enumerate(judges):
            if judge is not None:
                wrong |= (np.arange(len(labels)) % 2 != half) & (labels == 0) & (judge.logits(values) > 0)
        if (wrong | (labels == 1))[~held].all() or (wrong | (labels == 1))[check].all():
            wrong[:] = False

        def both(rows: np.ndarray, some: np.ndarray) -> tuple[list[str], np.ndarray]:
            """Each window of ``some``, and its value behind what stands before some non-finding of ``rows``, so that the value itself counts."""
            own = [s for s, c in zip(shown, some, strict=True) if c]
            others = [s[:BEFORE] for s, c in zip(shown, rows & (labels == 0), strict=True) if c] or [s[:BEFORE] for s in own]
            return own + [others[i % len(others)] + s[BEFORE:] for i, s in enumerate(own)], np.concatenate([labels[some]] * 2)

        # A window in several blocks is learned in each, but calibrates once.
        learned, checked = both(~held & ~wrong, ~held & ~wrong), both(check & ~wrong, check & ~wrong & firsts)
        return {"shown": learned[0], "labels": learned[1], "c_shown": checked[0], "c_labels": checked[1]}

    kinds = "shown array<string>, labels array<int>, c_shown array<string>, c_labels array<int>"
    rows = _kept(_each(blocks, kinds, chosen), "learned")
    network = _fit(rows, lambda block: [(block["shown"], np.array(block["labels"]))], 1)[0]

    def held(block: dict) -> dict:
        return {"logits": network.logits(block["c_shown"]), "labels": block["c_labels"]}

    return _calibrate(network, _kept(_each(rows, "logits array<double>, labels array<int>", held), "logits"))


def _calibrate(network: Network, blocks: Blocks) -> Network:
    """Platt scaling by Newton steps on smoothed labels, then the threshold."""
    n, positive = _total(_each(blocks, "sums array<double>", lambda b: {"sums": [len(b["labels"]), sum(b["labels"])]}))
    a, b = 1.0, 0.0
    for _ in range(25):

        def slopes(block: dict, a=a, b=b) -> dict:
            z, labels = np.array(block["logits"]), np.array(block["labels"])
            wanted = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (n - positive + 2))
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            v = p * (1 - p) + 1e-6
            return {"sums": [((p - wanted) * z).sum(), (p - wanted).sum(), (v * z * z).sum(), (v * z).sum(), v.sum()]}

        first, second, zz, z, one = _total(_each(blocks, "sums array<double>", slopes))
        gradient = np.array([first + 1e-3 * a, second])
        step = np.clip(np.linalg.solve(np.array([[zz + 1e-3, z], [z, one + 1e-6]]), gradient), -1, 1)
        a, b = np.array([a, b]) - step
        if np.abs(step).max() < 1e-12:
            break
    network.scale, network.shift = float(max(a, 1e-3)), float(b)

    def found(block: dict) -> dict:
        return {"scores": network.calibrated(np.array(block["logits"])[np.array(block["labels"]) == 1])}

    missed = int((1 - RECALL) * positive + 1e-9)
    network.threshold = max(0.5, _ranked(_each(blocks, "scores array<double>", found), missed))
    return network


def _ranked(blocks: Blocks, rank: int) -> float:
    """The score that ``rank`` of all scores stand before. Its bits, in the order of positive doubles, are
    settled from the highest on by counting the scores by their next ``DIGIT`` bits."""
    if isinstance(blocks, list):
        return float(np.sort(np.concatenate([b["scores"] for b in blocks]))[rank])
    bits = stored(by_batch(blocks.select(F.explode("scores").alias("score")), "bits long", lambda batch: {"bits": batch.column(0).to_numpy().view(np.int64)}), "scores")
    known = 0
    for shift in range(64 - DIGIT, -1, -DIGIT):
        # The sign bit is never set, so an arithmetic shift does.
        rest = bits.where(F.shiftright("bits", shift + DIGIT) == known) if shift + DIGIT < 64 else bits
        counts = rest.groupBy(F.shiftright("bits", shift).alias("digits")).count().collect()
        for digits, count in sorted(counts):
            if rank < count:
                known = digits
                break
            rank -= count
    return float(np.array([known], dtype=np.int64).view(np.float64)[0])


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row ``key``, and all spans as parallel arrays ``starts``, ``kinds`` (numbers in ``KINDS``), ``ends``, sorted."""
    surveyed = survey(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(train(surveyed))

    def work(batch: pa.RecordBatch) -> dict:
        keys, starts, kinds, ends, c_starts, c_ends, sizes, shown, _ = (c.to_pylist() for c in batch.columns)
        network = shared.value
        scores = network.score([w for row in shown for w in row]) if network else None
        out: dict = {"key": batch.column(0), "starts": [], "kinds": [], "ends": []}
        at = 0
        for i in range(len(keys)):
            spans = list(zip(starts[i], kinds[i], ends[i], strict=True))
            inside = _inside(list(zip(c_starts[i], c_ends[i], strict=True)), spans)
            for start, end, known, size in zip(c_starts[i], c_ends[i], inside, sizes[i], strict=True):
                if network and not known and scores[at : at + size].max() >= network.threshold:
                    spans.append((start, 3, end))
                at += size
            spans.sort()
            for name, k in (("starts", 0), ("kinds", 1), ("ends", 2)):
                out[name].append([s[k] for s in spans])
        return out

    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    found = by_batch(surveyed, f"key {kind}, starts array<long>, kinds array<int>, ends array<long>", work)
    return found.withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans count as one."""
    spark = docs.sparkSession
    surveyed = survey(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), "key", "text")
    shared = spark.sparkContext.broadcast(train(surveyed))
    names = docs.columns

    def run(batches):
        for batch in batches:
            network = shared.value
            texts = batch.column(names.index(text)).to_pylist()
            found = [(base_spans(t), candidates(t)) if t else ([], []) for t in texts]
            shown = [[windows(t, *c) for c in cs] for t, (_, cs) in zip(texts, found, strict=True)]
            scores = network.score([w for row in shown for c in row for w in c]) if network else None
            at, cleaned = 0, []
            for t, (base, cs), row in zip(texts, found, shown, strict=True):
                spans = [(s, e) for s, _, e in base]
                for c, known, windows_of in zip(cs, _inside(cs, base), row, strict=True):
                    if network and not known and scores[at : at + len(windows_of)].max() >= network.threshold:
                        spans.append(c)
                    at += len(windows_of)
                cleaned.append(_cut(t, sorted(spans), mark))
            columns = [pa.array(cleaned, pa.string()) if n == text else batch.column(i) for i, n in enumerate(names)]
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def _cut(text: str | None, spans: list[tuple[int, int]], mark: str) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
