"""Quality rules: counts of each text, and a logistic regression on hashed word and
character n-grams that is calibrated and scored in Arrow batches.

The model is fitted on at most ``sample`` labelled rows, those with the smallest hash
of their key; four fifths fit the weights, one fifth the calibration. Everything
else runs over all rows and whole texts. A null text counts as an empty one and has
no evidence; rows without a label are only scored. Repeated rows are scored alike.
With fewer than ``LEAST_LABELS`` labelled rows, or without labels of both classes, the
model gives probability 1 to every row, so that only the base rules reject.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.arrow import map_batches, raw_texts

BITS = 12  # features per family: 4 096 for words, 4 096 for characters
SAMPLE = 4_000
LEAST_LABELS = 10
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SIZE = 1 << BITS
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words within
    three-word windows that the text holds at least twice."""
    tokens = text.split()
    data = np.frombuffer(text, np.uint8)
    points = int(((data & 0xC0) != 0x80).sum()) - int(_SPACE[data].sum())
    symbols = int(_SYMBOL[data].sum())
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.split(None, 1):
            seen.add(line)
    return len(tokens), points, symbols, repeated, _repeat_words(tokens)


def _repeat_words(tokens: list[bytes]) -> int:
    n = len(tokens)
    if n < 3:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in tokens), np.int64, n)
    first, second, third = ids[:-2], ids[1:-1], ids[2:]
    if len(names) < 1 << 21:
        keys = first << 42 | second << 21 | third
    else:  # numbered anew after the second word, so that no key overflows
        pairs = np.unique(first * np.int64(len(names)) + second, return_inverse=True)[1]
        keys = pairs * np.int64(len(names)) + third
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= hit
    return int(inside.sum())


# Features --------------------------------------------------------------------
_CHAR = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_TOP = np.uint32(32 - BITS)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


_WORDS = _Words()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text: log counts of hashed words and word pairs, and
    of hashed byte trigrams, each family of length 1."""
    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ones = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint32, len(tokens))
    hashed = np.concatenate([ones, ones[:-1] * np.uint32(31) + ones[1:]]) * _CHAR[0] >> _TOP
    data = np.frombuffer(text, np.uint8)
    grams = (_CHAR[0] * data[:-2] + _CHAR[1] * data[1:-1] + _CHAR[2] * data[2:]) >> _TOP
    out = []
    for base, buckets in ((0, hashed), (_SIZE, grams)):
        counts = np.bincount(buckets, minlength=1)
        at = np.flatnonzero(counts)
        values = np.log1p(counts[at]).astype(np.float32)
        out.append((at + base, values / max(np.float32(1e-9), np.sqrt(values @ values))))
    return np.concatenate([a for a, _ in out]), np.concatenate([v for _, v in out])


@dataclass(frozen=True)
class Model:
    """Weights, intercept, and the slope and shift of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def logit(self, text: bytes) -> float:
        """Calibrated log odds that the text is good."""
        at, values = features(text)
        return self.slope * (float(self.weights[at] @ values) + self.bias) + self.shift


@dataclass(frozen=True)
class Rows:
    """Sparse rows: indices and values one behind the other, and where each row starts.
    A row of ``n`` features takes 8 n bytes, whatever the number of buckets."""

    at: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def part(self, keep: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)
        inside = np.repeat(keep, sizes)
        return Rows(self.at[inside], self.values[inside], np.concatenate([[0], np.cumsum(sizes[keep])]))

    def times(self, w: np.ndarray) -> np.ndarray:
        """The product with a column of weights."""
        products = np.zeros(len(self.at) + 1)
        np.multiply(w[self.at], self.values, out=products[:-1])
        total = np.add.reduceat(products, np.minimum(self.starts[:-1], len(products) - 1)) if len(self) else np.zeros(0)
        return np.where(np.diff(self.starts) > 0, total, 0.0)

    def back(self, error: np.ndarray, width: int) -> np.ndarray:
        """The product of the transposed rows with a column of errors."""
        shares = np.repeat(error, np.diff(self.starts))
        shares *= self.values
        return np.bincount(self.at, shares, width)


def sample_features(documents: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> tuple[Rows, np.ndarray]:
    """Features and classes of the bounded sample. At most ``most`` keys are broadcast;
    a row's features are bounded by the number of buckets."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    one = known.groupBy("k").agg(F.max("y").alias("y"))
    picked = one.orderBy(F.xxhash64("k"), "k").limit(most)
    rows = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    joined = rows.join(F.broadcast(picked), "k").select("k", "y", "t")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t) for t in raw_texts(batch.column(2))]
            return pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()),
                pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()),
            ], ["k", "y", "at", "v"])

        return apply

    narrow = map_batches(joined.select(F.xxhash64("k").alias("k"), "y", "t"), make, "k long, y int, at binary, v binary")
    # A repeated key gives one row, so the sample stays within its bound.
    got = sorted(narrow.groupBy("k").agg(F.min(F.struct("at", "v", "y")).alias("r")).select("k", "r.*").collect(), key=lambda r: r["k"])
    found = [np.frombuffer(r["at"], "<i4") for r in got]
    rows = Rows(
        np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["v"], np.float32) for r in got)]),
        np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64))
    return rows, np.array([r["y"] for r in got], np.float32)


def _descend(x: Rows, y: np.ndarray, width: int, ridge: float, turns: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov's gradient descent, classes weighted equally."""
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, bias, last_w, last_bias = np.zeros(width), 0.0, np.zeros(width), 0.0
    for turn in range(turns):
        pull = turn / (turn + 3)
        ahead, ahead_bias = w + pull * (w - last_w), bias + pull * (bias - last_bias)
        error = (1 / (1 + np.exp(-(x.times(ahead) + ahead_bias))) - y) * share
        last_w, last_bias = w, bias
        w = ahead - 1.3 * (x.back(error, width) + ridge * ahead)
        bias = ahead_bias - 1.3 * float(error.sum())
    return w.astype(np.float32), bias


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of log odds, by Newton's method on smoothed targets."""
    good, bad = float((y > 0).sum()), float((y == 0).sum())
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * score).sum(), d.sum()])
        h = np.array([[(v * score * score).sum() + 1e-6, (v * score).sum()], [(v * score).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, ridge: float = 1e-4, turns: int = 300,
) -> Model:
    x, y = sample_features(documents, labels, label, key, text, sample)
    if len(y) < LEAST_LABELS or y.min() == y.max():
        return Model(np.zeros(2 * _SIZE, np.float32), 0.0, 0.0, 30.0)
    held = np.arange(len(y)) % 5 == 4
    if y[~held].min() == y[~held].max() or y[held].min() == y[held].max():
        held = np.zeros(len(y), bool)
    w, bias = _descend(x.part(~held), y[~held], 2 * _SIZE, ridge, turns)
    own = held if held.any() else ~held
    slope, shift = _platt(x.part(own).times(w) + bias, y[own])
    return Model(w, float(bias), float(slope), float(shift))


# Scoring -----------------------------------------------------------------------
def rate(df: DataFrame, model: Model, keep_at: float = KEEP_AT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed``, the probability ``quality_p`` and ``kept`` of every row."""
    kind = df.schema[key].dataType.simpleString()
    least = float(np.log(keep_at / (1 - keep_at)))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = raw_texts(batch.column(1))
            counts = np.array([base_counts(t) for t in rows], np.int64).reshape(-1, 5)
            logit = np.array([model.logit(t) for t in rows], np.float64)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(p), pa.array(~failed & (logit >= least))],
                [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_p", "kept"],
            )

        return apply

    schema = (
        f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, quality_p double, kept boolean"
    )
    return map_batches(df.select(key, text), make, schema)


def keep_good(df: DataFrame, model: Model, keep_at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns: a verdict travels with
    its own row through one Arrow pass, so no join by key is needed."""
    schema = df.schema
    at = df.columns.index(text)
    least = float(np.log(keep_at / (1 - keep_at)))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def good(text: bytes) -> bool:
            n, _, _, _, repeats = base_counts(text)
            return n >= MIN_WORDS and 100 * repeats <= MAX_REPEAT_PERCENT * n and model.logit(text) >= least

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([good(t) for t in raw_texts(batch.column(at))], pa.bool_()))

        return apply

    return map_batches(df, make, schema)
