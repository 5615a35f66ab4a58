"""Quality by weak labels: overlapping heuristics, a label model, and a hashed linear scorer.

Eight heuristic labellers vote good, bad or nothing on each document. Spark counts the vote patterns of all documents
(at most 3^8 of them); expectation-maximisation on these counts estimates how each labeller votes on good and on bad
documents, without any true label. The posteriors of a bounded sample (`sample_docs` documents) train a linear scorer
on hashed word shapes, words and binned shares, which then scores every document. A document scoring under `threshold` is rejected.

Defined results:
    null text, empty text   no words: score 0, rejected
    very long texts         whole
    ties (score at the threshold)   kept
    null identifier         scored like any other
    repeated rows           each on its own, equal texts get equal scores
    empty table             empty result
    further columns         ignored
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows

SLOTS = 2048
NUMBERS = 9
LABELLERS = 8
BAD, GOOD = 1, 2
#: Common function words of English, French, German and Spanish.
COMMON = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "le", "la", "les", "de", "des", "et", "un", "une", "que", "der", "die", "das", "und", "den", "ist", "zu", "von", "el", "los", "en", "y", "que", "se", "con", "por", "del")
LOWER, UPPER, DIGIT, BLANK, MILD, SIGN = range(6)


def classes() -> np.ndarray:
    """Class of each code point up to 0x3000; beyond, letters and signs count as lower-case letters."""
    out = np.full(0x3001, SIGN, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = BLANK if c.isspace() else DIGIT if c.isdigit() else UPPER if c.isupper() else LOWER if c.isalpha() else MILD if c in ".,;:'\"-()?¿¡’“”" else SIGN
    out[0x3000] = LOWER
    return out


def numbers(text: str, words: Counter, order: list[str], table: np.ndarray) -> np.ndarray:
    """Shares that the labellers judge by; some are smoothed so that a few words say little."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(table[np.minimum(points, 0x3000)], minlength=6)
    solid = max(1, len(points) - n[BLANK])
    cased = max(1, n[LOWER] + n[UPPER])
    total = len(order)
    return np.array(
        [
            n[SIGN] / solid,
            n[UPPER] / (cased + 10),
            n[DIGIT] / solid,
            sum(k for w, k in words.items() if len(w) == 1 and not w.isalnum()) / total,
            sum(map(str.__eq__, order, order[1:])) / total,
            len(words) / min(total, 400) if total > 50 else 1.0,
            (sum(words[w] for w in COMMON) + 1) / (total + 20),
            solid / total / 10,
            n[MILD] / (total + 3),
        ]
    )


def votes(x: np.ndarray) -> list[int]:
    def judge(v: float, good: float, bad: float) -> int:
        return (GOOD if v <= good else BAD if v >= bad else 0) if good < bad else (GOOD if v >= good else BAD if v <= bad else 0)

    return [judge(x[0], 0.02, 0.08), judge(x[1], 0.15, 0.5), judge(x[3], 0.02, 0.15), judge(x[4], 0.06, 0.3), judge(x[5], 0.35, 0.1), judge(x[6], 0.05, 0.005), 0 if 0.25 < x[7] < 1.2 else BAD, GOOD if 0.02 <= x[8] <= 0.6 else BAD if x[8] > 1.2 or x[8] == 0 else 0]


def pattern(v: list[int]) -> int:
    return sum(x * 3**j for j, x in enumerate(v))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(probability that a document with the pattern is good, table[class, labeller, vote]) by expectation-maximisation."""
    v = np.stack([(patterns // 3**j) % 3 for j in range(LABELLERS)], 1)
    lead = 0.5 * (v == GOOD).sum(1) - 3.0 * (v == BAD).sum(1)
    post = 1 / (1 + np.exp(-lead))
    for _ in range(rounds):
        table = np.zeros((2, LABELLERS, 3))
        prior = np.array([(counts * (1 - post)).sum(), (counts * post).sum()]) + 1
        for c, w in enumerate((counts * (1 - post), counts * post)):
            for j in range(LABELLERS):
                table[c, j] = np.bincount(v[:, j], w, 3) + 0.1
        table /= table.sum(2, keepdims=True)
        log = np.log(prior / prior.sum())[None] + sum(np.log(table[:, j, :][:, v[:, j]]).T for j in range(LABELLERS))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return post, table


class Hasher:
    def __init__(self):
        self.cache: dict[str, tuple[int, int]] = {}

    def slots(self, w: str) -> tuple[int, int]:
        got = self.cache.get(w)
        if got is None:
            shape = re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w[:64]))
            got = (zlib.crc32(("shape " + shape).encode("utf-8", "replace")) % SLOTS, zlib.crc32(w.lower().encode("utf-8", "replace")) % SLOTS)
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[w] = got
        return got

    def vector(self, x: np.ndarray, words: Counter) -> np.ndarray:
        out = np.zeros(SLOTS + NUMBERS, np.float32)
        if words:
            slots = np.array([self.slots(w) for w in words])
            k = np.fromiter(words.values(), float, len(words)) / sum(words.values())
            out[:SLOTS] = np.sqrt(np.bincount(slots[:, 0], k, SLOTS)) + 0.3 * np.sqrt(np.bincount(slots[:, 1], k, SLOTS))
            out[SLOTS:] = np.minimum(3 * x, 3)
            for j, v in enumerate(x):
                out[zlib.crc32(b"number %d %d" % (j, min(20, int(v * 20)))) % SLOTS] += 0.5
        return out


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels (Adam, full batch); the last weight is the constant."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)
    w, m, s = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((q - y) / len(y)).astype(np.float32) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def _read(text: str | None, table: np.ndarray):
    order = (text or "").split()
    words = Counter(order)
    return (words, numbers(text, words, order, table)) if order else (words, None)


def _patterns(batches):
    table = classes()
    found: Counter = Counter()
    for batch in batches:
        for x in batch.column(0):
            _, n = _read(x.as_py(), table)
            if n is not None:
                found[pattern(votes(n))] += 1
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])


def _vectors(batches):
    table, hasher = classes(), Hasher()
    for batch in batches:
        for x, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words, n = _read(x.as_py(), table)
            if n is not None:
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pattern(votes(n))], pa.int32()), pa.array([hasher.vector(n, words).astype(np.float16).tobytes()], pa.binary())], ["k", "pattern", "x"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2500) -> np.ndarray | None:
    """Weights of the scorer. None where no document has a word."""
    text = docs.select(F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("k"))
    rows = text.select("t").mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    patterns, counts = np.array([r["pattern"] for r in rows]), np.array([r["n"] for r in rows], float)
    post = dict(zip(patterns.tolist(), label_model(patterns, counts)[0], strict=True))
    share = min(1_000_000, int(1_000_000 * sample_docs / counts.sum()) + 1)
    drawn = text.where(F.pmod("k", F.lit(1_000_000)) < share).select("t", "k").mapInArrow(_vectors, "k long, pattern int, x binary").orderBy("k", "pattern", "x").limit(2 * sample_docs).collect()
    if not drawn:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in drawn]).astype(np.float32)
    return fit_linear(x, np.array([post.get(r["pattern"], 0.5) for r in drawn], np.float32))


class Scorer:
    def __init__(self, weights: np.ndarray | None):
        self.weights, self.table, self.hasher = weights, classes(), Hasher()

    def __call__(self, text: str | None) -> float:
        words, n = _read(text, self.table)
        if n is None or self.weights is None:
            return 0.0
        z = float(self.hasher.vector(n, words) @ self.weights[:-1] + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def keep(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not rejected."""

    def make():
        scorer = Scorer(weights)
        return lambda texts: [scorer(t) >= threshold for t in texts]

    return keep_rows(docs, text_col, make)


def score(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in carry, quality (0 to 1), kept."""

    def run(batches):
        scorer = Scorer(weights)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                got = [scorer(x.as_py()) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(got, pa.float64()), pa.array([g >= threshold for g in got], pa.bool_())], [*part.schema.names[1:], "quality", "kept"])

    kinds = dict(docs.dtypes)
    out = [id_col, *carry]
    return docs.select(F.col(text_col).alias("__text"), *out).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in out), "quality double, kept boolean"]))
