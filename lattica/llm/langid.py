"""Language identification by interpolated Kneser-Ney character models.

One order-4 model per language. All languages share sorted arrays of hashed n-grams; a row of log-probabilities, one
column per language, stands beside each hash. A lookup that fails backs off, adding each language's weight for the
context. The language with the lowest cross-entropy per character wins.

n-grams are counted by Spark over a bounded sample of labelled rows: about `sample_docs` documents a language, of at
most `sample_chars` characters each. Counts over that sample, and so the model, are bounded whatever the corpus size.
A slice of the sample is held back from counting; on it a temperature (for `score`) and the highest cross-entropy of
ordinary text (for `rejected`) are set.

Defined results:
    null text, no letter   lang_pred 'und', score 0, cross_entropy null, rejected
    empty text             as above
    very long texts        scored whole, in pieces of bounded size
    ties                   the language that sorts first
    nothing to learn from  every lang_pred is 'und'
    null identifier        predicted like any other; never learned from
    repeated rows          each on its own
    further columns        ignored
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, mod_crc

ORDER = 4
BITS = np.uint64(16)
SPACE = 32
ODD = np.uint64(0x9E3779B97F4A7C15)
ALPHABET = 4096.0  # symbols an unseen character is drawn from


def letters() -> np.ndarray:
    """For each code point its symbol: itself if a letter (0xFFFF at most), else a space."""
    known = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(known, np.minimum(np.arange(0x110000), 0xFFFF), SPACE).astype(np.uint16)


def symbols(text: str | None, table: np.ndarray) -> np.ndarray:
    """Lower-case letters, with one space for anything between them; empty if there is no letter."""
    a = table[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = a == SPACE
    if gap.all():
        return a[:0]
    return a[~(gap & np.concatenate(([True], gap[:-1])))]


def grams(s: np.ndarray) -> np.ndarray:
    """Order-4 n-grams packed into 64 bits, oldest symbol highest; one per symbol, the start padded with spaces."""
    p = np.concatenate((np.full(ORDER - 1, SPACE, np.uint64), s.astype(np.uint64)))
    n = len(s)
    return (p[:n] << np.uint64(48)) | (p[1 : n + 1] << np.uint64(32)) | (p[2 : n + 2] << BITS) | p[3 : n + 3]


def tail(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * order)) - 1)


class Smoothed:
    """Interpolated Kneser-Ney for one language from its order-4 counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.p, self.contexts, self.weight = {}, {}, {}, {}
        levels = {ORDER: (keys, counts.astype(float))}
        for k in range(ORDER - 1, 0, -1):
            found, n = np.unique(tail(levels[k + 1][0], k), return_counts=True)
            levels[k] = (found, n.astype(float))  # in how many ways it is continued to the left
        for k in range(1, ORDER + 1):
            keys, c = levels[k]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            contexts, where = np.unique(keys >> BITS, return_inverse=True)
            total = np.bincount(where, c)
            weight = d * np.bincount(where) / total
            self.contexts[k], self.weight[k] = contexts, weight
            lower = np.full(len(keys), 1 / ALPHABET) if k == 1 else self.p[k - 1][np.searchsorted(self.keys[k - 1], tail(keys, k - 1))]
            self.keys[k], self.p[k] = keys, (c - d) / total[where] + weight[where] * lower

    def backing(self, contexts: np.ndarray, k: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts[k], contexts), len(self.contexts[k]) - 1)
        return np.where(self.contexts[k][at] == contexts, self.weight[k][at], 1.0)

    def probability(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(keys), 1 / ALPHABET)
        at = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
        found = self.keys[k][at] == keys
        out = self.p[k][at]
        rest = ~found
        if rest.any():
            out[rest] = self.backing(keys[rest] >> BITS, k) * self.probability(tail(keys[rest], k - 1) if k > 1 else keys[rest], k - 1)
        return out


class Model:
    """Sorted hash arrays for all languages together."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counted)
        each = [Smoothed(*counted[x]) for x in self.langs]
        self.hashes, self.log_p, self.context_hashes, self.log_w = {}, {}, {}, {}
        self.temperature, self.limit = 1.0, np.inf
        for k in range(1, ORDER + 1) if each else ():
            keys = np.unique(np.concatenate([m.keys[k] for m in each]))
            contexts = np.unique(np.concatenate([m.contexts[k] for m in each]))
            self.hashes[k], self.log_p[k] = self._sorted(keys, [m.probability(keys, k) for m in each])
            self.context_hashes[k], self.log_w[k] = self._sorted(contexts, [m.backing(contexts, k) for m in each])

    @staticmethod
    def _sorted(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h = keys * ODD  # bijective
        order = np.argsort(h)
        return h[order], np.log2(np.stack(columns, 1))[order].astype(np.float32)

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """Per n-gram and language, log2 of the last symbol's probability."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            h = keys * ODD
            at = np.searchsorted(self.hashes[k], h)
            at[at == len(self.hashes[k])] = 0
            hit = self.hashes[k][at] == h
            if k == ORDER:
                out = self.log_p[k][at]
                out[~hit] = 0
            else:
                out[left[hit]] += self.log_p[k][at[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                return out
            h = (keys >> BITS) * ODD
            at = np.searchsorted(self.context_hashes[k], h)
            at[at == len(self.context_hashes[k])] = 0
            hit = self.context_hashes[k][at] == h
            out[left[hit]] += self.log_w[k][at[hit]]
            keys = tail(keys, k - 1) if k > 1 else keys
        out[left] -= np.float32(np.log2(ALPHABET))
        return out

    def entropies(self, seqs: list[np.ndarray], piece: int = 1 << 19) -> np.ndarray:
        """Bits per symbol of each sequence under each language; nan for an empty one."""
        sums, sizes = np.zeros((len(seqs), len(self.langs))), np.array([len(s) for s in seqs])
        k = 0
        while k < len(seqs):
            j, n = k, 0
            while j < len(seqs) and (n == 0 or n + sizes[j] <= piece):
                n += sizes[j]
                j += 1
            keys = np.concatenate([grams(s) for s in seqs[k:j]]) if n else np.zeros(0, np.uint64)
            starts = np.concatenate(([0], np.cumsum(sizes[k:j])))
            if j == k + 1:  # one sequence, maybe a very long one
                for a in range(0, n, piece):
                    sums[k] -= self.log2(keys[a : a + piece]).sum(0, dtype=float)
            elif n:
                bits = self.log2(keys)
                some = np.flatnonzero(sizes[k:j])
                sums[k + some] = -np.add.reduceat(bits, starts[some], axis=0, dtype=float)
            k = j
        with np.errstate(invalid="ignore", divide="ignore"):
            return sums / np.where(sizes, sizes, np.nan)[:, None]

    def predict(self, seqs: list[np.ndarray]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each sequence."""
        if not self.langs:
            return [("und", 0.0, None, True)] * len(seqs)
        h = self.entropies(seqs)
        best = np.argmin(np.where(np.isnan(h), np.inf, h), axis=1)
        odds = np.exp2(-(h - h[np.arange(len(h)), best][:, None]) * self.temperature)
        score = 1 / odds.sum(1)
        out = []
        for i, s in enumerate(seqs):
            e = h[i, best[i]]
            out.append((self.langs[best[i]], float(score[i]), float(e), bool(e > self.limit)) if len(s) else ("und", 0.0, None, True))
        return out

    def calibrate(self, seqs: list[np.ndarray], truth: list[str]) -> None:
        """Temperature with the least log-loss, and the limit: the highest cross-entropy but for one in 500, and a bit."""
        known = [i for i, s in enumerate(seqs) if len(s) >= 20 and truth[i] in self.langs]
        if len(known) < 20:
            return
        h = self.entropies([seqs[i] for i in known])
        y = np.array([self.langs.index(truth[i]) for i in known])
        own = h[np.arange(len(y)), y]

        def loss(t: float) -> float:
            z = -(h - h.min(1, keepdims=True)) * t
            return float(np.mean(np.log2(np.exp2(z).sum(1)) + (own - h.min(1)) * t))

        self.temperature = min((2.0**k for k in range(-2, 8)), key=loss)
        self.limit = float(np.quantile(h.min(1), 0.998)) + 1.0


def _count(batches):
    table = letters()
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = symbols(text.as_py(), table)
            if len(s):
                by.setdefault(lang, []).append(grams(s))
        for lang, parts in by.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 1500, sample_chars: int = 20_000, held_back: int = 100) -> Model:
    """A model from labelled rows; see the module for the sample."""
    draw = lambda seed, n: F.pmod(F.xxhash64(*seed, id_col, text_col), n)
    # of a longer text, a piece from a drawn place
    piece = F.substring(F.col(text_col), (draw([F.lit("piece")], F.greatest(F.length(text_col) - sample_chars, F.lit(0)) + 1) + 1).cast("int"), F.lit(sample_chars))
    named = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = named.select(F.col(lang_col).alias("lang"), piece.alias("text"), draw([], F.lit(1_000_000)).alias("draw"), draw([F.lit("held")], F.lit(1000)).alias("slice"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    share = {x: min(1_000_000, int(1_000_000 * sample_docs / n) + 1) for x, n in sizes.items()}
    at_most = F.create_map(*(F.lit(y) for pair in share.items() for y in pair))[F.col("lang")]
    sample = rows.where(F.col("draw") < at_most)
    held = F.col("slice") < F.lit(min(200, 1000 * held_back // sample_docs))
    few = [x for x, n in sizes.items() if n < held_back]  # too few to hold any back
    if len(few) < len(sizes):
        held = held & ~F.col("lang").isin(few)
        learned = sample.where(~held)
    else:  # then the checks are on learned text
        learned = sample
    counted = learned.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, keys, n = np.array(counted["lang"].to_pylist(), object), counted["gram"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    per_lang = {}
    for lang in sorted(set(names)):
        own = np.flatnonzero(names == lang)
        own = own[np.argsort(keys[own])]
        per_lang[lang] = (keys[own], n[own])
    model = Model(per_lang)
    table = letters()
    checks = sample.where(held).select("draw", "lang", "text").orderBy("draw", "lang", "text").limit(4 * held_back * len(sizes)).collect()
    model.calibrate([symbols(r["text"], table) for r in checks], [r["lang"] for r in checks])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in carry, lang_pred, score, cross_entropy, rejected."""

    def run(batches):
        table = letters()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                got = model.predict([symbols(x.as_py(), table) for x in part.column(0)])
                cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols], [*part.schema.names[1:], "lang_pred", "score", "cross_entropy", "rejected"])

    kinds = dict(docs.dtypes)
    out = [id_col, *carry]
    return docs.select(F.col(text_col).alias("__text"), *out).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in out), "lang_pred string, score double, cross_entropy double, rejected boolean"]))


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected."""

    def make():
        table = letters()
        return lambda texts: [not x[3] for x in model.predict([symbols(t, table) for t in texts])]

    return keep_rows(docs, text_col, make)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(mod_crc(F.col(id_col), 5) == 0, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """From the documents that are not held out and carry a language."""
    return fit(docs.where(mod_crc(F.col("doc_id"), 5) != 0))
