r"""Ranked lexical search by branch and bound over hierarchical max trees.

Index: documents are dealt into shards, runs of at most `shard_docs` documents or about `shard_terms` terms of one task. A
shard is one row: identifiers and lengths of its documents, its distinct terms sorted by a 64-bit hash, and the postings of each
term (places of documents and frequencies). It holds every row and every term of the texts, whatever is asked later.

Search: for a term asked, a shard has a tree of maxima over ranges of its documents: one value a document, one for each
`FAN` documents, for each FAN x FAN and so on to the shard. The bound of a range for an item is the sum of its terms'
maxima there, and no document in it scores more. A heap gives the range with the highest bound; ranges are opened into
their parts, documents are scored. The search of a shard ends when the highest bound is below the score of the last of the
`top` found so far; a range with an equal bound is still opened, as it may hold a document with that score and a smaller
identifier. What a task has found in earlier shards counts from the start, so most shards end at their root.
Each task gives its best for each item, at most `top`; those are ranked in two steps, within a fixed number of parts and
then over all, so that no group grows with the number of tasks.

Scores are in whole numbers (see `search`), and equal to those of scoring every document.

Items are taken in blocks of at most `BLOCK_ITEMS` items and `BLOCK_TERMS` distinct terms (more only if one item alone has
more), one pass over the index a block: that is what goes to every task, whatever the number of items.

Defined results:
    null text, no terms         a document counts in nothing and is never found; such an item finds nothing
    very long texts             whole; a document is never split over shards, and a shard ends with it
    null identifier             found like any other; among equal scores after all others
    items with equal item_id    one item with the terms of all
    ties                        the smaller identifier first; equal identifiers in any order, they do not differ
    repeated rows               each is a document of its own
    empty table                 empty result
    further columns             ignored
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FAN = 16
BLOCK_ITEMS, BLOCK_TERMS = 1000, 4096
PARTS = 64
NO_ID = np.iinfo(np.int64).max
#: A-Z in lower case; other ASCII characters that are no letters or digits become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SHARD = "ids array<long>, lengths array<int>, hashes binary, terms array<binary>, ends binary, places binary, counts binary, n_docs long, n_terms long"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Shard:
    """Documents gathered for a row of the index."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.number: dict[bytes, int] = {}
        self.chunks: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms_of(text)
        met = Counter(words)
        number = self.number
        own = np.fromiter((number.setdefault(w, len(number)) for w in met), np.int64, len(met))
        self.chunks.append((own, np.fromiter(met.values(), np.uint32, len(met)), len(self.ids)))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.size += len(words)

    def row(self) -> dict:
        words = list(self.number)
        hashes = _hashes(words)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        own = rank[np.concatenate([c[0] for c in self.chunks])] if self.chunks else np.zeros(0, np.int64)
        counts = np.concatenate([c[1] for c in self.chunks]) if self.chunks else np.zeros(0, np.uint32)
        places = np.repeat(np.array([c[2] for c in self.chunks], np.uint32), [len(c[0]) for c in self.chunks])
        by_term = np.argsort(own, kind="stable")
        return {
            "ids": self.ids, "lengths": self.lengths, "hashes": hashes[order].tobytes(), "terms": [words[i] for i in order],
            "ends": np.cumsum(np.bincount(own, minlength=len(words)).astype(np.uint32), dtype=np.uint32).tobytes(), "places": places[by_term].tobytes(), "counts": counts[by_term].tobytes(),
            "n_docs": sum(n > 0 for n in self.lengths), "n_terms": self.size,
        }


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 2048, shard_terms: int = 1_500_000) -> DataFrame:
    """A row a shard; see SHARD."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("hashes", pa.binary()), ("terms", pa.list_(pa.binary())), ("ends", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def run(batches):
        shard = Shard()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    shard.add(doc_id, text)
                    if len(shard.ids) >= shard_docs or shard.size >= shard_terms:
                        yield pa.RecordBatch.from_pylist([shard.row()], schema)
                        shard = Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SHARD)


class Items:
    """A block of items: distinct terms, and for each item which of them it has."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]) -> None:
        self.ids = [i for i, _ in rows]
        self.words = sorted({w for _, words in rows for w in words})
        number = {w: k for k, w in enumerate(self.words)}
        self.has = [np.array(sorted({number[w] for w in words}), np.int64) for _, words in rows]
        self.hashes = _hashes(self.words)


def _found(items: Items, hashes: np.ndarray, terms) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of terms asked, their places among a shard's terms); a hash finds, the term itself decides."""
    asked, places = [], []
    at = np.searchsorted(hashes, items.hashes)
    for k in np.flatnonzero(at < len(hashes)):
        i = at[k]
        while i < len(hashes) and hashes[i] == items.hashes[k]:
            if terms[int(i)].as_py() == items.words[k]:
                asked.append(k)
                places.append(i)
            i += 1
    return np.array(asked, np.int64), np.array(places, np.int64)


def _ranges(batch: pa.RecordBatch, r: int, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms asked that the shard in row r holds, where their postings begin, where they end)."""
    hashes = np.frombuffer(batch["hashes"][r].as_py(), np.uint64)
    asked, places = _found(items, hashes, batch["terms"][r].values)
    ends = np.frombuffer(batch["ends"][r].as_py(), np.uint32).astype(np.int64)
    return asked, np.where(places > 0, ends[places - 1], 0) if len(places) else places, ends[places] if len(places) else places


def document_frequencies(shards: DataFrame, items: Items) -> np.ndarray:
    """How many documents of the index hold each term of the block (one number a term comes to the driver)."""

    def run(batches):
        df = np.zeros(len(items.words), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                asked, first, last = _ranges(batch, r, items)
                df[asked] += last - first
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])

    out = np.zeros(len(items.words), np.int64)
    for term, df in shards.select("hashes", "terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


class Tree:
    """Maxima of the terms asked over ranges of a shard's documents, one level for each power of FAN."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            short = -low.shape[1] % FAN
            full = np.pad(low, ((0, 0), (0, short))) if short else low
            self.levels.append(full.reshape(len(full), -1, FAN).max(2))

    def search(self, rows: np.ndarray, weights: np.ndarray, order: np.ndarray, named: np.ndarray, found: list, top: int) -> int:
        """found: heap of the best so far, (score, -identifier, whether there is one), which grows to `top`. order, named: the
        documents' identifiers, and whether they have one. Returns how many ranges were opened."""
        high, opened = len(self.levels) - 1, 0
        heap = [(-int(weights @ self.levels[high][rows, 0]), high, 0)]
        while heap:
            bound, level, at = heapq.heappop(heap)
            if not bound or (len(found) == top and -bound < found[0][0]):
                break
            if not level:
                entry = (-bound, -int(order[at]), bool(named[at]))
                if len(found) < top:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
                continue
            opened += 1
            below = weights @ self.levels[level - 1][rows, at * FAN : (at + 1) * FAN]
            least = found[0][0] if len(found) == top else 1
            for k in np.flatnonzero(below >= least):
                heapq.heappush(heap, (-int(below[k]), level - 1, at * FAN + int(k)))
        return opened


def _values(batch: pa.RecordBatch, r: int, first: np.ndarray, last: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each asked term (row) adds to each document (column) of the shard, before its weight: under 10^6."""
    lengths = np.asarray(batch["lengths"][r].values, np.int64)
    m = 50 + (50 * lengths * n_docs) // max(n_terms, 1)
    places, counts = np.frombuffer(batch["places"][r].as_py(), np.uint32), np.frombuffer(batch["counts"][r].as_py(), np.uint32)
    out = np.zeros((len(first), len(lengths)), np.int32)
    for k, (a, b) in enumerate(zip(first, last, strict=True)):
        at, tf = places[a:b], counts[a:b].astype(np.int64)
        out[k, at] = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
    return out


def best_of_tasks(shards: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item_id, doc_id, score: the best of each task for each item of the block, `top` at most."""

    def run(batches):
        best: list[list] = [[] for _ in items.ids]
        for batch in batches:
            for r in range(batch.num_rows):
                asked, first, last = _ranges(batch, r, items)
                if not len(asked):
                    continue
                ids = batch["ids"][r].values
                order, named = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
                tree = Tree(_values(batch, r, first, last, n_docs, n_terms))
                row_of = np.full(len(items.words), -1, np.int64)
                row_of[asked] = np.arange(len(asked))
                for found, has in zip(best, items.has, strict=True):
                    rows = row_of[has]
                    there = rows >= 0
                    if there.any():
                        tree.search(rows[there], weights[has[there]], order, named, found, top)
        pairs = [(items.ids[k], -i if named else None, s) for k, found in enumerate(best) for s, i, named in found]
        for k in range(0, len(pairs), 50_000):
            one = list(zip(*pairs[k : k + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in one], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, "item_id long, doc_id long, score long")


def blocks_of(items: DataFrame, id_col: str, text_col: str):
    """Items in the order of their identifiers, in blocks of bounded size."""
    rows: list[tuple[int | None, set[bytes]]] = []
    words: set[bytes] = set()
    texts = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).orderBy("id")
    for item_id, text in texts.toLocalIterator():
        own = set(terms_of((text or "").encode("utf-8", "surrogatepass")))
        if rows and rows[-1][0] == item_id:
            rows[-1][1].update(own)
            words |= own
            continue
        if rows and (len(rows) >= BLOCK_ITEMS or len(words | own) > BLOCK_TERMS):
            yield Items(rows)
            rows, words = [], set()
        rows.append((item_id, own))
        words |= own
    if rows:
        yield Items(rows)


def rank(found: DataFrame, top: int) -> DataFrame:
    """found: item_id, doc_id, score, part. The `top` of each item, first within parts, then over all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    within = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= top)
    over = within.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return over.select("item_id", "rank", "doc_id", "score")


def search(shards: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = 50) -> DataFrame:
    """shards: a table as `index` gives it. item_id, rank, doc_id, score: each item's `top` documents with a score over 0.

    N documents have a term, L is the number of all their terms, n that of one document, df that of documents with a term,
    tf its occurrences in one. A term weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))), a document m = 50 + 50 n N div L; its
    score sums w * (10^9 tf div (1000 tf + 20 m)) over the item's distinct terms."""
    n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    out = None
    for block in blocks_of(items, id_col, text_col):
        df = document_frequencies(shards, block)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = best_of_tasks(shards, block, weights, n_docs, n_terms, top)
        one = materialise(found.withColumn("part", F.spark_partition_id() % PARTS))
        out = one if out is None else out.union(one)
    if out is None:
        out = shards.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, part int")
    return rank(out, top)


def lexical_search(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """Index and search at once: docs (doc_id, text), items (item_id, text)."""
    return search(materialise(index(docs), file_rows=8), items, top=top)
