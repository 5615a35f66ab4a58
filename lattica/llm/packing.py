"""Packing token sequences by the sum-of-squares rule.

Each task packs the documents it reads, as they come. The level array counts open sequences by fill; a piece of s
tokens goes to the level h (0 opens a sequence) for which moving one sequence from h to h+s gives the least sum of
squared counts, so levels that are rare fill up and no level piles up. Whole multiples of the window leave a document
first, as full sequences. A second step ends each task: of the sequences that the rule has left open, the emptiest are cut
up to fill the gaps of the fullest, so at most one sequence of a task stays partly filled. `by_rule` tells the sequences
that the rule filled from those of the second step.

A task holds the ids of its open sequences in two bytes each (vocabularies of over 65,536 ids take four): less than what
its split holds, and no size changes a placement. Sequence numbers are the task's number times 2^40 plus a counter, so a
task run again on the same split gives the same rows.

Defined results:
    null text, empty text   a document of one token, the end id
    very long texts         cut at window borders; every id lies in exactly one piece
    null identifier         packed like any other, doc_id null
    ties between levels     the fuller sequence
    repeated rows           each packed on its own
    empty table             empty result
    further columns         ignored
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, by_rule boolean"
#: Texts with a character from here on go to the tokenizers library itself; below it both libraries split words alike.
PLAIN = 0x250


class Encoder:
    """Ids as the tokenizers library gives them for byte_bpe_50k.json.

    For Latin text the same vocabulary is applied by tiktoken, which is three times as fast and gives equal ids
    (tests hold the two against each other). Anything else, and texts with one of the file's added tokens, which
    tokenizers reads as that token wherever it stands, goes through tokenizers.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers as files
        import tiktoken

        self.json_path = json_path or files.path("byte_bpe_50k.json")
        with open(ranks_path or files.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.json_path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f).get("added_tokens") or []]
        self.slow = None

    def ids(self, text: str) -> list[int]:
        if (text.isascii() or max(text) < chr(PLAIN)) and not any(x in text for x in self.added):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids


class Packer:
    """The level array and the open sequences of one task."""

    def __init__(self, window: int, base: int):
        self.window, self.base = window, base
        self.count = np.zeros(window + 1, np.int64)  # open sequences by fill; 0 and window stay 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.number, self.n_open, self.by_rule = 0, 0, True
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        whole = total - total % w
        for start in range(0, whole, w):
            self._emit([(doc, start, ids[start : start + w], total)])
        if total > whole:
            rest = ids[whole:]
            self._place((doc, whole, rest.astype("<u2" if int(rest.max()) < 1 << 16 else "<u4"), total))

    def _place(self, piece: tuple) -> None:
        s, w = len(piece[2]), self.window
        after = self.count[s : w + 1].copy()  # for levels h = 0 .. w-s: what stands at h+s
        before = self.count[: w - s + 1]
        cost = 2 * (after - before) + 2
        cost[0] = 2 * after[0] + 1  # a new sequence
        cost[w - s] = 1 - 2 * before[w - s]  # a sequence that gets full and leaves
        usable = before > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        h = w - s - int(np.argmin(cost[::-1]))
        parts = self._take(h) if h else []
        parts.append(piece)
        self._put(h + s, parts)

    def _take(self, h: int) -> list[tuple]:
        self.count[h] -= 1
        self.n_open -= 1
        return self.open[h].pop()

    def _put(self, h: int, parts: list[tuple]) -> None:
        if h == self.window:
            self._emit(parts)
        else:
            self.count[h] += 1
            self.n_open += 1
            self.open[h].append(parts)

    def settle(self) -> None:
        """Fill the fullest open sequences with pieces of the emptiest, cut to size, until one is open at most."""
        self.by_rule = False
        low, high, spare = 1, self.window - 1, []
        while self.n_open > 1 or spare:
            while high and not self.open[high]:
                high -= 1
            parts = self._take(high) if high else []
            fill = sum(len(p[2]) for p in parts)
            while fill < self.window:
                if not spare:
                    while low < self.window and not self.open[low]:
                        low += 1
                    if low == self.window:
                        break
                    spare = self._take(low)
                doc, start, ids, total = spare.pop()
                room = self.window - fill
                parts.append((doc, start, ids[:room], total))
                fill += min(room, len(ids))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
            self._put(fill, parts)
            if fill < self.window:  # nothing was left to fill it with
                return

    def close(self) -> None:
        self.settle()
        for level in self.open:
            while level:
                self._emit(level.pop())

    def _emit(self, parts: list[tuple]) -> None:
        offset, sequence = 0, self.base + self.number
        self.number += 1
        for doc, start, ids, total in parts:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, self.by_rule))
            offset += len(ids)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            names, kinds = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.bool_()) for c, kind in zip(zip(*self.out, strict=True), kinds, strict=True)], list(names))
            self.out = []


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece, see SCHEMA."""

    def run(batches):
        from pyspark import TaskContext

        encoder = Encoder(json_path, ranks_path)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "")
                packer.add(doc, np.array([*ids, end_id], "<u4"))
            yield from packer.batches(10_000)
        packer.close()
        yield from packer.batches()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
