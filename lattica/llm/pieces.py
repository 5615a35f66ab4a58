"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once; at each position it gives, through its output links, every
piece that ends there, and each relaxes the best score of that position (Viterbi). Where no piece covers a character,
it goes as UTF-8 byte pieces. No piece holds a space mark behind another character, and none mixes certain signs (found
from the pieces when a model is read) with other characters, so a segmentation falls apart at runs of spaces and of such
signs; units between these cuts are looked up in a bounded table first.

A unigram model's own scores are used. A BPE model has ranks in place of scores; its pieces get the log-probability of
a Zipf-Mandelbrot law over ranks, 1 / (rank + 2.7), and the result is the most probable segmentation under that law
(not the sequence of BPE merges). Decoding is exact for either kind: it gives back every text.

Defined results:
    null text         no ids, decoded as an empty text
    empty text        no ids
    very long texts   whole; memory is linear in the longest run without a space
    ties              the longer last piece
    repeated rows     each on its own
    U+2581 in a text  byte pieces, so that decoding does not make it a space
    null id list      an empty text; ids outside the vocabulary or control ids decode to nothing
    empty table       empty result
    further columns   ignored
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SHIFT = 2.7


class Known(dict):
    """Packed ids of units. When `most` units are there, they become the older half, which is asked before computing."""

    def __init__(self, compute, most: int, longest: int = 40):
        super().__init__()
        self.compute, self.most, self.longest, self.older = compute, most, longest, {}

    def __missing__(self, unit: str) -> bytes:
        got = self.older.get(unit)
        if got is None:
            got = array("i", self.compute(unit)).tobytes()
        if len(unit) < self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[unit] = got
        return got


class Pieces:
    """One model file as automaton, scores and decoding table."""

    def __init__(self, model_path: str | None = None, cache: int = 350_000):
        import ahocorasick
        import sentencepiece

        if model_path is None:
            import public_tokenizers

            model_path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        self.bytes = {}
        self.text: list[str | bytes | None] = [None] * n
        normal = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((i, piece, sp.get_score(i)))
                self.text[i] = piece.replace(MARK, " ")
        ranked = all(s == round(s) for _, _, s in normal) and len({s for _, _, s in normal}) == len(normal)
        if ranked:
            order = sorted(normal, key=lambda x: -x[2])
            total = math.log(sum(1 / (r + SHIFT) for r in range(len(order))))
            normal = [(i, p, -math.log(r + SHIFT) - total) for r, (i, p, _) in enumerate(order)]
        self.scores = {i: s for i, _, s in normal}
        self.covered = frozenset(p for _, p, _ in normal if len(p) == 1)
        self.lost = min(s for _, _, s in normal) - 10
        self.automaton = ahocorasick.Automaton()
        for i, p, s in normal:
            self.automaton.add_word(p, (len(p), i, s))
        self.automaton.make_automaton()
        signs = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} | {"\n", "\t", "\r"}
        bodies = [set(p.lstrip(MARK)) for _, p, _ in normal]
        while mixed := {c for b in bodies if b - signs for c in b & signs}:
            signs -= mixed
        cut = re.escape("".join(sorted(signs)))
        self.units = re.compile(f" *[^ {cut}]+| *[{cut}]+| +") if signs else re.compile(r" *[^ ]+| +")
        self.known = Known(self._unit, cache)
        each = [x if isinstance(x, bytes) else (x or "").encode() for x in self.text] + [b""]  # the last for all else
        self.sizes = np.array([len(x) for x in each])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def _bytes(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]

    def segment(self, s: str) -> tuple[int, ...]:
        """Ids of the best segmentation of s, in which spaces are marks already."""
        n = len(s)
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        if self.covered.issuperset(s):
            for end, found in self.automaton.iter(s):  # of pieces with one end the longest comes first
                end += 1
                total = best[end - found[0]] + found[2]
                if total > best[end]:
                    best[end], back[end] = total, found
        else:
            self._with_gaps(s, best, back)
        ids: list[int] = []
        while n:
            found = back[n]
            if found is None:
                ids += reversed(self._bytes(s[n - 1]))
                n -= 1
            else:
                ids.append(found[1])
                n -= found[0]
        return tuple(reversed(ids))

    def _with_gaps(self, s: str, best: list, back: list) -> None:
        """The same where no single piece covers some characters: these go at the score `lost`."""
        covered, lost, done = self.covered, self.lost, 0  # positions up to done are final
        for end, found in self.automaton.iter(s):
            while done < end:
                if s[done] not in covered and best[done] + lost > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + lost, None
                done += 1
            total = best[end + 1 - found[0]] + found[2]
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, found
        while done < len(s):
            if s[done] not in covered and best[done] + lost > best[done + 1]:
                best[done + 1], back[done + 1] = best[done] + lost, None
            done += 1

    def _unit(self, unit: str) -> tuple[int, ...]:
        if MARK not in unit:
            return self.segment(unit.replace(" ", MARK))
        ids: list[int] = []
        for k, part in enumerate(unit.split(MARK)):
            ids += self._bytes(MARK) if k else []
            ids += self.segment(part.replace(" ", MARK)) if part else []
        return tuple(ids)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.units.findall(" " + text))), "<i4")

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        n = len(self.text)
        ids = np.where((ids >= 0) & (ids < n), ids, n)
        out = []
        for k in range(0, len(ids), 1 << 20):
            sizes = self.sizes[ids[k : k + (1 << 20)]]
            first = self.starts[ids[k : k + (1 << 20)]] - (np.cumsum(sizes) - sizes)
            out.append(self.flat[np.repeat(first, sizes) + np.arange(sizes.sum())].tobytes())
        text = b"".join(out).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str | None, Pieces] = {}


def loaded(model_path: str | None) -> Pieces:
    """The model of a file, kept by a worker process for the tasks to come."""
    if model_path not in _LOADED:
        _LOADED.clear()
        _LOADED[model_path] = Pieces(model_path)
    return _LOADED[model_path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """id, ids array<int>."""

    def run(batches):
        model = loaded(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.encode(x.as_py()) for x in part.column(1)], pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """id, n_tokens, ids_crc32 (unsigned, little-endian 32-bit ids), n_byte_tokens, text."""

    def run(batches):
        model = loaded(model_path)
        is_byte = np.array([isinstance(x, bytes) for x in model.text])
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lists = [np.array([] if x.as_py() is None else x.values, "<u4") for x in part.column(1)]
                known = [x[x < len(is_byte)] for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in lists], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in lists], pa.int64()),
                        pa.array([int(is_byte[x].sum()) for x in known], pa.int64()),
                        pa.array([model.decode(x) for x in known], pa.string()),
                    ],
                    [id_col, "n_tokens", "ids_crc32", "n_byte_tokens", "text"],
                )

    return tokens.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {dict(tokens.dtypes)[id_col]}, n_tokens long, ids_crc32 long, n_byte_tokens long, text string")
