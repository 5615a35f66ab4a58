"""Fill-in-middle transformation by bit-parallel arithmetic on big integers.

A text's UTF-8 bytes become masks: `bytes.translate` turns them into the digits 0 and 1 by class, and one integer holds
them, bit i for byte i. Shifted boolean operations on masks mark where units start, `bit_count` tells their number n, and
the byte at which a unit starts is found by halving: of a mask's lower half the ones are counted, and the search goes on
in the half that holds the bit wanted. All steps take time in proportion to the text, whatever it holds; there is no loop
over characters, lines or words.

Units: `lines` ([^\\n]*\\n|[^\\n]+), `words` (white space before a word belongs to the unit before it, at the start to the
first), `chars` (code points).

The cut of a document follows from a digest of seed and identifier, so each run, and each retry of a task, cuts alike:
h1 to h4 are the first four 8-digit groups of the hexadecimal SHA-256 of "seed:doc_id". The prefix ends after the smaller of
h1 % (n+1) and h2 % (n+1) units, the middle after the larger; h3 % 100 decides whether there is a cut, h4 % 100 the order.

Defined results:
    null text               as an empty text
    empty text              n 0, plain
    text with a mark        plain, as its parts could not be told apart again
    very long texts         whole
    null identifier         the digest is that of "seed:"
    ties (both cuts equal)  an empty middle
    repeated rows           each on its own; equal identifier and text give an equal row
    empty table             empty result
    further columns         ignored
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MARKS = ("<P>", "<S>", "<M>")


def digits(*members: int) -> bytes:
    """A table for bytes.translate: members to the digit 1, other bytes to 0."""
    return bytes(49 if b in members else 48 for b in range(256))


NEWLINE = digits(10)
WHITE = digits(9, 10, 11, 12, 13, 32)
FIRST = digits(*range(0x80), *range(0xC0, 0x100))  # bytes with which a code point starts


def mask(data: bytes, table: bytes) -> int:
    """Bit i is set where the table has byte i of data as a member."""
    return int(data[::-1].translate(table), 2) if data else 0


def starts(data: bytes, unit: str = "lines") -> int:
    """Bits of the bytes at which units start."""
    full = (1 << len(data)) - 1
    if not data:
        return 0
    if unit == "lines":
        return (mask(data, NEWLINE) << 1 | 1) & full
    if unit == "chars":
        return mask(data, FIRST) | 1
    if unit == "words":
        white = mask(data, WHITE)
        begins = full & ~white & (white << 1 | 1)
        return begins & ~(begins & -begins) | 1  # the first unit starts with the text
    raise ValueError(f"unit {unit!r}")


def select(bits: int, k: int, width: int) -> int:
    """The place of the k-th set bit, from 0 on; width if there is none."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        ones = low.bit_count()
        if k < ones:
            bits, width = low, half
        else:
            bits, width, at, k = bits >> half, width - half, at + half, k - ones
    return at


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))


def transform(data: bytes, doc_id: int | None, seed: int = 7, unit: str = "lines", percent: int = 100, spm_percent: int = 50, marks: tuple = MARKS) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of a text's bytes."""
    p, s, m = (x.encode() for x in marks)
    begins = starts(data, unit)
    n = begins.bit_count()
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or p in data or s in data or m in data or h3 % 100 >= percent:
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    one, two = select(begins, low, len(data)), select(begins, high, len(data))
    points = mask(data, FIRST)
    prefix_chars = (points & ((1 << one) - 1)).bit_count()
    middle_chars = (points & ((1 << two) - 1)).bit_count() - prefix_chars
    prefix, middle, suffix = data[:one], data[one:two], data[two:]
    if h4 % 100 < spm_percent:
        return n, "spm", prefix_chars, middle_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", prefix_chars, middle_chars, b"".join((p, prefix, s, suffix, m, middle))


def restore(output: bytes, form: str, marks: tuple = MARKS) -> bytes:
    """The text of an output: its parts lie between marks, which the text itself does not hold."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in marks)
    rest, _, middle = output.partition(m)
    if form == "psm":
        prefix, _, suffix = rest[len(p) :].partition(s)
    else:
        suffix, _, prefix = rest[len(s) :].partition(p)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, unit: str = "lines", percent: int = 100, spm_percent: int = 50, marks: tuple = MARKS) -> DataFrame:
    """One row per row: doc_id, n, form, prefix_chars, middle_chars (null if plain), output (text)."""
    if len(set(marks)) != 3 or any(x[:1] in y[1:] or not x for x in marks for y in marks):
        raise ValueError("marks must differ, and none's first character may stand further on in one")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                ids = part.column(0).to_pylist()
                rows = [transform(t or b"", i, seed, unit, percent, spm_percent, marks) for i, t in zip(ids, texts, strict=True)]
                n, form, prefix, middle, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, marks: tuple = MARKS) -> DataFrame:
    """made, as fill_in_middle gives it, with the column `text`: what its output and form hold."""
    at = made.columns.index("output"), made.columns.index("form")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                outputs, forms = part.column(at[0]).cast(pa.binary()).to_pylist(), part.column(at[1]).to_pylist()
                texts = pa.array([restore(o, f, marks) for o, f in zip(outputs, forms, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "text"])

    return made.mapInArrow(run, StructType([*made.schema.fields, StructField("text", StringType())]))
