import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lattica.llm import fim

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "chars": r"(?s).", "words": r"(?s)(?:\A[ \t-\r]*)?[^ \t-\r]+[ \t-\r]*|\A[ \t-\r]+\Z"}


def cut(text, doc_id, unit="lines"):
    """The contract by regular expressions over code points."""
    parts = re.findall(UNITS[unit], text)
    n = len(parts)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in fim.MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(parts[:low]), "".join(parts[low:high]), "".join(parts[high:])
    if h4 % 100 < 50:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts():
    r = random.Random(5)
    odd = ["", "\n", "\n\n", "a", "a\n", "\na", " \n \n", "é\n日本語\n\U0001f600", "a<P>b\nc", "<M>", "x<S", "<", "\r\n\r\n", "   ", " a b ", "no break " * 50]
    return odd + ["".join(r.choices("ab <\né中\U0001f600", k=r.randint(1, 400))) for _ in range(300)]


@pytest.mark.parametrize("unit", list(UNITS))
def test_against_regular_expressions(unit):
    for k, t in enumerate(texts()):
        n, form, a, b, out = fim.transform(t.encode(), k, unit=unit)
        assert (n, form, a, b, out.decode()) == cut(t, k, unit), (unit, t)
        assert fim.restore(out, form).decode() == t


def test_select_finds_every_bit():
    r = random.Random(1)
    for width in (1, 2, 3, 64, 65, 1000):
        bits = r.getrandbits(width)
        places = [i for i in range(width) if bits >> i & 1]
        assert [fim.select(bits, k, width) for k in range(len(places))] == places
        assert fim.select(bits, len(places), width) == width


def test_percent_and_marks():
    forms = {fim.transform(b"a\nb\n", k, percent=0)[1] for k in range(50)}
    assert forms == {"plain"}
    assert {fim.transform(b"a\nb\n", k, spm_percent=100)[1] for k in range(50)} == {"spm"}
    out = fim.transform(b"a\nb\n", 3, marks=("[p]", "[s]", "[m]"))
    assert fim.restore(out[4], out[1], ("[p]", "[s]", "[m]")) == b"a\nb\n"


def test_bad_marks(spark):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), marks=("<<P>", "<S>", "<M>"))


def test_long_text_takes_linear_time():
    import time

    took = []
    for n in (200_000, 800_000):
        data = b"ab\n" * n
        began = time.perf_counter()
        count, _, _, _, out = fim.transform(data, 1)
        took.append(time.perf_counter() - began)
        assert count == n and len(out) == len(data) + 9
    assert took[1] < 20 * took[0]


def test_table_with_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a\nb\nc", "y"), (2, "", None), (3, "a\n" * 30_000, "z"), (3, "a\n" * 30_000, "z"), (4, "has <M> in it\nb", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    made = fim.restored(fim.fill_in_middle(docs))
    got = sorted((tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text").collect()), key=str)
    assert got == sorted(((i, *cut(t or "", i), t or "") for i, t, _ in rows), key=str)
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    again = fim.restored(fim.fill_in_middle(docs.repartition(1))).select(F.sum(F.hash("output", "form"))).first()
    assert again == made.select(F.sum(F.hash("output", "form"))).first()
