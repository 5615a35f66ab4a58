import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm.packing import Encoder, Packer, pack


def checked(pieces, docs, window):
    """Every id once, sequences gapless and not over the window. Total of ids, number of sequences."""
    by_doc, by_seq = {}, {}
    for doc, start, length, crc, total, seq, offset, _ in pieces:
        by_doc.setdefault(doc, []).append((start, length, crc, total))
        by_seq.setdefault(seq, []).append((offset, length))
    assert by_doc.keys() == docs.keys()
    for doc, parts in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(parts):
            assert start == at and length > 0 and total == len(docs[doc])
            assert crc == zlib.crc32(np.array(docs[doc][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(docs[doc])
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(map(len, docs.values())), len(by_seq)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([0, 65_500, 70_000]))
def test_packer_loses_nothing_and_fills_up(sizes, first):
    docs = {i: [first + i] * n for i, n in enumerate(sizes)}
    p = Packer(16, 0)
    for i, ids in docs.items():
        p.add(i, np.array(ids, "<u4"))
    filled = p.number
    p.close()
    assert {x[5] for x in p.out if x[7]} == set(range(filled))
    total, sequences = checked(p.out, docs, 16)
    assert sequences == -(-total // 16)


def test_each_piece_goes_where_the_sum_of_squares_is_least():
    r, w = random.Random(2), 32
    p = Packer(w, 0)
    for i in range(300):
        s = r.randint(1, w - 1)
        before = p.count.copy()

        def after(h):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + s < w:
                c[h + s] += 1
            return int((c[1:w] ** 2).sum())

        options = {h: after(h) for h in range(w - s + 1) if h == 0 or before[h]}
        p.add(i, np.full(s, i, "<u4"))
        assert int((p.count[1:w] ** 2).sum()) == min(options.values())


TEXTS = ["", "plain words", "<|endoftext|> it's  two", "naïve façade ÀÉ x", "日本語 text", "a\x1cb\x85c d", "é" * 300, "123 4567 8.9\n\n\n  x", "🙂 ok", "don't DON'T", "a <|endoftext|> b", "日<|endoftext|><|endoftext|>本"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_tokenizers_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Encoder().ids(text) == own.encode(text, add_special_tokens=False).ids


def test_ids_on_random_latin_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, fast, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder(), random.Random(4)
    for _ in range(400):
        text = "".join(chr(r.choice([r.randrange(0x250), r.randrange(32, 127), 32])) for _ in range(60))
        assert fast.ids(text) == own.encode(text, add_special_tokens=False).ids


def test_query_on_a_table(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "word " * 5000])]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, offset int").coalesce(1)
    e = Encoder()
    got = [tuple(x) for x in pack(docs).collect()]
    total, sequences = checked(got, {i: [*e.ids(t or ""), 0] for i, t in rows}, 1024)
    assert sequences == -(-total // 1024)
    assert pack(docs.where("doc_id < 0")).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x")], "doc_id long, text string")
    assert pack(twice).count() == 3
