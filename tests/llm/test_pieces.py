import hashlib
import random
import zlib

import numpy as np

from lattica.llm import pieces, queries


def brute(model, s):
    """Best score of a segmentation of s (spaces are marks already), by trying every piece at every place."""
    scores = {}
    for i, p in enumerate(model.text):
        if isinstance(p, str) and i in model.scores:
            scores[p.replace(" ", pieces.MARK)] = model.scores[i]
    best = [0.0] + [-np.inf] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - 40), end):
            if s[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[s[start:end]])
        if s[end - 1] not in model.covered:
            best[end] = max(best[end], best[end - 1] + model.lost)
    return best[-1]


def score(model, ids):
    total, k = 0.0, 0
    while k < len(ids):
        if ids[k] in model.scores:
            total += model.scores[ids[k]]
            k += 1
        else:
            lead = model.text[ids[k]][0]
            total += model.lost
            k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    return total


TEXTS = ["Hello world", " two  spaces ", "Über Straße, naïve café", "a▁b", "日本語 と 漢字", "🙂🙂 emoji", "tab\tnew\nline\r\n", "x" * 300, "1234567890", "<s> </s> <unk> <0x41>", "…—‘’", "\u0000\u0001", "é é", "don't stop!!! ((a)[b]{c})", "    ", "\n\n\n"]


def test_round_trip_and_best_score():
    model, r = pieces.Pieces(), random.Random(1)
    letters = "abcdeéfst  .,-\n▁漢🙂'\"()"
    for text in TEXTS + ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(200)]:
        ids = model.encode(text).tolist()
        assert model.decode(ids) == text
        if pieces.MARK not in text:
            marked = (" " + text).replace(" ", pieces.MARK)
            assert abs(score(model, ids) - brute(model, marked)) < 1e-6, text


def test_longest_piece_comes_first():
    model = pieces.Pieces()
    seen = {}
    for end, (length, _, _) in model.automaton.iter("▁the▁information▁was▁written"):
        assert length < seen.get(end, 99)
        seen[end] = length


def test_small_memory_gives_the_same():
    one, two = pieces.Pieces(), pieces.Pieces(cache=3)
    for text in TEXTS * 2:
        assert one.encode(text).tolist() == two.encode(text).tolist()


def test_tables(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "long word " * 20_000, 5), (3, "again", 5), (None, "x", 5), *((10 + i, t, 5) for i, t in enumerate(TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.decode(pieces.encode(docs)).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in got) == sorted((i or 0, t or "") for i, t, _ in rows)
    model = pieces.Pieces()
    for x in got:
        ids = model.encode(x["text"])
        assert x["n_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
    assert pieces.decode(pieces.encode(docs.where("false"))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [1, 2, 0, 99_999_999]), (3, [])], "doc_id long, ids array<int>")
    assert [x["text"] for x in pieces.decode(odd).orderBy("doc_id").collect()] == ["", "", ""]


def test_query_against_brute_force(spark, tmp_path):
    """Checksums of the query are those of best segmentations, and its texts come back whole."""
    rows = [(1, None), (2, "")] + [(10 + i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.QUERIES["op7_sentencepiece"](spark, str(tmp_path)).collect()}
    model = pieces.Pieces()
    for i, text in rows:
        x, text = got[i], text or ""
        ids = model.encode(text)
        assert (x["n_tokens"], x["ids_crc32"], x["decoded_chars"], x["decoded_sha256"]) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(text), hashlib.sha256(text.encode()).hexdigest())
        if text and pieces.MARK not in text:
            assert abs(score(model, ids.tolist()) - brute(model, (" " + text).replace(" ", pieces.MARK))) < 1e-6
