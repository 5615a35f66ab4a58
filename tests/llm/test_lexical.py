import math
import random
import re
from collections import Counter

import pytest

from lattica.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute(docs, items, top=50):
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            s = 0
            for w in terms & c.keys():
                m = 50 + (50 * sum(c.values()) * n_docs) // total
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(seed, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Äpfel", "日本語", "Z9", "z9"]
    docs = []
    for i in range(n):
        x = r.random()
        if x < 0.1:
            docs.append((i, r.choice([None, "", " .,- ", "\n"])))
        elif x < 0.3:
            docs.append((i, "w1 w2 w3 the same text"))  # ties by the dozen
        else:
            docs.append((i, r.choice([" ", "-", ", "]).join(r.choices(vocabulary, k=r.randint(1, 60)))))
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for k in range(15)] + [(90, None), (91, "?!"), (92, "unseen words"), (93, "w1"), (93, "W2 same"), (None, "w5")]
    return docs, items


@pytest.mark.parametrize(("shard_docs", "top", "n"), [(2048, 50, 400), (37, 50, 400), (300, 5, 900), (1, 3, 60)])
def test_against_scoring_all(spark, shard_docs, top, n):
    docs, items = corpus(shard_docs, n)
    docs += [(None, "w7 w7 w8"), (3, "w1 w2 w3 the same text"), (3, "w1 w2 w3 the same text")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    shards = lexical.materialise(lexical.index(d, shard_docs=shard_docs), file_rows=3)
    got = lexical.search(shards, q, top=top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, top)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    docs, items = corpus(8, 120)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in lexical.lexical_search(d, q).collect()), key=str) == brute(docs, items)


def test_bounds_end_the_search_early():
    import numpy as np

    r = np.random.default_rng(1)
    values = r.integers(0, 1000, (3, 4096)).astype(np.int32)
    values[:, 77] = 900_000
    found: list = []
    opened = lexical.Tree(values).search(np.arange(3), np.array([5, 6, 7]), np.arange(4096), np.ones(4096, bool), found, 1)
    assert found == [(18 * 900_000, -77, True)] and opened <= 4


def test_equal_bounds_are_opened_for_the_smaller_identifier():
    import numpy as np

    values = np.ones((1, 300), np.int32)
    order = np.arange(300)[::-1].copy()
    found: list = []
    lexical.Tree(values).search(np.array([0]), np.array([2]), order, np.ones(300, bool), found, 5)
    assert sorted(-i for _, i, _ in found) == [0, 1, 2, 3, 4]


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.lexical_search(d, q).count() == 0
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.lexical_search(d, one).count() == 0
    assert lexical.lexical_search(one.withColumnRenamed("item_id", "doc_id"), q).count() == 0


def test_long_text_stays_whole(spark):
    d = spark.createDataFrame([(1, "x y " * 200_000), (2, "x z")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "y z x")], "item_id long, text string")
    shards = lexical.materialise(lexical.index(d, shard_terms=1000))
    assert sorted((tuple(r) for r in lexical.search(shards, q).collect()), key=str) == brute([(1, "x y " * 200_000), (2, "x z")], [(1, "y z x")])
