import math
import random
import zlib
from collections import Counter

import numpy as np

from lattica.llm import quality, queries

COMMON = "the of and to in a is that for it".split()


def good(r):
    out = []
    for _ in range(r.randint(3, 12)):
        words = [r.choice(COMMON) if r.random() < 0.35 else "".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 9))) for _ in range(r.randint(6, 14))]
        out.append(" ".join(words).capitalize() + r.choice([".", ".", ", though."]))
    return " ".join(out)


def bad(r):
    kind = r.randrange(4)
    if kind == 0:
        return " ".join("".join(r.choices("#$%^&*@!~|<>", k=r.randint(2, 8))) for _ in range(r.randint(20, 80)))
    if kind == 1:
        return " ".join(r.choices(["BUY NOW", "CLICK HERE", "FREE"], k=60))
    if kind == 2:
        return " ".join([r.choice(["spam", "ham"])] * r.randint(40, 90))
    return " ".join(f"| {x} {x} |" for x in r.choices(["menu", "home", "login"], k=60))


def corpus(seed=1, n=600):
    r = random.Random(seed)
    return [(i, bad(r) if i % 5 == 0 else good(r), i % 5 != 0) for i in range(n)]


def test_labels_without_truth_part_good_from_bad(spark):
    rows = corpus()
    odd = [(5000, None, None), (5001, " \n", None), (5002, "", None), (5003, good(random.Random(9)) * 500, True), (5004, "one", None), (None, good(random.Random(3)), True)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + odd], "doc_id long, text string, quality string")
    weights = quality.fit(docs)
    got = {x["doc_id"]: x for x in quality.score(docs, weights).collect()}
    assert len(got) == len(rows) + len(odd)
    right = np.mean([got[i]["kept"] == y for i, _, y in rows])
    assert right > 0.97
    assert np.mean([got[i]["kept"] for i, _, y in rows if y]) > 0.99
    assert not got[5000]["kept"] and not got[5001]["kept"] and got[5001]["quality"] == 0 and got[5003]["kept"] and got[None]["kept"]
    kept = quality.keep(docs, weights)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["kept"]}


def test_estimated_accuracies_follow_the_labellers():
    r = np.random.default_rng(3)
    n, accuracy = 20_000, [0.95, 0.9, 0.85, 0.8, 0.7, 0.9, 0.6, 0.75]
    y = r.random(n) < 0.7
    v = np.zeros((n, quality.LABELLERS), int)
    for j, a in enumerate(accuracy):
        right = r.random(n) < a
        v[:, j] = np.where(r.random(n) < 0.2, 0, np.where(right == y, quality.GOOD, quality.BAD))
    patterns, counts = np.unique((v * 3 ** np.arange(quality.LABELLERS)).sum(1), return_counts=True)
    post, table = quality.label_model(patterns, counts.astype(float))
    for j, a in enumerate(accuracy):
        found = table[1, j, quality.GOOD] / (table[1, j, quality.GOOD] + table[1, j, quality.BAD])
        assert abs(found - a) < 0.03
    best = dict(zip(patterns.tolist(), post > 0.5, strict=True))
    assert np.mean([best[p] == t for p, t in zip((v * 3 ** np.arange(quality.LABELLERS)).sum(1).tolist(), y, strict=True)]) > 0.95


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert quality.fit(docs) is None and quality.fit(docs.where("false")) is None
    assert [x["kept"] for x in quality.score(docs, None).collect()] == [False, False]
    rows = corpus(2, 100)
    twice = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2, "doc_id long, text string")
    got = quality.score(twice, quality.fit(twice)).groupBy("doc_id").agg({"quality": "min", "kept": "count"}).collect()
    assert all(x["count(kept)"] == 2 for x in got)


def test_query_against_plain_loops(spark, tmp_path):
    """Vote patterns, expectation-maximisation and the scorer's gradient steps over dictionaries, one number at a time."""
    rows = [(i, t) for i, t, _ in corpus(4, 60)] + [(900, None), (901, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["quality"], x["kept"]) for x in queries.QUERIES["op6_quality_classifier"](spark, str(tmp_path)).collect()}
    table, vectors, seen = quality.classes(), {}, {}
    for i, t in rows:
        words = (t or "").split()
        if words:
            x = quality.numbers(t, Counter(words), words, table)
            seen[i] = quality.votes(x)
            v = Counter()
            for w, k in Counter(words).items():
                shape = []
                for c in w[:64]:
                    s = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
                    if not shape or shape[-1] != s:
                        shape.append(s)
                v["s", zlib.crc32(("shape " + "".join(shape)).encode()) % quality.SLOTS] += k / len(words)
                v["w", zlib.crc32(w.lower().encode()) % quality.SLOTS] += k / len(words)
            out = Counter()
            for (kind, slot), share in v.items():
                out[slot] += (1 if kind == "s" else 0.3) * math.sqrt(share)
            for j, y in enumerate(x):
                out[quality.SLOTS + j] = min(3 * y, 3)
                out[zlib.crc32(b"number %d %d" % (j, min(20, int(y * 20)))) % quality.SLOTS] += 0.5
            vectors[i] = out
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    post = {i: 1 / (1 + math.exp(-(0.5 * v.count(quality.GOOD) - 3 * v.count(quality.BAD)))) for i, v in seen.items()}
    for _ in range(60):
        weight = {0: {i: 1 - p for i, p in post.items()}, 1: post}
        prior = [1 + sum(weight[c].values()) for c in (0, 1)]
        tables = [[[0.1 + sum(w for i, w in weight[c].items() if seen[i][j] == k) for k in range(3)] for j in range(quality.LABELLERS)] for c in (0, 1)]
        chance = lambda c, v: math.log(prior[c] / sum(prior)) + sum(math.log(t[k] / sum(t)) for t, k in zip(tables[c], v, strict=True))  # noqa: B023, E731
        post = {i: 1 / (1 + math.exp(max(-50, min(50, chance(0, v) - chance(1, v))))) for i, v in seen.items()}
    w, m, s, last = Counter(), Counter(), Counter(), quality.SLOTS + quality.NUMBERS
    for x in vectors.values():
        x[last] = 1.0
    for t in range(1, 151):
        g = Counter({k: 1e-4 * v for k, v in w.items()})
        for i, x in vectors.items():
            off = (sigmoid(sum(w[k] * v for k, v in x.items())) - post[i]) / len(vectors)
            for k, v in x.items():
                g[k] += off * v
        for k in g:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            w[k] -= 0.05 * (m[k] / (1 - 0.9**t)) / (math.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    for i, _ in rows:
        want = sigmoid(sum(w[k] * v for k, v in vectors[i].items())) if i in vectors else 0.0
        assert abs(got[i][0] - want) < 0.02 and got[i][1] == (got[i][0] >= 0.5), (i, got[i], want)


def test_a_score_at_the_threshold_is_kept(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    none = np.zeros(quality.SLOTS + quality.NUMBERS + 1, np.float32)
    assert {x["doc_id"]: (x["quality"], x["kept"]) for x in quality.score(docs, none).collect()} == {1: (0.5, True), 2: (0.0, False)}
