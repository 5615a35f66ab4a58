import math
import random
import zlib
from collections import Counter

import numpy as np

from lattica.llm import pitman_yor, queries


def corpus(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 2) for k in range(300)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 60)):
            w.append(r.choices(["of", "the", *vocabulary], [30, 30, *(100 * x for x in weights)])[0])
            if w[-1] == "of":
                w.append("the")  # a context that says a lot
        rows.append((i, " ".join(w) + r.choice(["", "\n", " Only" + str(i)])))
    return rows


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base(rows):
    count = Counter(w for i, t in rows if i is not None and not held(i) for w in pitman_yor.words(t))
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in rows:
        w = pitman_yor.words(t)
        out.setdefault(i, []).append((len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


def test_query_against_brute_force(spark, tmp_path):
    rows = corpus(1) + [(900, None), (901, ""), (902, "OF THE oF"), (903, "of the w1 " * 30_000), (904, "same text"), (904, "same text"), (None, "never learned Qx")]
    spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()
    want = base(rows)
    assert len(got) == len(rows)
    for x in got:
        a = want[x["doc_id"]][0]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held(x["doc_id"]), *a[:3])
        assert abs(x["base_score"] - a[3]) < 1e-6 * max(1, abs(a[3])) and x["score"] <= 0
    out = [x for x in got if x["held_out"]]
    n = sum(x["n_tokens"] for x in out)
    assert out and 10 ** (-sum(x["score"] for x in out) / n) < 10 ** (-sum(x["base_score"] for x in out) / n)


def test_probabilities_sum_to_one():
    """Root and a context over all known words and the unknown one, averaged or not."""
    r = np.random.default_rng(2)
    v = 400
    key = r.integers(1, 2**62, v)
    n = r.zipf(1.6, v).clip(1, 4000).astype(float)
    row = np.flatnonzero(r.random(v) < 0.5)
    inside = np.minimum(np.ceil(n[row] * r.random(len(row))), n[row])
    ctx = np.ones(len(row), np.int64)
    direct = n - np.bincount(row, inside, v)
    customers, tables = np.array([0, inside.sum()]), np.array([0, float(len(row))])
    model = pitman_yor.Restaurants(v, int(n.sum()), 0.6, 0.7, customers, tables, direct.sum() + len(row))
    t, c, _, _ = pitman_yor.sweep_words(key, row, ctx, inside, direct, model, 4, 1)
    assert (t >= 1).all() and (t <= inside).all()
    settled = pitman_yor.Restaurants(v, model.n, 0.6, 0.7, customers, np.array([0, t.sum()]), c.sum())
    root = settled.root_p(c)
    total = root.sum() + settled.unknown_p()
    assert abs(total - 1) < 0.02
    within = np.zeros(v)
    within[row] = (inside - 0.7 * t) / (1 + customers[1])
    assert abs((within + settled.backing()[1] * root).sum() + settled.backing()[1] * settled.unknown_p() - 1) < 0.02


def test_seating_follows_the_exact_law():
    """Mean number of tables against the chain of single decisions, below and above the block size."""
    for n, p in ((30, 0.02), (400, 0.002)):
        d, theta, others = 0.5, 1.0, 20.0
        size = 4000
        got = pitman_yor.reseat(np.full(size, float(n)), np.full(size, theta + d * others), d, np.full(size, p), np.arange(1, size + 1).astype(np.uint64) * pitman_yor.ODD).mean()
        law = {1: 1.0}
        for j in range(1, n):
            new = {}
            for t, q in law.items():
                a = (theta + d * (others + t)) * p
                share = a / (a + j - d * t)
                new[t] = new.get(t, 0) + q * (1 - share)
                new[t + 1] = new.get(t + 1, 0) + q * share
            law = new
        want = sum(t * q for t, q in law.items())
        assert abs(got - want) < 0.06 * want, (n, got, want)


def test_runs_repeat_and_empty_tables(spark):
    docs = spark.createDataFrame(corpus(3, 60), "doc_id long, text string")
    one, two = ({x["doc_id"]: x["score"] for x in pitman_yor.lm_score(docs, block_bytes=b).collect()} for b in (1 << 20, 2000))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-3 * max(1, abs(one[k])) for k in one)
    assert pitman_yor.lm_score(docs.where("false")).count() == 0
    alone = pitman_yor.lm_score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"], x["score"]) for x in alone] == [(3, 0, 0, 0.0)]


def test_every_word_is_a_context(spark):
    """400 words, each always before the same other word and none near 1 % of the tokens: the pairs are learned."""
    r = random.Random(6)
    rows = []
    for i in range(500):
        w = []
        for _ in range(40):
            k = r.randrange(400)
            w += [f"a{k}", f"b{k}"]
        rows.append((i, " ".join(w)))
    got = pitman_yor.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    out = [x for x in got if x["held_out"]]
    assert out
    # the second word of each pair is nearly certain, so about half of the unigram's digits remain
    assert sum(x["score"] for x in out) > 0.65 * sum(x["base_score"] for x in out)


def test_score_against_plain_seating(spark):
    """Each document's score against the same model sampled customer by customer, in plain loops over dictionaries."""
    rows = corpus(8, 250)
    got = {x["doc_id"]: x["score"] for x in pitman_yor.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    follow = {}
    for i, t in rows:
        if not held(i):
            w = pitman_yor.words(t)
            for a, b in zip([pitman_yor.END, *w], w, strict=False):
                follow.setdefault(a, Counter())[b] += 1
    total = Counter()
    for c in follow.values():
        total.update(c)
    v = len(total)
    counts = lambda x: (sum(k == 1 for k in x), sum(k == 2 for k in x))
    discount = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two)))
    d0, d1 = discount(*counts(total.values())), discount(*counts([k for c in follow.values() for k in c.values()]))
    r, theta, known = random.Random(4), 1.0, pitman_yor.KNOWN_SHARE
    tables = {a: dict.fromkeys(c, 1) for a, c in follow.items()}
    root = Counter()
    for t in tables.values():
        root.update(t)
    mass = theta + d0 * v

    def root_p(n):
        return (max(n - d0, 0) + mass * known / v) / (theta + sum(root.values()))

    def predict(a, b):
        p = root_p(root[b]) if b in root else mass * (1 - known) / (theta + sum(root.values()))
        c, t = follow.get(a, {}), tables.get(a, {})
        n = sum(c.values())
        return ((c[b] - d1 * t[b] if b in c else 0) + (theta + d1 * sum(t.values())) * p) / (theta + n)

    asked = {i: list(zip([pitman_yor.END, *pitman_yor.words(t)], pitman_yor.words(t), strict=False)) for i, t in rows}
    sums, kept = Counter(), 0
    for sweep in range(25):
        for a, c in follow.items():
            for b, n in c.items():
                root[b] -= tables[a][b]
                others = sum(tables[a].values()) - tables[a][b]
                p, seated = root_p(root[b] + 1), 1
                for j in range(1, n):
                    new = (theta + d1 * (others + seated)) * p
                    seated += r.random() < new / (new + j - d1 * seated)
                tables[a][b] = seated
                root[b] += seated
        if sweep >= 10:
            kept += 1
            for pair in {x for w in asked.values() for x in w}:
                sums[pair] += predict(*pair)
    off = []
    for i, pairs in asked.items():
        want = sum(math.log10(sums[x] / kept) for x in pairs)
        off.append(abs(got[i] - want) / abs(want))
    assert max(off) < 0.03 and sum(off) / len(off) < 0.006
