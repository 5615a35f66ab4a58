import random

import numpy as np
import pytest

from lattica.llm import minhash
from lattica.operators.components import components


def brute(rows, width, percent):
    sets, least = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    least = {i: i for i in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n=220):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = " ".join(r.choices(vocabulary, k=40))
    rows, seeds = [], []
    for i in range(n):
        x = r.random()
        if x < 0.3 and seeds:  # a near copy
            w = r.choice(seeds).split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((i, " ".join(w)))
        elif x < 0.45:
            rows.append((i, "The Hot copy of all texts is this one here"))
        elif x < 0.6:  # one common passage
            rows.append((i, common + " " + " ".join(r.choices(vocabulary, k=r.randint(10, 60)))))
        elif x < 0.7:
            rows.append((i, r.choice([None, "", " \n", "one", "One", "two words", "two  WORDS", "a b c d"])))
        else:
            seeds.append(" ".join(r.choices(vocabulary, k=r.randint(30, 150))))
            rows.append((i, seeds[-1]))
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_against_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, rep string").repartition(3)
    got = {tuple(x) for x in minhash.near_duplicates(docs, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_links_within_crowds_that_share_a_passage(spark):
    """Many documents share most of their text without being near copies; the few pairs among them are found."""
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = r.choices(vocabulary, k=90)
    rows = []
    for i in range(0, 360, 2):
        own = passage + r.choices(vocabulary, k=50)
        near = list(own)
        if i % 12 == 0:
            near[-r.randint(1, 9)] = "changed"
        else:
            near[-50:] = r.choices(vocabulary, k=50)
        rows += [(i, " ".join(own)), (i + 1, " ".join(near))]
    want = brute(rows, 5, 80)
    assert sum(not x[3] for x in want) == 30
    got = {tuple(x) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b C d e\nf"), (3, "x " * 60_000)], "doc_id long, text string")
    got = sorted((tuple(x) for x in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True)], key=str)
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    assert sorted((x["doc_id"] for x in minhash.keep_least(docs).collect()), key=str) == [1, 1, 3, None, None]


def test_densified_bins_agree_as_often_as_sets_do():
    r, look = np.random.default_rng(5), minhash.donors()
    for size in (12, 150, 3000):
        share = []
        for _ in range(40):
            both, a, b = (r.integers(0, 2**63, k, dtype=np.uint64) for k in (size * 8 // 10, size // 10, size // 10))
            one, two = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
            share.append((minhash.signature(one, look) == minhash.signature(two, look)).mean())
        assert abs(np.mean(share) - 0.8) < 0.05


def test_bands_miss_rarely():
    for percent in (80, 85, 95):
        r = minhash.height(percent)
        assert (1 - (percent / 100) ** r) ** (minhash.BINS // r) < 1e-5


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(10, 60)] + [(70, 71), (71, 72), (72, 70), (3, 3), (70, 71)]
    got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {k: 5 for k in [5, *range(10, 60)]} | {70: 70, 71: 70, 72: 70}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("stars", [0, 3])
def test_links_that_no_hub_meets(spark, stars):
    """A crowd with 180 of 200 shingles in common (0.818), and planted pairs at 184 of 216 (0.852)."""
    common = [f"c{k}" for k in range(180)]
    own = {i: [f"o{i}x{k}" for k in range(20)] for i in range(120)}
    for i in range(0, 40, 2):
        own[i + 1][:4] = own[i][:4]
    docs = spark.createDataFrame([(i, " ".join(common + w)) for i, w in own.items()], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs, width=1, percent=85, stars=stars).collect()}
    assert got == {i: i - i % 2 if i < 40 else i for i in own}


def test_pages_of_one_template(spark):
    """100 slots of six words, 30 of them with two variants: nearly all pairs are alike, few are linked."""
    r = random.Random(17)
    slots = [[" ".join(f"s{k}v{v}w{w}" for w in range(6)) for v in range(2)] for k in range(100)]
    rows = [(i, " ".join(slots[k][r.random() < 0.5 if k < 30 else 0] for k in range(100))) for i in range(150)]
    got = {tuple(x) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_a_star_makes_one_row_a_member(spark):
    rows = spark.createDataFrame([(n, 10, k, n % 3) for k in range(4) for n in range(10 * k, 10 * k + 5 * k + 2)], "node long, n long, key long, comp long")
    got = [tuple(x) for x in minhash.star(rows, 85, 1).collect()]
    assert 0 < len(got) <= rows.count() and all(u > v and u % 3 != v % 3 for u, v in got)


def test_prefix_pairs_miss_nothing(spark):
    r = random.Random(3)
    made = {}
    for i in range(150):
        near = list(made[r.randrange(i)]) if i and i % 2 else r.sample(range(300), 80)
        made[i] = set(r.sample(near, len(near) - r.randint(0, min(8, len(near) - 1)))) | set(r.sample(range(300), r.randint(0, 6)))
    sets = spark.createDataFrame([(i, sorted(m)) for i, m in made.items()], "node long, members array<long>")
    nodes = spark.createDataFrame([(i, i) for i in made], "node long, comp long")
    got = {tuple(x) for x in minhash.confirm(minhash.prefix_pairs(nodes, sets, 80), sets, 80).collect()}
    want = {(a, b) for a in made for b in made if a > b and 100 * len(made[a] & made[b]) >= 80 * len(made[a] | made[b])}
    assert got == want and len(want) > 30
