import random

import numpy as np
import pytest

from lattica.llm import html_text as H
from lattica.llm import queries


@pytest.fixture(scope="module")
def labeller():
    return H.train([])


def extracted(labeller, page):
    b = H.blocks(page)
    keep = labeller.label([H.Features().page(b, H.title_of(page))])[0]
    return "\n".join(t for (_, t, _), y in zip(b, keep, strict=True) if y)


def test_blocks():
    page = "<body><h1>A &amp; B&#33;</h1><p>one\n two<br>three <b>bold</b> <a href=x>link</a><p>next &lt;tag&gt;&nbsp;x<script>var a='<p>no</p>'</script><!-- <p>no --><ul><li>i<li>j</ul><style>p{}</style>tail"
    assert [t for _, t, _ in H.blocks(page)] == ["A & B!", "one two three bold link", "next <tag> x", "i", "j", "tail"]
    assert H.blocks(None) == H.blocks("") == H.blocks("<p></p> \n") == []
    assert [t for _, t, _ in H.blocks("a < b <3 <p>c<p d")] == ["a < b <3", "c<p d"]
    paths = [[tag for tag, _ in p] for p, _, _ in H.blocks("<div class='x y'><p>a<div>b</div>c</div>d")]
    assert paths == [["div", "p"], ["div", "div"], ["div"], []]


def test_gradients_by_differences():
    r = np.random.default_rng(1)
    m = H.Labeller(hidden=3)
    x, mask, y = H.together([r.normal(size=(4, H.WIDTH)).astype(np.float32), r.normal(size=(2, H.WIDTH)).astype(np.float32)], [np.array([1, 0, 1, 1]), np.array([0, 1])])
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    _, g = m.gradients(x.astype(np.float64), mask, y)
    for k in m.p:
        flat = m.p[k].reshape(-1)
        for i in r.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = m.gradients(x, mask, y)[0]
            flat[i] = old - 1e-3
            down = m.gradients(x, mask, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 2e-3, k


def test_accuracy_on_pages_it_has_not_seen(labeller):
    r = random.Random(99)
    words = "the of and zu mit haus maison agua under news daily".split()
    right = total = 0
    for _ in range(200):
        h = H.drawn_page(r, words)
        b = H.blocks(h)
        got = labeller.label([H.Features().page(b, H.title_of(h))])[0]
        right += (got == np.array(H.weak_labels(b))).sum()
        total += len(b)
    assert right / total > 0.985


def test_a_page_with_all_kinds_of_furniture(labeller):
    page = """<html><head><title>T</title><style>x</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies</p></div><article><h1>Title here</h1><p>First &quot;paragraph&quot; of the text, long enough to count.</p>
    <div class="ad">Buy now</div><p>Second <em>paragraph</em> goes on.</p><ul><li>a point made</li></ul></article>
    <section class="comments"><p>A reader says something</p></section><aside class="sidebar"><p>Elsewhere</p></aside><form><p>Your mail</p></form><footer>(c)</footer></body></html>"""
    assert extracted(labeller, page) == 'Title here\nFirst "paragraph" of the text, long enough to count.\nSecond paragraph goes on.\na point made'


def test_pages_of_like_and_unlike_length_do_not_mix(labeller):
    r = random.Random(5)
    found = [H.blocks(H.drawn_page(r, ["some", "words"])) for _ in range(40)] + [[]]
    vectors = [H.Features().page(b) for b in found]
    together = labeller.label(vectors, group=16)
    assert all((a == labeller.label([v])[0]).all() for a, v in zip(together, vectors, strict=True))


def test_query(spark, tmp_path):
    r = random.Random(8)
    pages = [H.drawn_page(r, "alpha beta gamma delta epsilon".split()) for _ in range(60)]
    rows = [(i, f"u{i}", p, "x") for i, p in enumerate(pages)] + [(100, None, None, "x"), (None, "u", "", "x"), (101, "same", pages[0], "x"), (101, "same", pages[0], "x"), (102, "long", "<article>" + "<p>many words in a block</p>" * 30_000 + "</article>", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op9_html_extraction"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(x["n_chars"] == len(x["text"]) for x in got)
    by = {x["page_id"]: x for x in got}
    assert by[100]["text"] == "" and by[None]["text"] == "" and by[101]["text"] == by[0]["text"]
    assert by[102]["text"] == "\n".join(["many words in a block"] * 30_000)
    want = {i: "\n".join(t for (_, t, _), y in zip(b, H.weak_labels(b), strict=True) if y) for i, b in enumerate(map(H.blocks, pages))}
    assert np.mean([by[i]["text"] == t for i, t in want.items()]) > 0.9
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract(none).count() == 0


def test_embedded_elements_hold_blocks_of_their_own():
    texts = lambda page: [t for _, t, _ in H.blocks(page)]
    assert texts('<article><p>a <svg class="i"/> b</p><p>c</p></article>') == ["a", "b", "c"]
    assert texts("<p>a<svg><title>no</title><g><path d='M0'/><text>label</text></svg>b</p>") == ["a", "label", "b"]
    for tag in ("object", "svg", "noscript"):
        assert texts(f"<div><p>a <{tag}><b>in<br>it</p><p>c</p></div>d") == ["a", "in it", "c", "d"]
    assert not any(H.weak_labels(H.blocks("<article><p>a</p></article><select><option>x</select>"))[1:])


def test_article_text_in_unusual_places(labeller):
    page = """<html><body><nav><ul><li><a href=/>Home page</a></ul></nav><article><header class="header"><h1>The head line</h1></header>
    <p class="search">Searching is what this paragraph of the article is about.</p><noscript><p>A table that readers without scripts see.</p></noscript>
    <p>Much more text follows here.</p><svg><text>axis of the figure</text></svg></article><div class="legal">Some Press. All rights reserved</div><footer>end</footer></body></html>"""
    assert extracted(labeller, page).split("\n") == ["The head line", "Searching is what this paragraph of the article is about.", "A table that readers without scripts see.", "Much more text follows here.", "axis of the figure"]


def test_labels_are_no_inputs():
    """Two paths that differ in nothing but a word of the label rules differ in hashed slots alone."""
    f = H.Features()
    one, two = (f.page([((("div", (w,)),), "text", 0.0)])[0] for w in ("cookie", "wording"))
    assert set(np.flatnonzero(one != two)) <= {H._slot("part:cookie", H.PATH), H._slot("part:wording", H.PATH)}


def test_scores_against_plain_loops():
    """The network read block by block and unit by unit, and the query's texts that follow from it."""
    import math

    r = np.random.default_rng(3)
    m = H.Labeller(hidden=4, seed=2)
    x = r.normal(size=(6, H.WIDTH)).astype(np.float32)
    want = [float(x[t] @ m.p["ox"] + m.p["o0"][0]) for t in range(6)]
    for d, order in (("f", range(6)), ("b", range(5, -1, -1))):
        s, c = [0.0] * 4, [0.0] * 4
        for t in order:
            a = [m.p["b" + d][k] + sum(x[t][j] * m.p["x" + d][j][k] for j in range(H.WIDTH)) + sum(s[j] * m.p["h" + d][j][k] for j in range(4)) for k in range(16)]
            gate = [1 / (1 + math.exp(-v)) for v in a[:12]]
            c = [gate[4 + u] * c[u] + gate[u] * math.tanh(a[12 + u]) for u in range(4)]
            s = [gate[8 + u] * math.tanh(c[u]) for u in range(4)]
            want[t] += sum(s[u] * m.p["o" + d][u] for u in range(4))
    got = m.scores(*H.together([x, x[:2]])[:2])[0]
    assert np.allclose(got, want, atol=1e-4)


def test_a_score_of_zero_is_no_article():
    m = H.Labeller(hidden=2)
    m.p = {k: np.zeros_like(v) for k, v in m.p.items()}
    assert not m.label([np.ones((3, H.WIDTH), np.float32)])[0].any()


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a ">"' * 100_001, "<!" * 500_000, "<script " * 100_000, "<div>a" * 100_000 + "</span>" * 50_000, "<b>" * 100_000 + "<p>x" * 30_000, "<p class='" * 100_000 + ">"])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    H.blocks(page)
    H.title_of(page)
    assert time.process_time() - began < 5


def test_titles():
    cases = {"<TITLE lang=en>A &amp; b\n c</title>": "a & b c", "<title>open": "open", "<title": "", "": "", "<p>none</p>": "", "<title <title>x<": "x", "<title>": ""}
    assert {page: H.title_of(page) for page in cases} == cases


def test_page_of_broken_titles_is_extracted(spark):
    page = "<title " * 150_000 + "<p>text of the page, long enough to be read</p>"
    (row,) = H.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert row["n_chars"] == len(row["text"])


def test_equal_pages_do_not_fill_the_sample(spark):
    pages = spark.createDataFrame([(f"<p>page {i}</p>",) for i in range(20)], "html string")
    first = pages.selectExpr("html", "xxhash64(html) AS k").orderBy("k").first()["html"]
    many = pages.union(spark.createDataFrame([(first,)] * 200, "html string"))
    assert sorted(H.sample_of(many, "html", 150, 1000)) == sorted(x["html"] for x in pages.collect())
