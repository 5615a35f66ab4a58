"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf text blocks (text between block-level tags). Each block is a vector: its tag path with class,
id and role tokens hashed, its words hashed, and a few numbers (length, link share, signs of a legal line, likeness to
the page's title, place in the page). A bidirectional LSTM in numpy reads a page's whole sequence of blocks and labels
each one as article or not.

The labeller is trained here, on a bounded sample (`sample_pages`, whole pages) and on pages drawn from a small
grammar of page furniture. Training labels come from rules that the network never sees as inputs (`weak_labels`): inside
an article container and under no furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments), but
for headlines in an article's own header; no legal lines; where no container marks the article, no text that several
unlike sample pages repeat.
Labelling itself uses the network alone.

Cutting a page takes time in proportion to its length, however broken it is. Of paths over 64 elements deep the outer
and the inner half of 64 count.

Defined results:
    null html, no blocks     empty text, 0 characters
    very long pages          whole; the sequence is read to its end
    broken markup            stray tags and signs are text or skipped, never an exception
    ties (score of 0)        not article
    repeated rows            each on its own, equal html gives equal text
    empty table              empty result; the labeller then learns from drawn pages alone
    further columns          ignored
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTED = r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+"
RAW = "script|style|template|title|textarea|iframe|desc"


def _tokens(attributes: str, last: str) -> re.Pattern:
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        rf"|<({RAW})(?=[\s/>]){attributes}>.*?(?:</\1\s*>|\Z)"
        r"|<[!?][^>]*+>"
        rf"|<(/?)([a-zA-Z][^\s/>]*+)({attributes})>"
        rf"|<(/?)([a-zA-Z][^\s/>]*+){last}>"
        r"|[^<]++|<",
        re.S | re.I,
    )


#: With quotes read as in HTML; without, for pages whose quotes do not close.
TOKEN, PLAIN = _tokens(QUOTED, "([^>]*+)"), _tokens("[^>]*+", "([^>]*+)")
UNCLOSED = 32  # tags whose quotes run to the page's end, each found by reading to there; from then on quotes are no quotes
ATTR = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Furniture by tag, and by the words of class, id and role: on any element, or on those that hold whole parts of a page.
OFF_TAGS = frozenset("nav header footer aside form button menu dialog head select".split())
OFF_WORDS = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo nav navbar breadcrumb breadcrumbs footer sidebar cookie cookies consent newsletter subscribe signup comment comments reply replies disqus share sharing social popup modal overlay toolbar copyright complementary contentinfo".split())
PART_WORDS = frozenset("banner navigation menu header masthead aside widget related recommended notice alert login form search pagination pager dialog legal".split())
EVERY_OFF = sorted(OFF_WORDS | PART_WORDS)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split()) | INLINE
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
LEGAL = re.compile(r"\s*(?:\u00a9|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I | re.S)
DEPTH = 64
ON_TAGS = frozenset("article main".split())
ON_WORDS = frozenset("article post entry story".split())
PATH, WORDS, NUMBERS = 320, 24, 8
WIDTH = PATH + WORDS + NUMBERS


def _pieces(page: str):
    """Matches of TOKEN; behind the last > there are no tags, only text and an open comment."""
    end = page.rfind(">") + 1
    pattern, at, broken = TOKEN, 0, 0
    while at < end:
        m = pattern.match(page, at, end)
        if m[6] and pattern is TOKEN:
            broken += 1
            pattern = PLAIN if broken > UNCLOSED else TOKEN
        yield m
        at = m.end()
    open_comment = page.find("<!--", end)
    tail = page[end : open_comment if open_comment >= 0 else len(page)]
    if tail:
        yield re.match(r"(?s).*()()()()()()()", tail)


def title_of(page: str) -> str:
    """The text of the title element, in lower case. Its tag ends with the first > behind it, which is looked for once."""
    m = re.search(r"<title\b", page, re.I)
    end = page.find(">", m.end()) if m else -1
    if end < 0:
        return ""
    last = page.find("<", end)
    return " ".join(entities.unescape(page[end + 1 : last if last >= 0 else len(page)]).lower().split())


def blocks(page: str | None) -> list[tuple[tuple, str, float]]:
    """(path, text, share of the text within links) of each leaf block; path holds (tag, words) from the root down."""
    out: list[tuple[tuple, str, float]] = []
    stack: list[tuple[str, tuple]] = []
    opened: Counter = Counter()
    text: list[str] = []
    linked = links = 0
    where: tuple = ()

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((where, joined, min(1.0, linked / len(joined))))
            text.clear()
            linked = 0

    def close(k: int) -> None:
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    for m in _pieces(page or ""):
        tag = m[3] or m[6]
        if not tag:
            s = m[0]
            if s[0] != "<" or s == "<" or m[7] == "":
                if not text:
                    if s.isspace():
                        continue
                    where = tuple(stack) if len(stack) <= DEPTH else (*stack[: DEPTH // 2], *stack[-DEPTH // 2 :])
                s = entities.unescape(s) if "&" in s else s
                text.append(s)
                linked += len(s) * (links > 0)
            elif m[1] and m[1].lower() not in ("script", "style", "template"):
                flush()
            continue
        tag, closing = tag.lower(), m[2] or m[5]
        inline = tag in INLINE
        if tag == "a":
            links = 0 if closing else 1
        if not inline:
            flush()
        elif tag == "br":
            text.append(" ") if text else None
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in VOID:
            continue
        shut = CLOSES.get(tag) or (ENDS_P_SHUT if tag in ENDS_P else None)
        if shut:
            k = len(stack)
            while k and stack[k - 1][0] in INLINE and len(stack) - k < DEPTH:
                k -= 1
            if k and stack[k - 1][0] in shut:
                close(k - 1)
        rest = m[4] if m[3] else m[7]
        if rest and rest.rstrip().endswith("/"):
            if opened["svg"] or tag == "svg":  # an element without content
                continue
            rest = rest.rstrip()[:-1]
        words = tuple(w for a in ATTR.finditer(rest) for w in WORD.findall((a[2] or a[3] or a[4] or "").lower())) if rest and "=" in rest else ()
        stack.append((tag, words[:DEPTH]))
        opened[tag] += 1
    flush()
    return out


ENDS_P_SHUT = frozenset({"p"})


def weak_label(path: tuple, has_article: bool) -> bool:
    """By path alone."""
    inside = False
    headline = any(tag in HEADLINES for tag, _ in path)
    for tag, words in path:
        if tag in OFF_TAGS and not (tag == "header" and inside and headline):
            return False
        if any(w in OFF_WORDS or (w in PART_WORDS and tag not in LEAVES) for w in words) and not (tag == "header" and inside and headline and not any(w in OFF_WORDS for w in words)):
            return False
        inside = inside or tag in ON_TAGS or any(w in ON_WORDS for w in words)
    return inside or not has_article


def weak_labels(found: list, repeated: frozenset = frozenset()) -> list[bool]:
    """Of a page's blocks. repeated: texts that stand in several pages; where nothing marks the article, they are furniture."""
    inside = [not LEGAL.match(text) and weak_label(path, True) for path, text, _ in found]
    return inside if any(inside) else [not LEGAL.match(text) and text not in repeated and weak_label(path, False) for path, text, _ in found]


def repeats(pages: list[list], least: int = 3) -> frozenset:
    """Texts of at least `least` pages whose longest blocks differ."""
    seen: dict[str, set] = {}
    for found in pages:
        longest = max((text for _, text, _ in found), key=len, default="")
        for text in {text for _, text, _ in found}:
            if text != longest:
                seen.setdefault(text, set()).add(longest)
    return frozenset(text for text, of in seen.items() if len(of) >= least)


def _slot(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % n


class Features:
    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            v = np.zeros(PATH, np.float32)
            for tag, words in path:
                v[_slot("t:" + tag, PATH)] += 1
                for w in words:
                    v[_slot(("leaf:" if tag in LEAVES else "part:") + w, PATH)] += 1
            for k, (tag, _) in enumerate(path[:-4:-1]):
                v[_slot(f"{k}:{tag}", PATH)] += 1
            v = np.minimum(v, 2)
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[path] = v
        return v

    def word(self, w: str) -> int:
        k = self.words.get(w)
        if k is None:
            if len(self.words) > 200_000:
                self.words.clear()
            k = self.words[w] = _slot(w, WORDS)
        return k

    def page(self, found: list, title: str = "") -> np.ndarray:
        x = np.zeros((len(found), WIDTH), np.float32)
        for i, (path, text, linked) in enumerate(found):
            x[i, :PATH] = self.path(path)
            low = text.lower()
            slots = [self.word(w) for w in low.split()]
            x[i, PATH : PATH + WORDS] = np.bincount(slots, minlength=WORDS) / len(slots)
            x[i, PATH + WORDS :] = (np.log1p(len(text)) / 8, linked, len(path) / 10, i / len(found), min(i, 10) / 10, min(len(found) - 1 - i, 10) / 10, LEGAL.match(text) is not None, low == title)
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output on both states and the block itself."""

    def __init__(self, hidden: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.08, (WIDTH, 4 * hidden)).astype(np.float32)
            self.p["h" + d] = r.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p["b" + d] = bias
            self.p["o" + d] = r.normal(0, 0.2, hidden).astype(np.float32)
        self.p["ox"] = np.zeros(WIDTH, np.float32)
        self.p["o0"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: pages x blocks x WIDTH. States of one direction, and what backpropagation needs."""
        n, steps, h = x.shape[0], x.shape[1], self.h
        gates = x @ self.p["x" + d] + self.p["b" + d]
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        states, trail = np.zeros((n, steps, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = gates[:, t] + s @ self.p["h" + d]
            i, f, o = (_sigmoid(a[:, k * h : (k + 1) * h]) for k in range(3))
            g = np.tanh(a[:, 3 * h :])
            m = mask[:, t, None]
            new = (f * c + i * g) * m + c * (1 - m)
            tc = np.tanh(new)
            out = o * tc * m + s * (1 - m)
            if keep:
                trail.append((t, s, c, i, f, o, g, tc, m))
            s, c = out, new
            states[:, t] = out
        return states, trail

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._run(x, mask, "f", False)[0] @ self.p["of"] + self._run(x, mask, "b", False)[0] @ self.p["ob"] + x @ self.p["ox"] + self.p["o0"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        z = runs["f"][0] @ self.p["of"] + runs["b"][0] @ self.p["ob"] + x @ self.p["ox"] + self.p["o0"]
        q = _sigmoid(z)
        loss = float(-(mask * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum() / mask.sum())
        dz = (q - y) * mask / mask.sum()
        g = {"ox": np.einsum("nt,ntw->w", dz, x), "o0": dz.sum(keepdims=True).reshape(1)}
        h = self.h
        for d in "fb":
            states, trail = runs[d]
            g["o" + d] = np.einsum("nt,nth->h", dz, states)
            gates = np.zeros((*x.shape[:2], 4 * h), np.float32)
            ds, dc = np.zeros((x.shape[0], h), np.float32), np.zeros((x.shape[0], h), np.float32)
            gh = np.zeros_like(self.p["h" + d])
            for t, s, c, i, f, o, gg, tc, m in reversed(trail):
                ds = ds + dz[:, t, None] * self.p["o" + d]
                dn = dc * m + ds * m * o * (1 - tc * tc)
                a = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), ds * m * tc * o * (1 - o), dn * i * (1 - gg * gg)], 1)
                gates[:, t] = a
                gh += s.T @ a
                ds, dc = a @ self.p["h" + d].T + ds * (1 - m), dn * f + dc * (1 - m)
            g["h" + d] = gh
            g["x" + d] = np.einsum("ntw,ntg->wg", x, gates, optimize=True)
            g["b" + d] = gates.sum((0, 1))
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 32, rate: float = 0.02, longest: int = 96, seed: int = 7) -> float:
        """Adam on windows of at most `longest` blocks."""
        parts = [(x[k : k + longest], y[k : k + longest]) for x, y in pages for k in range(0, len(x), longest)]
        r = np.random.default_rng(seed)
        first, second, step, loss = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, 0.0
        for epoch in range(epochs):
            for rows in np.array_split(r.permutation(len(parts)), max(1, len(parts) // batch)):
                x, mask, y = together([parts[k][0] for k in rows], [parts[k][1] for k in rows])
                loss, g = self.gradients(x, mask, y)
                step += 1
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] -= (rate / (1 + epoch / 4) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss

    def label(self, pages: list[np.ndarray], group: int = 128) -> list[np.ndarray]:
        """Per page, whether each block is article. Pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, k = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i])), 0
        while k < len(order):
            rows = order[k : k + group]
            while len(rows) > 1 and len(rows) * len(pages[rows[-1]]) > 20_000:
                rows = rows[: len(rows) // 2]
            k += len(rows)
            x, mask, _ = together([pages[i] for i in rows])
            z = self.scores(x, mask)
            for j, i in enumerate(rows):
                out[i] = z[j, : len(pages[i])] > 0
        return out


def together(xs: list[np.ndarray], ys: list[np.ndarray] | None = None):
    n = max(len(x) for x in xs)
    x, mask, y = np.zeros((len(xs), n, WIDTH), np.float32), np.zeros((len(xs), n), np.float32), np.zeros((len(xs), n), np.float32)
    for i, v in enumerate(xs):
        x[i, : len(v)], mask[i, : len(v)] = v, 1
        if ys is not None:
            y[i, : len(v)] = ys[i]
    return x, mask, y


def drawn_page(r: random.Random, words: list[str]) -> str:
    """A page of the grammar, filled with given words."""

    def say(a: int, b: int) -> str:
        return " ".join(r.choice(words) for _ in range(r.randint(a, b)))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def p(a: int = 8, b: int = 50) -> str:
        return f"<p>{say(a, b)}</p>" if r.random() < 0.8 else f"<p><b>{say(2, 5)}<br>{say(a, b)}"

    def off() -> str:
        word = r.choice(EVERY_OFF)
        inner = r.choice([lambda: say(2, 30), lambda: p(3, 20), lambda: links(r.randint(2, 6)), lambda: f"<h3>{say(1, 3)}</h3>" + p(3, 25), lambda: f"<div><p>{say(5, 40)}</p></div>"])()
        if r.random() < 0.45:
            tag = r.choice(["nav", "header", "footer", "aside", "form", "dialog", "menu"])
            return f"<{tag}>{inner}</{tag}>"
        tag = r.choice(["div", "section", "ul", "div", "p" if word in OFF_WORDS else "div"])
        inner = say(2, 30) if tag == "p" else inner  # a block element would end it
        name = r.choice([word, f"{word}-{r.choice(['box', 'top', 'inner', 'list', '1'])}", f"site-{word}", f"{word} wide"])
        return f'<{tag} {r.choice(["class", "id", "class", "role"])}="{name}">{inner}</{tag}>'

    def odd() -> str:
        """Article text in elements or under names that elsewhere are no article."""
        word = r.choice(sorted(PART_WORDS))
        return r.choice([lambda: f'<p class="{word}">{say(4, 30)}</p>', lambda: f"<noscript>{p()}</noscript>", lambda: f"<svg><text>{say(1, 5)}</text></svg>", lambda: f"<object><p>{say(3, 12)}</p></object>", lambda: f'<h2 id="{word}">{say(2, 6)}</h2>'])()

    def on() -> str:
        return r.choice([p, p, p, p, odd, lambda: f"<h2>{say(2, 8)}</h2>", lambda: "<ul>" + "".join(f"<li>{say(3, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", lambda: f"<blockquote>{p(5, 25)}</blockquote>", lambda: f"<pre>{say(5, 20)}</pre>", lambda: f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>", lambda: f"<figure><img src=x><figcaption>{say(3, 10)}</figcaption></figure>", lambda: f"<div>{say(5, 30)} <a href=x>{say(1, 3)}</a> {say(3, 9)}</div>", lambda: f"<h3>{say(2, 6)}</h3>"])()

    title = say(3, 10)
    head = r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1><p>{say(2, 6)}</p></header>", f'<header class="header"><h1>{title}</h1></header>'])
    body = head + "".join(on() if r.random() < 0.85 else off() for _ in range(r.randint(2, 14)))
    opening = r.choice(["<article>", "<article>", "<main>", "<main><article>", '<div class="post">', '<div id="content"><article>', '<div class="article-body">', '<section class="entry">', "<div>"])
    closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
    before, after = "".join(off() for _ in range(r.randint(0, 4))), "".join(off() for _ in range(r.randint(0, 4)))
    if r.random() < 0.5:
        before = f"<nav>{links(r.randint(2, 8))}</nav>" + before
    if r.random() < 0.5:
        after += f"<footer>{say(2, 12)}</footer>"
    if r.random() < 0.3 and opening != "<div>":
        before += f"<div>{say(2, 9)}</div>"
    if r.random() < 0.3:
        legal = r.choice(["&copy;", "(c)", "Copyright"]) + f" {say(1, 6)}"
        legal = r.choice([legal, f"{legal}. All rights reserved.", f"{say(1, 3)} All rights reserved"])
        line = r.choice([f"<div>{legal}</div>", f"<p>{legal}</p>", f'<div class="legal">{legal}</div>', f'<p class="small">{legal}</p>'])
        body, after = (body + line, after) if r.random() < 0.3 else (body, after + line)
    return f"<html><head><title>{r.choice([title, say(2, 6)])}</title></head><body>{before}{opening}{body}{closing}{after}</body></html>"


def train(sample: list[str], drawn: int = 1000, seed: int = 7) -> Labeller:
    """A labeller from sample pages and drawn ones."""
    r, features = random.Random(seed), Features()
    own = [(blocks(h), title_of(h)) for h in sample]
    words = [w for b, _ in own[:200] for _, text, _ in b for w in text.split()[:30]][:20_000] or ["word", "text", "of", "the"]
    again = repeats([b for b, _ in own])
    made = [(blocks(h), title_of(h)) for h in (drawn_page(r, words) for _ in range(drawn))]
    rows = [(b, t, weak_labels(b, again)) for b, t in own] + [(b, t, weak_labels(b)) for b, t in made]
    model = Labeller(seed=seed)
    model.fit([(features.page(b, t), np.array(y, np.float32)) for b, t, y in rows if b])
    return model


def sample_of(pages: DataFrame, html_col: str, sample_pages: int, sample_chars: int) -> list[str]:
    """At most sample_pages pages of at most sample_chars characters, picked by a hash of their html."""
    small = pages.where(F.length(html_col) <= sample_chars).select(F.col(html_col).alias("h"), F.xxhash64(html_col).alias("k"))
    picked = small.select("k").distinct().orderBy("k").limit(sample_pages)
    return [row[0] for row in small.join(F.broadcast(picked), "k", "left_semi").dropDuplicates(["k"]).select("h").limit(sample_pages).collect()]


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", sample_pages: int = 150, sample_chars: int = 60_000, model: Labeller | None = None) -> DataFrame:
    """id columns, text, n_chars. The sample (at most sample_pages x sample_chars characters) is fitted on the driver."""
    labeller = model or train(sample_of(pages, html_col, sample_pages, sample_chars))

    def run(batches):
        features = Features()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                html = [x.as_py() or "" for x in part.column(part.num_columns - 1)]
                found = [blocks(h) for h in html]
                keep = labeller.label([features.page(b, title_of(h)) for b, h in zip(found, html, strict=True)])
                texts = ["\n".join(text for (_, text, _), on in zip(b, y, strict=True) if on) for b, y in zip(found, keep, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(id_cols))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*id_cols, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(*id_cols, html_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in id_cols), "text string", "n_chars long"]))
