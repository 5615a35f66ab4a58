r"""Secret scans through a trigram inverted index; built-in functions only.

Each rule is a regular expression. From it a Boolean query over trigrams is derived: which three-character strings a text
must hold, all of a clause, of one clause at least, for the rule to match at all (`trigram_query`). The index has a row for
each distinct trigram of a text that some rule asks for, in lower case. Postings are intersected by a join with the clauses
and a count: a text is a candidate of a rule if it has all trigrams of a clause. Candidates alone are verified by the
expression itself. Rules without a mandatory trigram, such as runs of hexadecimal digits, scan every text.

A posting names its text by a hash of identifier and text. Texts with equal hashes share their postings, which can make
candidates only; what verification finds decides.

Places of matches are code points: a text is split at its matches, and the lengths of gaps and matches are summed up, in
blocks of 256 matches and then over blocks, so that the work grows with the text, not with the square of its matches.

Rules: matches are leftmost and do not overlap; of them those count whose group has the least length. `BASE` are password-
like assignments, access keys and runs of hexadecimal digits; `MORE` finds keys of known services, private keys, tokens of
three parts and addresses with a password.

Skew: postings of a text are grouped by that text, and at most one row for each trigram asked for; no list of a trigram is
ever gathered. Texts meet candidates by their own hash.

Defined results:
    null text               as an empty text: no spans
    very long texts         whole
    null identifier         scanned like any other
    ties (equal starts)     by the order of rules, then by the end
    repeated rows           each has the same spans
    empty table             empty result
    further columns         ignored
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product
from re import _constants as C
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(words: str) -> str:
    """A pattern for letters in either case, ASCII only in every dialect."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


BASE = (
    Rule("assign", rf"""({either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run shorter than its least length holds no longer one, so the length may as well stand in the pattern
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"),
    Rule("forge", "(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,255})"),
    Rule("chat", "xox[abeoprs]-[A-Za-z0-9-]{10,255}"),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,255}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~-]{1,64}:[^\s:@/]{3,128}@"),
)
RULES = BASE + MORE

# ---- trigram queries ----

MANY = 16  # strings or clauses beyond which a set is given up, which only makes queries weaker
Query = frozenset | None  # clauses (sets of trigrams), one of which must hold; None: any text may match


def _grams(words: Iterable[str]) -> Query:
    """One of the words must stand in the text."""
    clauses = frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words)
    return None if any(not c for c in clauses) else clauses


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = frozenset(x | y for x, y in product(a, b))
    return both if len(both) <= MANY * MANY else min(a, b, key=len)


def _or(a: Query, b: Query) -> Query:
    return None if a is None or b is None or len(a | b) > MANY * MANY else a | b


class Part(NamedTuple):
    """What is known of a piece of an expression: all strings it matches (exact, or None), and what a text must hold."""

    exact: frozenset[str] | None
    must: Query


ANY = Part(None, None)


def _one_of(codes) -> Part:
    low = frozenset(chr(c).lower() for c in codes)
    return Part(low, None) if low and len(low) <= MANY and all(len(x) == 1 for x in low) else ANY


def _sequence(parts: list[Part]) -> Part:
    """Pieces behind one another: exact ones grow together; where that ends, what they must hold is noted."""
    whole: frozenset[str] | None = frozenset([""])
    run, must = frozenset([""]), None
    for p in parts:
        grown = None if p.exact is None else frozenset(a + b for a, b in product(run, p.exact))
        if grown is not None and len(grown) <= MANY:
            run = grown
            whole = frozenset(a + b for a, b in product(whole, p.exact)) if whole is not None and len(whole) * len(p.exact) <= MANY else None
            continue
        must, whole = _and(_and(must, _grams(run)), p.must), None
        run = frozenset([""]) if p.exact is None else p.exact
    return Part(whole, must if whole is not None else _and(must, _grams(run)))


def _part(op, arg) -> Part:
    if op is C.LITERAL:
        return _one_of([arg])
    if op is C.IN:
        codes: set[int] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                codes.add(x)
            elif kind is C.RANGE and x[1] - x[0] < 2 * MANY:
                codes.update(range(x[0], x[1] + 1))
            else:
                return ANY
        return _one_of(codes)
    if op is C.SUBPATTERN:
        return _parts(arg[-1])
    if op is C.BRANCH:
        found = [_parts(x) for x in arg[1]]
        exact = None if any(p.exact is None for p in found) else frozenset().union(*(p.exact for p in found))
        must = _must(found[0])
        for p in found[1:]:
            must = _or(must, _must(p))
        return Part(exact if exact is not None and len(exact) <= MANY else None, must)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = arg
        p = _parts(inner)
        if (least, most) == (0, 1) and p.exact is not None and len(p.exact) < MANY:
            return Part(p.exact | {""}, None)
        if least == most <= 8:
            return _sequence([p] * least)
        return Part(None, _must(_sequence([p] * min(least, 3)))) if least else ANY
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return Part(frozenset([""]), None)
    return ANY


def _parts(tree) -> Part:
    return _sequence([_part(op, arg) for op, arg in tree])


def _must(p: Part) -> Query:
    return _and(p.must, None if p.exact is None else _grams(p.exact))


def trigram_query(pattern: str) -> Query:
    """Clauses of trigrams in lower case, one of which every text holds that the pattern matches; None if there are none.

    A clause that holds another one whole is left out. A letter counts in both cases, so the query is never too strict."""
    found = _must(_parts(_parser.parse(pattern)))
    if found is None:
        return None
    return frozenset(c for c in found if not any(d < c for d in found))


# ---- index, candidates ----


def _any_of(trigrams: list[str]) -> str:
    """A pattern for one of the trigrams, by their first character, so that most places are left at once."""
    quoted = lambda x: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" if ord(c) < 256 else c for c in x)
    by_first: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        by_first.setdefault(t[0], []).append(t[1:])
    return "|".join(f"{quoted(a)}(?:{'|'.join(map(quoted, rest))})" for a, rest in by_first.items())


def index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """texts: key, text. The postings: trigram, key, one row for each of the trigrams (lower case) that a text holds."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({_any_of(trigrams)}))"), F.lit(1)))
    return texts.select("key", F.explode(held).alias("trigram")).select("trigram", "key")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key, kinds: the rules of which a text has all trigrams of a clause."""
    rows = [(kind, n, t, len(clause)) for kind, q in sorted(queries.items()) for n, clause in enumerate(sorted(map(sorted, q or ()))) for t in clause]
    clauses = postings.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, need long")
    met = postings.join(F.broadcast(clauses), "trigram")  # as many rows as the rules' clauses have trigrams
    whole = met.groupBy("key", "kind", "clause", "need").agg(F.count_distinct("trigram").alias("have")).where("have = need")
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


# ---- verification ----

BLOCK = 256


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """Matches of a rule as array of (start, rule's place, end), in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    row = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("found"), value.alias("value"))
    sizes = F.transform(F.filter(row, lambda x: x["found"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("n"), (F.length(x["value"]) >= rule.least).alias("counts")))
    return F.when(F.rlike(text, pattern), sizes).otherwise(F.array().cast("array<struct<gap:int,n:int,counts:boolean>>"))


def _placed(sizes: Column, at: int) -> Column:
    """sizes (gap, n, counts) as spans (start, rule, end) of those that count: sums within blocks, then over blocks."""
    n = F.size(sizes)
    empty = F.array().cast("array<struct<start:int,end:int,counts:boolean>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def one(acc: Column, i: Column) -> Column:
        x = F.element_at(sizes, i)
        begin = acc["at"] + x["gap"]
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["counts"].alias("counts")))).alias("spans"))

    def block(b: Column) -> Column:
        return F.aggregate(F.sequence(b * BLOCK + 1, F.least(n, (b + 1) * BLOCK)), start, one)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,counts:boolean>>>").alias("done"))

    def shift(acc: Column, b: Column) -> Column:
        moved = F.transform(b["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["counts"].alias("counts")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["done"], F.array(moved)).alias("done"))

    every = F.flatten(F.aggregate(blocks, none, shift)["done"])
    kept = F.transform(F.filter(every, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("rule"), s["end"].alias("end")))
    return F.when(n > 0, kept).otherwise(F.array().cast("array<struct<start:int,rule:int,end:int>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row: doc_id, spans: array of (start, rule, end), by start, the rule's place in `rules`, end."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = sorted({t for q in queries.values() if q for clause in q for t in clause})
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    hits = materialise(candidates(index(texts, asked), queries)) if asked else None
    met = texts.withColumn("kinds", F.array().cast("array<string>")) if hits is None else texts.join(hits, "key", "left")
    sized = met
    for i, r in enumerate(rules):
        none = F.array().cast("array<struct<gap:int,n:int,counts:boolean>>")
        every = _spans(F.col("text"), r, i)
        sized = sized.withColumn(f"s{i}", every if queries[r.kind] is None else F.when(F.array_contains("kinds", r.kind), every).otherwise(none))
    placed = sized.select("doc_id", *(_placed(F.col(f"s{i}"), i).alias(f"s{i}") for i in range(len(rules))))
    return placed.select("doc_id", F.sort_array(F.concat(*(F.col(f"s{i}") for i in range(len(rules))))).alias("spans"))


def labels(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
