import random
import re

import pytest

from lattica.llm import secrets

PLAIN = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def brute(text, rules=secrets.RULES):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(PLAIN.get(r.kind, r.pattern), text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def corpus(seed=3):
    r = random.Random(seed)
    key = "AKIA" + "".join(r.choices("ABCDEFGHIJ0123456789", k=16))
    pieces = [
        "password = 'hunter22'", 'Secret:"abcdef"', "token=token:abcdefgh", "TOKEN==abc123", "api_key: 12345", "APIKEY=\"zz-zz_zz.zz\"", "passwd  =  longenough", "pass word=nothing", key, key[:19], "AKIAAKIA12", "a" * 23, "b" * 24, "deadbeef" * 6, "DEADBEEF" * 6,
        "ghp_" + "x1" * 18, "github_pat_" + "A" * 22, "glpat-" + "b" * 20, "xoxb-1234567890-abc", "AIza" + "Q" * 35, "sk_live_" + "9" * 16, "rk_test_" + "8" * 15, "eyJhbGciOiJ.eyJzdWIiOiIx.c2lnbmF0dXJl", "postgres://user:pass@host/db", "http://example.org:80/x",
        "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "日本語 é \U0001f600", "plain words here", "\n", "Key toKen=abcdefg",
    ]
    return [" ".join(r.choices(pieces, k=r.randint(0, 12))) for _ in range(150)] + pieces


def test_against_finditer(spark):
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "secret=abcdef"), (None, "secret=abcdef"), (7, None), (8, ""), (7, "token: abcdefghi")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kinds string").repartition(5)
    got = sorted(((r[0], [tuple(s) for s in r[1]]) for r in secrets.scan(docs).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t in rows), key=str)
    assert {k for _, s in got for _, k, _ in s} == set(range(len(secrets.RULES)))


def test_many_matches_in_one_text(spark):
    text = " é ".join(f"token=abcdef{k % 7}" for k in range(3000))
    (row,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(s) for s in row[1]] == brute(text)


def test_empty_table_and_rules_without_trigrams(spark):
    docs = spark.createDataFrame([(1, "a1b2")], "doc_id long, text string")
    assert secrets.scan(docs.where("false")).count() == 0
    rules = (secrets.Rule("digits", "[0-9]+"),)
    assert [tuple(s) for s in secrets.scan(docs, rules=rules).first()[1]] == [(1, 0, 2), (3, 0, 4)]


@pytest.mark.parametrize(
    ("pattern", "clauses"),
    [
        ("abcd", [{"abc", "bcd"}]),
        ("[0-9a-f]+", None),
        ("ab", None),
        ("abc|xyz", [{"abc"}, {"xyz"}]),
        ("abc|x", None),
        ("ab?cde", [{"abc", "bcd", "cde"}, {"acd", "cde"}]),
        ("(?:abc)+[0-9]*XYZ", [{"abc", "xyz"}]),
        ("abc.*", [{"abc"}]),
        ("a[bc]d", [{"abd"}, {"acd"}]),
        ("foo(?=bar)", [{"foo"}]),
    ],
)
def test_trigram_queries(pattern, clauses):
    got = secrets.trigram_query(pattern)
    assert (None if got is None else {frozenset(c) for c in got}) == (None if clauses is None else {frozenset(c) for c in clauses})


def test_queries_hold_wherever_rules_match():
    for r in secrets.RULES:
        q = secrets.trigram_query(r.pattern)
        for t in corpus(9):
            if re.search(r.pattern, t) and q is not None:
                low = t.lower()
                assert any(all(g in low for g in c) for c in q), (r.kind, t)


def test_candidates_are_those_with_a_whole_clause(spark):
    texts = spark.createDataFrame([(1, "a Password here"), (2, "pass and word"), (3, "tokens"), (4, "nothing"), (5, "AKIAX")], "key long, text string")
    queries = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.BASE}
    asked = sorted({t for q in queries.values() if q for c in q for t in c})
    got = {r[0]: sorted(r[1]) for r in secrets.candidates(secrets.index(texts, asked), queries).collect()}
    assert got == {1: ["assign"], 3: ["assign"], 5: ["access"]}


def test_labels_and_no_python_worker(spark):
    docs = spark.createDataFrame([(1, "x secret=abcdef AKIA" + "B" * 16)], "doc_id long, text string")
    found = secrets.scan(docs)
    assert found.select(secrets.labels(found["spans"]).alias("s")).first()[0] == "assign:2:15,access:16:36"
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
