"""What operators write on the way must not grow with what cannot matter to the result."""

from __future__ import annotations

import pytest

from lattica.operators import chains, graph
from lattica.operators.schema import as_edges

EDGE = "path_id string, src long, dst long"


@pytest.fixture
def rows_counted(monkeypatch):
    """The numbers of rows that chains' and graph's rounds write."""
    seen = []

    def watch(module, f):
        def run(df):
            table, n = f(df)
            seen.append(n)
            return table, n

        monkeypatch.setattr(module, "counted", run)

    watch(chains, chains.counted)
    watch(graph, graph.counted)
    return seen


@pytest.mark.parametrize(("most", "top"), [(None, 4), (3, 4)])
def test_chains_from_many_starts(spark, rows_counted, most, top):
    """300 starts that nothing leads to share a node with many paths: no list is written for each of them."""
    inner = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (6, 4)]
    pairs = inner + [(s, 1 + s % 2) for s in range(1000, 1300)] + [(2000, 1000)]
    e = spark.createDataFrame([("p", a, b) for a, b in pairs], EDGE)
    got = chains.chains(e, spark.createDataFrame([(s,) for s in [*range(1000, 1300), 4]], "node_id long"), most=most, top=top).collect()
    step = {}
    for a, b in pairs:
        step.setdefault(a, []).append(b)
    every, todo = [], [(s,) for s in [*range(1000, 1300), 4]]
    while todo:
        p = todo.pop()
        for b in step.get(p[-1], ()):
            if b not in p and (most is None or len(p) <= most):
                every.append(p + (b,))
                todo.append(p + (b,))
    assert [tuple(x["path"]) for x in got] == sorted(every, key=lambda p: (-len(p), p))[:top]
    assert max(rows_counted) < 100


def test_prune_with_many_sources(spark, rows_counted):
    """300 untagged sources that stay are judged at once, not in the rounds; one with a single way to tagged nodes goes."""
    pairs = [(1, 2), (1, 3)] + [(s, d) for s in range(1000, 1300) for d in (1, 2)] + [(2000, 1), (2000, 3), (3000, 2)]
    e = as_edges(spark.createDataFrame([("p", a, b) for a, b in pairs], EDGE))
    ids = sorted({x for p in pairs for x in p})
    n = spark.createDataFrame([(x, x in (2, 3)) for x in ids], "node_id long, tagged boolean")
    assert {r["node_id"] for r in graph.prune_untagged(n, e)[0].collect()} == set(ids) - {3000}
    assert max(rows_counted) < 100


def test_edges_between_marked_nodes(spark):
    """Edges of nodes that are not marked and have nothing before, or nothing behind them, are no part of ways between marked ones."""
    pairs = [(1, 2), (2, 3), (2, 9), (8, 2), (3, 4), (5, 1)]
    marked = spark.createDataFrame([(1,), (3,)], "node_id long")
    got = graph.between(spark.createDataFrame([("p", a, b) for a, b in pairs], EDGE), marked)
    assert {(r["src"], r["dst"]) for r in got.collect()} == {(1, 2), (2, 3)}
