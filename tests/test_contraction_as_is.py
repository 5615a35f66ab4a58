"""Contraction where nothing is joined: the graph is written once, and its self-loops and repeats still go."""

import pytest

from lattica.operators import graph

NODES = "path_id string, node_id long, resource_type string"
EDGES = "path_id string, src long, dst long, method string, details string, confidence double"
ROWS = [("p", 1, "a"), ("p", 2, "a"), ("p", 3, "b"), ("p", 4, "b"), ("p", 5, "c"), ("p", 6, "c")]
LINKS = [("p", 1, 3, "y", None, None), ("p", 1, 3, "x", None, 1.0), ("p", 2, 2, None, None, None), ("p", 2, 4, None, None, None), ("p", 5, 1, None, None, None)]


@pytest.mark.parametrize("more, patterns, left, remaps", [([], ["a", "b"], [1, 2, 3, 4, 5, 6], 0), ([("p", 3, 4, None, None, None)], ["b", "a", "c"], [1, 2, 3, 5, 6], 1), ([("p", 3, 4, None, None, None)], ["a", "b"], [1, 2, 3, 5, 6], 1), ([("p", 5, 6, None, None, None)], ["none"], None, 0)])
def test_patterns_one_after_another(spark, monkeypatch, more, patterns, left, remaps):
    asked = []
    remap = graph.remap
    nodes, edges = spark.createDataFrame(ROWS, NODES), spark.createDataFrame(LINKS + more, EDGES)
    want_nodes, want_edges = nodes, edges
    for p in patterns if left else []:  # as contraction is defined, with a new graph for each pattern
        want_nodes, want_edges, _ = graph.contract(want_nodes, want_edges, want_nodes.where(f"resource_type = '{p}'"))
    monkeypatch.setattr(graph, "remap", lambda *x: asked.append(1) or remap(*x))
    got_nodes, got_edges = graph.contract_patterns(nodes, edges, patterns)
    assert len(asked) == remaps
    plain = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert plain(got_edges) == plain(want_edges) and plain(got_nodes) == plain(want_nodes)
    assert left is None or sorted(r["node_id"] for r in got_nodes.collect()) == left
