"""Ownership by shared nodes: each pair once, and the graph made once."""

import pytest

import __spark_entry__
from lattica.operators import graph


def test_nodes_that_share_one_over_several_paths(spark, monkeypatch):
    """own_pairs: parallel edges, also of another path, and many parts leave each pair once, with the path of the first node's edge."""
    from lattica.operators.schema import OWN_RULES

    monkeypatch.setattr(graph, "PART_ROWS", 2)
    links = [("p", 1, 9), ("p", 1, 9), ("q", 1, 9), ("p", 2, 9), ("q", 2, 9), ("q", 2, 9), ("p", 3, 9), ("p", 3, 8), ("p", 2, 8), ("p", 4, 7)]
    g = spark.createDataFrame([(1, "A"), (3, "A"), (2, "B"), (4, "B")], "node_id long, group_name string")
    rules = spark.createDataFrame([(5, "ab", "A", "B", "IntersectForward"), (6, "ba", "B", "A", "IntersectBackward"), (7, "bb", "B", "A", "IntersectForward")], OWN_RULES)
    got = [tuple(r) for r in graph.own_pairs(spark.createDataFrame(links, "path_id string, src long, dst long"), g, rules).collect()]
    want = {(p, o, i, a, b) for o, i, x, y in ((5, "ab", (1, 3), (2, 4)), (7, "bb", (2, 4), (1, 3))) for p, a, s in links for _, b, t in links if a in x and b in y and s == t}
    assert sorted(got) == sorted(want)


def test_shared_nodes_read_lines_once(spark):
    """own_intersect: the graph is made once, not for every side of every rule."""
    read = []
    table = __spark_entry__._graph.table
    with pytest.MonkeyPatch.context() as m:
        m.setattr(__spark_entry__._graph, "table", lambda s, sf, name: read.append(name) or table(s, sf, name))
        plan = __spark_entry__.queries()["own_intersect"](spark, "/root/testdata/sf0.001")
    assert read.count("lineitem") == 1 and "lineitem" not in plan._jdf.queryExecution().optimizedPlan().toString()
