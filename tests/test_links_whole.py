"""What string links must not leave out."""

from __future__ import annotations

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_every_order_has_a_string(spark):
    """exact_string_links: each order names a part, whether or not a part has the order's own key."""
    asked = spark.read.parquet(f"{SF}/orders.parquet")
    got = __spark_entry__.queries()["exact_string_links"](spark, SF)
    linked = asked.join(got.withColumnRenamed("src", "o_orderkey"), "o_orderkey", "left_semi").count()
    own = asked.where("o_orderkey < 200").count()
    assert own < linked and linked >= asked.count() - own


def test_shared_nodes_with_many_pairs(spark, monkeypatch):
    """own_pairs: at a node that brings many together the pairs are dealt over tasks; pairs that several nodes bring together come
    once, and those of nodes with one shared node are not made distinct."""
    from lattica.operators import graph
    from lattica.operators.schema import OWN_RULES

    monkeypatch.setattr(graph, "MEET", 20)
    links = [("p", a, 1000) for a in range(12)] + [("p", b, 1000) for b in range(100, 109)] + [("p", x, y) for y in (1001, 1002) for x in (0, 1, 100, 101, 300)]
    e = spark.createDataFrame(links, "path_id string, src long, dst long")
    g = spark.createDataFrame([(a, "A") for a in range(12)] + [(b, "B") for b in range(100, 109)] + [(300, "A"), (300, "B")], "node_id long, group_name string")
    rules = spark.createDataFrame([(0, "ab", "A", "B", "IntersectForward")], OWN_RULES)
    got = [(r["first"], r["second"]) for r in graph.own_pairs(e, g, rules).collect()]
    into = {}
    for _, a, x in links:
        into.setdefault(x, []).append(a)
    side = lambda n, kind: n == 300 or (n < 12) == (kind == "A")
    want = {(a, b) for ends in into.values() for a in ends if side(a, "A") for b in ends if side(b, "B") and a != b}
    assert sorted(got) == sorted(want)


def test_equal_strings_are_one_class(spark):
    """fuzzy_classes: copies of a name are not expanded into pairs, and no link between different names is lost."""
    from lattica.operators import match

    props = spark.createDataFrame([("p", i, "bucket", "big_ring") for i in range(30)] + [("p", 90, "bucket", "Small-ring")], "path_id string, node_id long, key string, value string")
    targets = spark.createDataFrame([("p", 100 + i, "aws_s3_bucket", "Big ring") for i in range(30)] + [("p", 190, "aws_s3_bucket", "small ring")], "path_id string, node_id long, resource_type string, target string")
    rows = match.fuzzy_classes(props, targets, 0.75).collect()
    links = {(r["src"], r["dst"]) for r in rows if r["kind"] == "link"}
    assert links == {(0, 100), (90, 190)} and len(rows) == 2 + 31 + 31
    back = {k: {(r["src"], r["dst"]) for r in rows if r["kind"] == k} for k in ("value", "target")}
    whole = {(a, b) for a, x in back["value"] for b, y in back["target"] if (x, y) in links}
    assert whole == {(r["src"], r["dst"]) for r in match.fuzzy_pairs(props, targets, 0.75).collect()}


def test_closure_of_ends_that_lead_nowhere(spark):
    """closure: pairs whose ends lead nowhere or have nothing before them are kept, and pairs found again come once."""
    from lattica.operators import graph

    links = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 2), (5, 6), (7, 1), (3, 9), (8, 8), (8, 10)]
    got = [(r["src"], r["dst"]) for r in graph.closure(spark.createDataFrame([("p", *x) for x in links], "path_id string, src long, dst long")).collect()]
    want = set(links)
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    assert sorted(got) == sorted(want)
