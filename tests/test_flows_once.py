"""Flows of components with one shuffle an end, and one row an order for nodes, edges and pairs."""

import os

import pytest

from lattica import queries
from lattica.operators import dfd, tagging

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
ELEMENT = "path_id string, id long, kind string, name string, group_name string, annotation string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_component_flows(spark):
    found = spark.createDataFrame([("p", i, "TrustBoundary" if i == 9 else "Process" if i % 2 else "DataStore", f"e{i}", "g", "A" if i > 3 else None) for i in range(10)], ELEMENT)
    pairs = [(1, 2), (2, 1), (1, 2), (3, 3), (4, 9), (9, 5), (6, 77), (8, 7)]
    edges = spark.createDataFrame([("p", a, b) for a, b in pairs], "path_id string, src long, dst long")
    want = sorted([(1, 2), (2, 1), (7, 8), (8, 7)], key=str)
    assert rows(dfd.component_flows(edges, found), "sender", "recipient") == want
    assert rows(dfd.connections(edges, found), "src", "dst") == sorted([(1, 2), (2, 1), (8, 7)], key=str)
    named = dfd.named_component_flows(edges, found)
    assert rows(named, *sorted(named.columns)) == rows(dfd.named(dfd.flows(dfd.connections(edges, found)), found), *sorted(named.columns))


def test_pairs_are_shuffled_once_an_end(spark):
    """Neither telling the same pairs nor names of the ends shuffles pairs again, and counts carry no names."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = spark.createDataFrame([("p", i, "Process", f"e{i}", "g", None) for i in range(4)], ELEMENT)
        edges = spark.createDataFrame([("p", 1, 2), ("p", 2, 1), ("p", 2, 3)], "path_id string, src long, dst long")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert plan(dfd.named_component_flows(edges, found)).count("Exchange hashpartitioning") == 4  # pairs twice, elements twice
        assert "name" not in plan(dfd.named_component_flows(edges, found).groupBy("sender_type").count()).replace("group_name", "").split("Scan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_named_external_flows(spark):
    public = spark.createDataFrame([("p", 1, "Process", "a", "g", None), ("q", 2, "DataStore", "b", "g", "X")], ELEMENT)
    outside = spark.createDataFrame([("p", 7, "ExternalEntity", "Internet", None, "RemoteUser")], ELEMENT)
    assert rows(dfd.named_external_flows(outside, public), "path_id", "sender", "recipient", "flow") == [("p", 1, 7, "a->Internet"), ("p", 7, 1, "Internet->a")]


@needs_data
def test_one_row_an_order(spark):
    whole = queries.orders_whole(spark, SF)
    assert rows(queries.nodes_of(spark, SF, whole), "path_id", "node_id", "resource_type", "name") == rows(queries.nodes_of(spark, SF), "path_id", "node_id", "resource_type", "name")
    assert rows(queries.edges_of(spark, SF, whole), "path_id", "src", "dst") == rows(queries.edges_of(spark, SF), "path_id", "src", "dst")


@needs_data
def test_types_without_nodes(spark):
    nodes, profile = queries.nodes_of(spark, SF), queries.profile_of(spark)
    columns = ["node_id", "group_name", "annotation", "can_public", "tagged"]
    assert rows(tagging.tag_nodes(nodes, profile, queries.types_of(spark, SF)), *columns) == rows(tagging.tag_nodes(nodes, profile), *columns)
