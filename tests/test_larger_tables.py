"""What one task holds, or a row costs, must not grow faster than the tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lattica import queries
from lattica.operators import lineage, match, resolve
from lattica.sources import graph_json

SF = "/root/testdata/sf0.001"

PROPS = "path_id string, node_id long, key string, value string"


def test_overlay_deals_over_more_parts(spark, monkeypatch):
    """Each of 12 parts gets its share of 600 nodes, whatever a query's small shuffles are put together to."""
    raw = [("p", i % 600, f"k{i % 2}", str(i)) for i in range(1200)] + [("p", 1, "k1", "1"), ("p", None, "k0", "n"), ("p", 7, None, "n")]
    late = [("p", i, "k0", v) for i in range(0, 600, 4) for v in ("b", "a")] + [("p", 5000, "k", "new"), ("p", 3, "k1", None)]
    a, b = (spark.createDataFrame(rows, PROPS) for rows in (raw, late))
    monkeypatch.setattr(resolve, "PART_ROWS", 125, raising=False)
    new = [("p", i, "k0", "a") for i in range(0, 600, 4)] + [("p", 5000, "k", "new"), ("p", 3, "k1", None)]
    for only in (False, True):
        gone = {x[1] if only else x[1:3] for x in late}
        want = [x for x in raw if (x[1] if only else x[1:3]) not in gone] + new
        got = resolve.overlay(a, b, only_resolved=only).select("path_id", "node_id", "key", "value")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        sizes = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 400


def test_values_without_a_symbol_are_not_taken_apart(spark, monkeypatch):
    """Only values that hold a symbol's start go on to be written and cut into tokens; more starts than are looked for change nothing."""
    symbols = spark.createDataFrame([("p", w, 1000 + k, w) for k, w in enumerate(["ab.c (d", "-é x", "long " * 30 + "end"])], "path_id string, key string, node_id long, keyword string")
    texts = ["x ab.c (d y", "xab.c (d", "ab.c (dd", "a -é x", "a-é x", "𝒳-é x😀", "long " * 31 + "end", "long " * 30, "nothing", None] + [f"other {i}" for i in range(50)]
    values = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts + texts[:1])], "path_id string, node_id long, value string").withColumn("node_id", F.when(F.col("value") == texts[0], 0).otherwise(F.col("node_id")))
    written = []

    def watch(df, *more):
        table = lineage.materialise(df, *more)
        written.append(table.count() if "value" in df.columns else 0)
        return table

    monkeypatch.setattr(match, "materialise", watch)
    for heads, most in ((500, 7), (2, 60)):
        monkeypatch.setattr(match, "HEADS", heads, raising=False)
        written.clear()
        got = sorted((x["src"], x["dst"]) for x in match.boundary_pairs(values, symbols, only_complex=False).collect())
        assert got == [(0, 1000), (3, 1001), (5, 1001), (6, 1002)] and max(written) <= most


def test_documents_are_parsed_once(spark):
    """Nodes, edges and attributes read what was parsed; edges know the documents' own ids, so that nothing is joined to have them."""
    doc = '{"nodes": [{"data": {"id": "1", "label": "a.b"}}, {"data": {"id": "2", "label": "a.c"}}], "edges": [{"data": {"source": "1", "target": "2"}}, {"data": {"source": "1", "target": "3"}}]}'
    tables = graph_json.load(spark.createDataFrame([("p", doc), ("q", doc)], "path_id string, document string"))
    assert not any("from_json" in t._jdf.queryExecution().optimizedPlan().toString().lower() or "jsontostructs" in t._jdf.queryExecution().optimizedPlan().toString().lower() for t in tables)
    assert {(x["path_id"], x["source"], x["target"]) for x in tables[1].collect()} == {("p", "1", "2"), ("q", "1", "2")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_graph_documents_of_repeated_orders_and_of_those_without_lines(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        more = f" UNION ALL SELECT * FROM '{SF}/orders.parquet' WHERE o_orderkey % 50 = 0" if t == "orders" else " WHERE l_orderkey % 3 > 0" if t == "lineitem" else ""
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet'{more}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = sorted((x["src"], x["dst"]) for x in queries.QUERIES["graph_documents"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT src, dst FROM ({queries.ORACLES['graph_documents']})").fetchall())
