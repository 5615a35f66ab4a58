"""The driver's contract, and every query with SQL held against it on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and "threat_elicitation" in queries
    assert all(callable(f) for f in queries.values())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["path_id", "threat", "stride", "location", "element", "flow"]


def rounded(rows):
    plain = [tuple(None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = rounded([tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()])
    assert rounded([tuple(r[c] for c in columns) for r in df.collect()]) == want


@needs_data
def test_fuzzy_links_against_loops(spark):
    import pyarrow.parquet as pq

    parts = pq.read_table(f"{SF}/part.parquet").to_pylist()
    got = {(x["path_id"], x["src"], x["dst"], x["confidence"]) for x in entry.queries()["fuzzy_links"](spark, SF).collect()}
    want = set()
    for a in parts:
        value = a["p_name"].translate(str.maketrans("i ", "_-"))
        for b in parts:
            if a["p_brand"] == b["p_brand"] and abs(len(value) - len(b["p_name"])) <= 4 and len(value) >= 4:
                row = [0] * (len(b["p_name"]) + 1)
                for x in value:
                    new = [0]
                    for j, y in enumerate(b["p_name"]):
                        new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
                    row = new
                ratio = 2 * row[-1] / (len(value) + len(b["p_name"]))
                if ratio >= 0.75:
                    want.add((a["p_brand"], a["p_partkey"], b["p_partkey"] + 1_000_000_000, round(ratio, 6)))
    assert got == want


@needs_data
def test_contraction_against_loops(spark):
    from lattica import queries

    rows = [tuple(x) for x in queries.derived(spark, SF, queries.TRADE).select("path_id", "src", "dst").collect()]
    out, nodes = {}, {x for _, a, b in rows for x in (a, b)}
    for _, a, b in rows:
        out.setdefault(a, set()).add(b)
    members, group = {x for x in nodes if x % 5}, {x: x for x in nodes}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for m in members:
        todo, seen = list(out.get(m, ())), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        for x in seen & members:
            a, b = sorted((top(m), top(x)))
            group[b] = a
    want = {(p, top(a), top(b)) for p, a, b in rows if top(a) != top(b)}
    got = entry.queries()["contract_trade"](spark, SF).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) and len({top(x) for x in nodes}) > 1
