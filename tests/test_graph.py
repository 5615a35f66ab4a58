import random

import pytest

from lattica.operators import chains, graph
from lattica.operators.schema import OWN_RULES, as_edges

EDGE = "path_id string, src long, dst long"


def frame(spark, pairs):
    return spark.createDataFrame([("p", a, b) for a, b in pairs], EDGE)


def tags(spark, nodes, tagged):
    return spark.createDataFrame([(n, n in tagged) for n in nodes], "node_id long, tagged boolean")


def reach(pairs):
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= more
    return out


def random_graph(seed, nodes=9, n=14):
    r = random.Random(seed)
    return [(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)]


def linked(pairs, tagged):
    r = {(a, b) for a, b in reach(pairs) if a in tagged and b in tagged and a != b}
    return {(a, b) for a, b in r if not any(w not in (a, b) and (a, w) in r and (w, b) in r for w in tagged)}


def disjoint(pairs, start, goals):
    """Whether two edge-disjoint paths lead from start to goals."""

    def path(banned):
        front, came = [start], {start: None}
        while front:
            at = front.pop(0)
            for k, (a, b) in enumerate(pairs):
                if a == at and k not in banned and b not in came:
                    came[b] = (at, k)
                    if b in goals:
                        out = []
                        while came[b]:
                            b, k = came[b]
                            out.append(k)
                        return out
                    front.append(b)
        return None

    first = path(())
    return first is not None and all(path((k,)) is not None for k in first)


def pruned(nodes, pairs, tagged):
    nodes, pairs = set(nodes), list(pairs)
    while True:
        gone = set()
        for n in nodes - set(tagged):
            back = [(b, a) for a, b in pairs]
            if not any(b == n for _, b in pairs) and not disjoint(pairs, n, tagged):
                gone.add(n)
            elif not any(a == n for a, _ in pairs) and not disjoint(back, n, tagged):
                gone.add(n)
        if not gone:
            return nodes
        nodes -= gone
        pairs = [(a, b) for a, b in pairs if a in nodes and b in nodes]


@pytest.mark.parametrize("seed", range(2))
def test_closure_and_bounded_reach(spark, seed):
    pairs = random_graph(seed)
    e = frame(spark, pairs)
    assert {(x["src"], x["dst"]) for x in graph.closure(e).collect()} == reach(pairs)
    every = spark.range(9).withColumnRenamed("id", "node_id")
    full = graph.reach_from(e, every)
    assert {(x["src"], x["dst"]) for x in full.collect()} == reach(pairs) and full.count() == len(reach(pairs))
    two = set(pairs) | {(a, d) for a, b in pairs for c, d in pairs if b == c}
    assert {(x["src"], x["dst"]) for x in graph.reach_from(e, every, most=2).collect()} == two


@pytest.mark.parametrize("seed", range(3))
def test_link_tagged(spark, seed):
    pairs, tagged = random_graph(seed + 10, 8, 11), {0, 2, 4, 7}
    got = graph.link_tagged(frame(spark, pairs), tags(spark, range(8), tagged).where("tagged"))
    assert {(x["src"], x["dst"]) for x in got.collect()} == set(pairs) | linked(pairs, tagged)
    new = {(x["src"], x["dst"]) for x in got.where("method = 'link_tagged'").collect()}
    assert new == linked(pairs, tagged) - set(pairs)


def test_link_tagged_micro_fixtures(spark):
    for pairs, tagged, new in [
        ([(1, 2), (2, 3), (3, 4), (4, 5)], {1, 3, 5}, {(1, 3), (3, 5)}),
        ([(1, 2), (2, 6), (1, 3), (3, 4), (4, 5), (5, 6)], {1, 4, 6}, {(1, 4), (4, 6)}),
        ([(1, 3), (1, 2), (2, 3)], {1, 2, 3}, set()),
        ([(1, 2), (2, 1), (1, 3), (3, 4)], {1, 4}, {(1, 4)}),
    ]:
        got = graph.link_tagged(frame(spark, pairs), tags(spark, range(1, 7), tagged).where("tagged"))
        assert {(x["src"], x["dst"]) for x in got.where("method = 'link_tagged'").collect()} == new


@pytest.mark.parametrize(
    ("pairs", "tagged", "left"),
    [
        ([(1, 2), (1, 3), (2, 4), (3, 4), (4, 9)], {9}, {9}),  # a bridge
        ([(1, 8), (1, 9)], {8, 9}, {1, 8, 9}),
        ([(1, 9), (1, 9)], {9}, {1, 9}),
        ([], {9}, {9}),
    ],
)
def test_prune_micro_fixtures(spark, pairs, tagged, left):
    nodes = {x for p in pairs for x in p} | tagged | {5}
    n, e = graph.prune_untagged(tags(spark, nodes, tagged), frame(spark, pairs))
    assert {x["node_id"] for x in n.collect()} == left
    assert {(x["src"], x["dst"]) for x in e.collect()} == {(a, b) for a, b in pairs if a in left and b in left}


@pytest.mark.parametrize("seed", range(2))
def test_prune_against_brute_force(spark, seed):
    pairs, tagged = random_graph(seed + 30, 10, 13), {1, 4, 8}
    n, _ = graph.prune_untagged(tags(spark, range(10), tagged), frame(spark, pairs))
    assert {x["node_id"] for x in n.collect()} == pruned(range(10), pairs, tagged)


@pytest.mark.parametrize("seed", range(2))
def test_contraction_against_brute_force(spark, seed):
    pairs, members = random_graph(seed + 50, 10, 12), {0, 3, 4, 6, 9}
    r, label = reach(pairs), {i: i for i in range(10)}
    for _ in range(10):
        for a, b in r:
            if a in members and b in members:
                label[a] = label[b] = min(label[a], label[b])
    nodes = spark.range(10).withColumnRenamed("id", "node_id")
    n, e, _ = graph.contract(nodes, as_edges(frame(spark, pairs)), spark.createDataFrame([(m,) for m in members], "node_id long"))
    assert {x["node_id"] for x in n.collect()} == set(label.values())
    assert {(x["src"], x["dst"]) for x in e.collect()} == {(label[a], label[b]) for a, b in pairs if label[a] != label[b]}


def test_contraction_by_patterns(spark):
    kinds = {1: "a_x", 2: "a_y", 3: "c", 5: "b", 6: "b"}
    nodes = spark.createDataFrame([("p", k, v) for k, v in kinds.items()] + [("q", 9, "c")], "path_id string, node_id long, resource_type string")
    e = as_edges(frame(spark, [(1, 2), (5, 2), (1, 6), (3, 5)]))

    def left(*patterns):
        n, rest = graph.contract_patterns(nodes, e, list(patterns))
        return {x["node_id"] for x in n.collect()}, {(x["src"], x["dst"]) for x in rest.collect()}

    assert left(r"a_\w", "b", r"a_\w") == ({1, 3, 5, 9}, {(5, 1), (1, 5), (3, 5)})
    assert left("b", r"a_\w") == ({1, 3, 5, 6, 9}, {(5, 1), (1, 6), (3, 5)})
    assert left("c", "none", "a_") == left() == (set(kinds) | {9}, {(1, 2), (5, 2), (1, 6), (3, 5)})


def test_boundaries(spark):
    e = as_edges(frame(spark, [(1, 2), (2, 3), (4, 5), (5, 6), (7, 8)]))
    b = spark.createDataFrame([(2,), (5,), (8,)], "node_id long")
    per = {(x["src"], x["dst"]) for x in graph.remove_boundaries(e, b).collect()}
    assert per == {(1, 3), (4, 6), (7, 8)}
    whole = {(x["src"], x["dst"]) for x in graph.remove_boundaries(e, b, global_product=True).collect()}
    assert whole == {(1, 3), (1, 6), (4, 3), (4, 6), (7, 8)}
    assert {x["node_id"] for x in graph.outermost(frame(spark, [(2, 9), (9, 5), (8, 1)]), b).collect()} == {5, 8}


def test_ownership_and_unknown_methods(spark):
    e = frame(spark, [(1, 2), (3, 2), (2, 4)])
    g = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "node_id long, group_name string")
    rules = [(0, "x", "b", "a", "Backward"), (1, "y", "b", "d", "Forward"), (2, "z", "a", "c", "IntersectForward"), (3, "w", "c", "a", "IntersectBackward")]
    got = {(x["rule"], x["first"], x["second"]) for x in graph.own_pairs(e, g, spark.createDataFrame(rules, OWN_RULES)).collect()}
    assert got == {("x", 2, 1), ("y", 2, 4), ("z", 1, 3)}
    with pytest.raises(NotImplementedError):
        graph.own_pairs(e, g, spark.createDataFrame([(0, "x", "a", "b", "Sideways")], OWN_RULES))


def test_nearest_chains_degrees(spark):
    e = frame(spark, [(1, 2), (2, 3), (1, 4), (3, 1), (5, 5)])
    v = spark.createDataFrame([(3, "three"), (4, "four"), (2, None)], "node_id long, value string")
    assert {(x["node_id"], x["value"], x["depth"]) for x in graph.nearest_valued(e, v).collect()} == {(3, "three", 0), (4, "four", 0), (2, "three", 1), (1, "four", 1)}
    c = chains.chains(e, spark.createDataFrame([(1,)], "node_id long")).collect()
    assert [tuple(x["path"]) for x in c] == [(1, 2, 3), (1, 2), (1, 4)] and c[0]["length"] == 2
    assert {tuple(x) for x in graph.degree(e).where("node_id IN (1, 5)").collect()} == {(1, 1, 2, 3), (5, 1, 1, 2)}
    assert graph.without_self_loops(e).count() == 4


def simple_paths(pairs, starts, most=None):
    out, todo = [], [(a,) for a in starts]
    step = {}
    for a, b in set(pairs):
        step.setdefault(a, set()).add(b)
    while todo:
        p = todo.pop()
        for b in step.get(p[-1], ()):
            if b not in p and (most is None or len(p) <= most):
                out.append(p + (b,))
                todo.append(p + (b,))
    return sorted(out, key=lambda p: (-len(p), p))


@pytest.mark.parametrize(("seed", "top", "most"), [(1, 10, None), (3, 5, 3), (4, None, None)])
def test_longest_chains_against_all_paths(spark, seed, top, most):
    r = random.Random(seed)
    pairs = [(r.randrange(14), r.randrange(14)) for _ in range(26)] + [(20, 21), (21, 22), (22, 20), (22, 3), (5, 20)]
    starts = [0, 1, 5, 20, 99]
    got = chains.chains(frame(spark, pairs), spark.createDataFrame([(x,) for x in starts], "node_id long"), most=most, top=top).collect()
    want = simple_paths(pairs, starts, most)
    rows = [tuple(x["path"]) for x in got]
    assert (sorted(rows, key=lambda p: (-len(p), p)) if top is None else rows) == want[:top]
    assert all(x["length"] == len(x["path"]) - 1 and x["path_id"] == "p" for x in got)


def test_chains_of_many_paths(spark):
    """18 layers of 4 nodes have 4^18 paths."""
    pairs = [(4 * k + a, 4 * k + 4 + b) for k in range(17) for a in range(4) for b in range(4)]
    got = chains.chains(frame(spark, pairs), spark.createDataFrame([(0,), (1,)], "node_id long")).collect()
    least = [4 * k for k in range(18)]
    assert len(got) == 10 and list(got[0]["path"]) == least and {x["length"] for x in got} == {17}
    assert [x["path"][-2:] for x in got] == [[4 * 16 + a, 4 * 17 + b] for a in range(3) for b in range(4)][:10]


def test_chains_within_large_components_are_refused(spark):
    pairs = [(a, b) for a in range(9) for b in range(9) if a != b]
    with pytest.raises(ValueError, match="simple paths"):
        chains.chains(frame(spark, pairs), spark.createDataFrame([(0,)], "node_id long"), tries=1000)


@pytest.mark.parametrize("seed", range(2))
def test_strong_components(spark, seed):
    pairs = random_graph(seed + 70, 16, 26) + [(30, 31), (31, 32), (40, 40)]
    r = reach(pairs)
    want = {x: min([x, *(b for a, b in r if a == x and (b, x) in r)]) for p in pairs for x in p}
    assert {x["node"]: x["comp"] for x in chains.strong_components(frame(spark, pairs)).collect()} == want


def test_empty_graphs(spark):
    e, n = as_edges(frame(spark, [])), tags(spark, [], set())
    assert graph.closure(e).count() == graph.link_tagged(e, n).count() == graph.degree(e).count() == 0
    assert graph.prune_untagged(n, e)[0].count() == graph.contract(n, e, n)[0].count() == graph.remove_boundaries(e, n).count() == 0
    assert chains.chains(e, n).count() == graph.nearest_valued(e, spark.createDataFrame([], "node_id long, value string")).count() == 0


def test_no_cap_on_depth(spark):
    """A path of 14 edges, a chain of 15 locals, 60 boundaries one in another: whole."""
    from lattica.operators import dfd, resolve

    path = spark.createDataFrame([("p", i, i + 1) for i in range(14)], "path_id string, src long, dst long")
    found = chains.chains(path, spark.createDataFrame([(0,)], "node_id long"), top=3).collect()
    assert [x["length"] for x in found] == [14, 13, 12]
    rows = [("p", "local", f"l{i}", "${local.l%d}!" % (i - 1) if i else "x") for i in range(15)]
    solved = resolve.resolve_bindings(spark.createDataFrame(rows, "path_id string, scope string, name string, value string"))
    assert {x["name"]: x["value"] for x in solved.collect()} == {f"l{i}": "x" + "!" * i for i in range(15)}
    placed = spark.createDataFrame([("p", i, i + 1) for i in range(60)], "path_id string, parent long, child long")
    tree = dfd.tree(placed, spark.createDataFrame([("p", 0)], "path_id string, child long"))
    assert {x["id"]: x["depth"] for x in tree.collect()} == {i: i + 1 for i in range(61)}


def test_link_tagged_on_random_graphs(spark):
    """Cycles through tagged and other nodes: against the rule, pair by pair."""
    r = random.Random(11)
    rows = {(g, 100 * g + r.randrange(9), 100 * g + r.randrange(9)) for g in range(12) for _ in range(11)}
    tags = {100 * g + k for g in range(12) for k in r.sample(range(9), 4)}
    edges = spark.createDataFrame([(str(g), a, b) for g, a, b in rows], "path_id string, src long, dst long")
    got = {(x["src"], x["dst"]) for x in graph.link_tagged(edges, spark.createDataFrame([(t,) for t in tags], "node_id long")).where("method IS NOT NULL").collect()}
    out = {}
    for _, a, b in rows:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in list(out):
        todo, seen = list(out[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[a] = seen
    pairs = {(a, b) for a in tags for b in reach.get(a, ()) if b in tags and a != b}
    want = {(a, b) for a, b in pairs if not any((a, w) in pairs and (w, b) in pairs for w in tags if w not in (a, b))} - {(a, b) for _, a, b in rows}
    assert got == want and want


def test_euler_tour(spark):
    from lattica.operators.tour import euler_tour

    r = random.Random(6)
    parent = {k: None if k < 3 else r.randrange(k) for k in range(60)} | {100 + k: 99 + k if k else None for k in range(40)}
    order = {k: r.choice("ab") for k in parent}
    want = {}

    def walk(k, root, depth, at):
        opens, at = at, at + 1
        for c in sorted((c for c in parent if parent[c] == k), key=lambda c: (order[c], c)):
            at = walk(c, root, depth + 1, at)
        want[k] = (root, opens, at, depth)
        return at + 1

    for k in parent:
        if parent[k] is None:
            walk(k, k, 0, 0)
    forest = spark.createDataFrame([(k, p, order[k]) for k, p in parent.items()], "node long, parent long, ord string")
    assert {x["node"]: (x["root"], x["opens"], x["closes"], x["depth"]) for x in euler_tour(forest).collect()} == want
    assert euler_tour(forest.where("false")).count() == 0
    for bad in ([(1, 2, "a"), (2, 1, "a")], [(1, 7, "a")]):
        with pytest.raises(ValueError, match="cycle"):
            euler_tour(spark.createDataFrame(bad, "node long, parent long, ord string"))


def test_direct_pairs_along_a_path(spark):
    """Labels of a path of tagged nodes: one chain, each node one number."""
    from lattica.operators.labels import direct_pairs

    pairs = [(k, k + 1) for k in range(20)] + [(0, 7), (3, 20), (5, 9)]
    got = direct_pairs(frame(spark, pairs), spark.range(0, 21, 2).withColumnRenamed("id", "node_id"))
    assert {tuple(x) for x in got.collect()} == {(k, k + 2) for k in range(0, 20, 2)}


def test_large_tables_are_not_sent_around(spark):
    from lattica.operators.schema import config_table

    assert config_table(spark.range(5), most=5).count() == 5
    with pytest.raises(ValueError):
        config_table(spark.range(6), most=5)
