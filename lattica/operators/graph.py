"""Graph operators over edges(path_id, src, dst): expands, reachability, reduction, pruning, contraction.

All are equi-joins keyed by node; iterative ones write each round's frontier to the shared folder and stop when it is
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import settled_upwards
from .components import components
from .labels import direct_pairs
from .lineage import counted, materialise
from .schema import as_edges, config_table
from .tagging import full_match, match_types

METHODS = ("Backward", "Forward", "IntersectForward", "IntersectBackward")


def pairs_of(edges: DataFrame) -> DataFrame:
    return edges.select("path_id", "src", "dst")


def expand(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """J-1: each edge with columns of both ends, as src_* and dst_*."""
    a = nodes.select(F.col("node_id").alias("src"), *(F.col(c).alias(f"src_{c}") for c in columns))
    b = nodes.select(F.col("node_id").alias("dst"), *(F.col(c).alias(f"dst_{c}") for c in columns))
    return edges.join(a, "src").join(b, "dst")


def expand_optional(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J-11: every node with each dependency, or null."""
    return nodes.select("path_id", F.col("node_id").alias("src")).join(edges.select("src", "dst"), "src", "left")


def degree(edges: DataFrame) -> DataFrame:
    """R-16, A-4, F-10: node_id, in_degree, out_degree, degree, of nodes with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def without_self_loops(edges: DataFrame) -> DataFrame:
    """R-10, F-16."""
    return edges.where("src <> dst")


def merge_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """SK-5, J-15, U-3: edges and those of more that are not there yet, one for each pair."""
    new = as_edges(more).groupBy("path_id", "src", "dst").agg(F.min(F.struct("method", "details", "confidence")).alias("m")).select("path_id", "src", "dst", "m.*")
    return as_edges(edges).unionByName(new.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))


def reach_from(edges: DataFrame, sources: DataFrame, most: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """R-1, J-8, J-9: path_id, src (a source), dst, depth (fewest steps, 1 at least). sources: node_id.

    stop: nodes (node_id) that are reached but not passed.
    """
    step = materialise(pairs_of(edges).distinct())
    new = materialise(step.join(sources.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").select("path_id", "src", "dst", F.lit(1).alias("depth")))
    seen, depth = new, 1
    while (most is None or depth < most) and not new.isEmpty():
        depth += 1
        at = new if stop is None else new.join(stop.select(F.col("node_id").alias("dst")), "dst", "left_anti")
        further = at.select("src", F.col("dst").alias("mid")).join(step.select("path_id", F.col("src").alias("mid"), "dst"), "mid").select("path_id", "src", "dst").distinct()
        new = materialise(further.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(new)
        if depth % 8 == 0:
            seen = materialise(seen)
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """R-1: path_id, src, dst for every pair with a path of one step or more.

    Squares the relation, so it takes as many rounds as the logarithm of the longest path. A pair knows of its ends whether one
    leads to its src (later), whether its dst leads on (on), and whether a longer path may end there (deep): only pairs that
    can be put together, or found again, go through the rounds."""
    no = F.lit(False)
    step = materialise(pairs_of(edges).distinct())
    into = step.select(F.col("dst").alias("src")).distinct().withColumn("later", F.lit(True))
    first = step.join(into, "src", "left").select("path_id", "src", "dst", F.coalesce("later", no).alias("later"))
    leads = step.select(F.col("src").alias("dst")).distinct().select("dst", F.lit(True).alias("on"), no.alias("deep"))
    ends = leads.unionByName(first.where("later").select("dst", no.alias("on"), F.lit(True).alias("deep")).distinct()).groupBy("dst").agg(F.max("on").alias("on"), F.max("deep").alias("deep"))
    seen = materialise(first.join(ends, "dst", "left").select("path_id", "src", "dst", "later", F.coalesce("on", no).alias("on"), F.coalesce("deep", no).alias("deep")))
    new, n, rounds = seen, 1, 0
    left = lambda t: t.where("on").select("path_id", "src", "later", F.col("dst").alias("mid"))
    right = lambda t: t.where("later").select(F.col("src").alias("mid"), "dst", "on", "deep")
    while n:
        met = left(seen).join(right(new), "mid").union(left(new).join(right(seen), "mid"))
        found = met.select("path_id", "src", "dst", "later", "on", "deep").distinct()
        new, n = counted(found.join(seen.where("deep").select("src", "dst"), ["src", "dst"], "left_anti"))
        seen, rounds = seen.unionByName(new), rounds + 1
        if rounds % 8 == 0:
            seen = materialise(seen)
    return pairs_of(seen)


def nearest_valued(edges: DataFrame, values: DataFrame, most: int = 10) -> DataFrame:
    """J-10: for each node the value of the nearest node that has one, itself included, within `most` steps.

    values: node_id, value. Ties go to the smallest node. Result: node_id, value, depth, at.
    """
    found = values.where("value IS NOT NULL").select("node_id", "value", F.lit(0).alias("depth"), F.col("node_id").alias("at"))
    back = materialise(edges.select("src", "dst").distinct())
    front, done = found, materialise(found)
    for depth in range(1, most + 1):
        front = (
            front.join(back, front["node_id"] == back["dst"])
            .groupBy("src")
            .agg(F.min(F.struct("at", "value")).alias("m"))
            .select(F.col("src").alias("node_id"), F.col("m.value").alias("value"), F.lit(depth).alias("depth"), F.col("m.at").alias("at"))
        )
        front = materialise(front.join(done, "node_id", "left_anti"))
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return done


def link_tagged(edges: DataFrame, tagged: DataFrame, drop_mixed: bool = False) -> DataFrame:
    """R-2, R-3: edges, and one for each pair of tagged nodes with a path but no tagged node w between by paths.

    drop_mixed also takes away found edges (no method) between tagged and untagged nodes.
    """
    t = materialise(tagged.select("node_id").distinct())
    path = edges.groupBy("src").agg(F.min("path_id").alias("path_id"))
    direct = direct_pairs(between(edges, t), t).join(path, "src").select("path_id", "src", "dst")
    kept = as_edges(edges)
    if drop_mixed:
        is_tagged = t.withColumn("t", F.lit(True))
        one = is_tagged.select(F.col("node_id").alias("src"), F.col("t").alias("ts"))
        two = is_tagged.select(F.col("node_id").alias("dst"), F.col("t").alias("td"))
        mixed = kept.join(one, "src", "left").join(two, "dst", "left")
        kept = mixed.where(F.col("method").isNotNull() | F.col("ts").eqNullSafe(F.col("td"))).select(*kept.columns)
    return merge_edges(kept, as_edges(direct, "link_tagged"))


def between(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """src, dst of edges that may lie on a way between marked nodes (node_id): none from a node that is not marked and has nothing
    before it, nor to one that is not marked and has nothing behind it."""
    e = edges.where("src <> dst").select("src", "dst")
    start = e.select(F.col("dst").alias("src")).union(marked.select(F.col("node_id").alias("src"))).distinct()
    e = materialise(e.join(start, "src", "left_semi").distinct())
    end = e.select(F.col("src").alias("dst")).union(marked.select(F.col("node_id").alias("dst"))).distinct()
    return materialise(e.join(end, "dst", "left_semi").select("src", "dst"))


def _trimmed(edges: DataFrame, tagged: DataFrame) -> DataFrame:
    """edges (eid, src, dst) without those to nodes that are not tagged and lead nowhere: nothing is ahead of these."""
    live = edges.select(F.col("src").alias("dst")).union(tagged.select(F.col("node_id").alias("dst"))).distinct()
    return materialise(edges.join(live, "dst", "left_semi").select(*edges.columns))


def _ahead(edges: DataFrame, tagged: DataFrame) -> DataFrame:
    """Nodes (node_id) with a path to a tagged node, and the tagged ones."""
    seen = new = materialise(tagged.select("node_id").distinct())
    back = edges.select("src", F.col("dst").alias("node_id"))
    depth = 0
    while not new.isEmpty():
        depth += 1
        new = materialise(back.join(new, "node_id", "left_semi").select(F.col("src").alias("node_id")).distinct().join(seen, "node_id", "left_anti"))
        seen = seen.union(new)
        if depth % 8 == 0:
            seen = materialise(seen)
    return materialise(seen)


def _one_way(edges: DataFrame, starts: DataFrame, tagged: DataFrame, ahead: DataFrame) -> DataFrame:
    """Starts that lack two edge-disjoint paths to tagged nodes. edges: eid, src, dst; starts, tagged, ahead: node_id.

    Most are told by their own edges: with under two edges to nodes ahead a start lacks them; it has them with two edges
    that each end in a tagged node, or in a node of its own with an edge to one. By Menger's theorem the others have them
    iff, without any one edge of one of their paths, they still reach a tagged node."""
    goal = tagged.select(F.col("node_id").alias("at"), F.lit(True).alias("hit"))
    edges = edges.join(ahead.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("eid", "src", "dst")
    next_to = edges.join(tagged.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("at"), F.lit(True).alias("next")).distinct()
    own = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("at")).join(starts.select("node_id").distinct(), "node_id", "left_semi").join(goal, "at", "left").join(next_to, "at", "left")
    first = own.groupBy("node_id").agg(F.count("*").alias("n"), (F.count("hit") + F.countDistinct(F.when(F.col("hit").isNull() & F.col("next"), F.col("at")))).alias("sure"))
    known = materialise(starts.select("node_id").distinct().join(first, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sure", F.lit(0)).alias("sure")))
    lone = known.where("n < 2").select("node_id")
    starts = known.where("n >= 2 AND sure < 2").select("node_id")
    if starts.isEmpty():
        return lone
    step = edges.select("eid", F.col("src").alias("at"), F.col("dst").alias("to"))
    front = starts.select("node_id", F.col("node_id").alias("at"), F.array().cast("array<long>").alias("path"))
    seen = front.select("node_id", "at")
    paths = None
    while True:  # one shortest path for each start
        new = front.join(step, "at").groupBy("node_id", F.col("to").alias("at")).agg(F.min(F.concat("path", F.array("eid"))).alias("path"))
        new = materialise(new.join(seen, ["node_id", "at"], "left_anti"))
        if new.isEmpty():
            break
        hits = new.join(goal, "at", "left_semi").groupBy("node_id").agg(F.min("path").alias("path"))
        paths = materialise(hits if paths is None else paths.unionByName(hits.join(paths, "node_id", "left_anti")))
        seen = seen.unionByName(new.select("node_id", "at"))
        front = new.join(paths, "node_id", "left_anti")
    trial = materialise(paths.select("node_id", F.explode("path").alias("banned")))
    front = trial.select("node_id", "banned", F.col("node_id").alias("at"))
    seen, saved = front, None
    while True:  # the same walk without one edge of that path
        new = front.join(step, "at").where("eid <> banned").select("node_id", "banned", F.col("to").alias("at")).distinct()
        new = materialise(new.join(seen, ["node_id", "banned", "at"], "left_anti"))
        if new.isEmpty():
            break
        hits = new.join(goal, "at", "left_semi").select("node_id", "banned").distinct()
        saved = materialise(hits if saved is None else saved.unionByName(hits).distinct())
        seen = seen.unionByName(new)
        front = new.join(saved, ["node_id", "banned"], "left_anti")
    cut = trial if saved is None else trial.join(saved, ["node_id", "banned"], "left_anti")
    return lone.unionByName(cut.select("node_id").distinct())


def _cuts(edges: DataFrame, tagged: DataFrame, ahead: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """node, cut: for each node with paths to tagged ones the last edge (eid) that all of them share, null if there is none,
    which by Menger's theorem means two edge-disjoint paths. edges: eid, src, dst; tagged, ahead: node_id.

    Found once for all nodes, from tagged ones upwards: a node's edges lead on to the cuts of their ends, or are cuts
    themselves where the end has none; the node has a cut if all agree on one. So each edge is one row of one round. Nodes
    that lead to a cycle are left: the second result (unit), with their number."""
    near = ahead.select(F.col("node_id").alias("dst"))
    every = edges.join(near, "dst", "left_semi").join(tagged.select(F.col("node_id").alias("src")), "src", "left_anti").select("eid", "src", "dst")
    # nodes that nothing leads to settle nothing else, so they come last, all at once
    led_to = materialise(edges.select(F.col("dst").alias("src")).distinct())
    step, apart = materialise(every.join(led_to, "src", "left_semi")), materialise(every.join(led_to, "src", "left_anti"))
    none = F.lit(None).cast("long")
    known = materialise(tagged.select(F.col("node_id").alias("node"), none.alias("cut")))
    pairs = materialise(step.join(known.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst").distinct())
    units = materialise(step.select(F.col("src").alias("unit")).distinct())
    rounds = 0

    def cuts_of(links: DataFrame) -> DataFrame:
        cut = F.coalesce("cut", "eid")
        on = links.join(known.select(F.col("node").alias("dst"), "cut"), "dst")
        return on.groupBy(F.col("src").alias("unit")).agg(F.when(F.min(cut) == F.max(cut), F.min(cut)).alias("cut"))

    def settle(ready: DataFrame) -> tuple[DataFrame, int]:
        nonlocal known, rounds
        new, n = counted(cuts_of(step.join(ready.select(F.col("unit").alias("src")), "src", "left_semi")))
        known, rounds = known.unionByName(new.select(F.col("unit").alias("node"), "cut")), rounds + 1
        if rounds % 8 == 0:
            known = materialise(known)
        return new, n

    left, n = settled_upwards(units, pairs, settle)
    known = materialise(known)
    if n:
        stuck = apart.join(left.select(F.col("unit").alias("dst")), "dst", "left_semi").select(F.col("src").alias("unit")).distinct()
        left, n = counted(left.union(stuck))
        apart = apart.join(stuck.select(F.col("unit").alias("src")), "src", "left_anti")
    return materialise(known.unionByName(cuts_of(apart).select(F.col("unit").alias("node"), "cut"))), left, n


def prune_untagged(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R-4: without untagged sources that lack two edge-disjoint paths to tagged nodes, and untagged sinks that lack two
    from them, again and again. nodes: node_id, tagged and others. Returns (nodes, edges).

    What goes never lies on a path between others, so what is ahead of tagged nodes, and the edges that all paths of a node
    share, are found once for both directions; a source or sink is then judged by its own row. Only those that lead to
    cycles are judged by walks of their own."""
    all_edges, left = edges, materialise(nodes.select("node_id", "tagged"))
    tagged = materialise(left.where("tagged").select("node_id"))
    live = edges.select(F.monotonically_increasing_id().alias("eid"), "src", "dst")
    live = materialise(live.join(left.select(F.col("node_id").alias("src")), "src", "left_semi").join(left.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("eid", "src", "dst"))
    turn = lambda e: e.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"))
    trimmed = {"source": _trimmed(live, tagged), "sink": _trimmed(turn(live), tagged)}
    ways = {side: (e, _ahead(e, tagged)) for side, e in trimmed.items()}
    cuts = {side: _cuts(e, tagged, near) for side, (e, near) in ways.items()}
    plain = left.where("NOT tagged").select("node_id")
    judged = {side: plain.where("false") for side in ways}
    while True:
        gone = plain.where("false")
        for side, (_, near) in ways.items():
            known, hard, n_hard = cuts[side]
            e = live if side == "source" else turn(live)
            ends = materialise(plain.join(e.select(F.col("dst").alias("node_id")), "node_id", "left_anti").join(judged[side], "node_id", "left_anti"))
            seen = ends.join(known.select(F.col("node").alias("node_id"), "cut", F.lit(True).alias("there")), "node_id", "left")
            if n_hard:
                asked = ends.join(hard.select(F.col("unit").alias("node_id")), "node_id", "left_semi")
                seen = seen.join(asked, "node_id", "left_anti")
                gone = gone.union(_one_way(e, asked, tagged, near))
            gone = gone.union(seen.where("there IS NULL OR cut IS NOT NULL").select("node_id"))
            judged[side] = judged[side].union(ends)
        gone, n = counted(gone.distinct())
        if not n:
            break
        plain = materialise(plain.join(gone, "node_id", "left_anti"))
        live = materialise(live.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("eid", "src", "dst"))
    ids = plain.union(tagged)
    kept = all_edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return nodes.join(ids, "node_id", "left_semi"), kept.select(*all_edges.columns)


def remap(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with ends replaced (labels: node, comp), without self-loops; of repeats the least (by its other columns) stays."""
    a = labels.select(F.col("node").alias("src"), F.col("comp").alias("new_src"))
    b = labels.select(F.col("node").alias("dst"), F.col("comp").alias("new_dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").withColumns({"src": F.coalesce("new_src", "src"), "dst": F.coalesce("new_dst", "dst")})
    return _once(moved.select(*edges.columns))


def _once(edges: DataFrame) -> DataFrame:
    """edges without self-loops; of repeats the least (by its other columns) stays."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return without_self_loops(edges).groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("m")).select("src", "dst", "m.*").select(*edges.columns)


def _groups(edges: DataFrame, members: DataFrame) -> DataFrame:
    """node, comp (the smallest member of its group) of members (node_id) that reach one another, as `contract` tells."""
    m = materialise(members.select("node_id").distinct())
    e = between(edges, m)
    within = _ahead(e, m).join(_ahead(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), m), "node_id", "left_semi")
    inner = e.join(within.select(F.col("node_id").alias("src")), "src", "left_semi").join(within.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    found = components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v"))).join(m.select(F.col("node_id").alias("node")), "node", "left_semi")
    least = found.groupBy("comp").agg(F.min("node").alias("least"))
    return materialise(found.join(least, "comp").select("node", F.col("least").alias("comp")))


def _joined(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = labels.where("node <> comp").select(F.col("node").alias("node_id"))
    return nodes.join(gone, "node_id", "left_anti"), remap(edges, labels)


def contract(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R-6, R-7, R-8: members (node_id) become one node, the smallest, where one reaches another.

    A node lies on a way from member to member if it has one before and one behind it. Among such nodes and members every
    edge joins what belongs together, so their components tell the groups, and no pair of members is made.
    Returns (nodes, edges, labels: node, comp)."""
    labels = _groups(edges, members)
    return *_joined(nodes, edges, labels), labels


def contract_patterns(nodes: DataFrame, edges: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """R-6 for one pattern of resource types after another (earlier ones add reachability for later ones).

    Patterns of which no project has two nodes are left out up front: one count for all patterns tells which. Where no members
    of a pattern reach one another the graph is not written anew; its self-loops and repeats go at the end. A null or empty
    list leaves all as it is."""
    patterns = list(dict.fromkeys(patterns or []))
    if not patterns:
        return nodes, edges
    fits = match_types(nodes, nodes.sparkSession.createDataFrame([(p,) for p in patterns], "tf_name string"))
    each = nodes.groupBy("path_id", "resource_type").agg(F.count("*").alias("n")).join(fits, "resource_type")
    several = {r[0] for r in each.groupBy("path_id", "tf_name").agg(F.sum("n").alias("n")).where("n > 1").select("tf_name").distinct().collect()}
    as_is = bool(several)
    for pattern in patterns:
        if pattern in several:
            labels = _groups(edges, nodes.where(full_match(F.col("resource_type"), F.lit(pattern))))
            if not labels.where("node <> comp").isEmpty():
                nodes, edges = map(materialise, _joined(nodes, edges, labels))
                as_is = False
    return nodes, materialise(_once(edges)) if as_is else edges


def contract_modules(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R-9: all members of one module (path_id, parent_id) become one node, connected or not."""
    module = ["path_id", "parent_id"]
    least = members.groupBy(*module).agg(F.min("node_id").alias("comp"))
    on = [members[c].eqNullSafe(least[c]) for c in module]
    labels = materialise(members.join(least, on).select(F.col("node_id").alias("node"), "comp"))
    gone = labels.where("node <> comp").select(F.col("node").alias("node_id"))
    return nodes.join(gone, "node_id", "left_anti"), remap(edges, labels)


def modules(nodes: DataFrame) -> DataFrame:
    """R-14: the non-empty parents."""
    return nodes.select("path_id", "parent_id").where(F.length("parent_id") > 0).distinct()


def remove_boundaries(edges: DataFrame, boundaries: DataFrame, global_product: bool = False) -> DataFrame:
    """R-12: public boundaries (node_id) with edges on both sides go; their predecessors get edges to their successors.

    Per boundary, or with global_product, per project over all of them together."""
    b = boundaries.select(F.col("node_id").alias("mid")).distinct()
    into = edges.where("src <> dst").select("path_id", "src", F.col("dst").alias("mid")).join(b, "mid", "left_semi").distinct()
    out = edges.where("src <> dst").select(F.col("src").alias("mid"), "dst", F.col("path_id").alias("p")).join(b, "mid", "left_semi").distinct()
    both = materialise(into.select("mid").intersect(out.select("mid")))
    into, out = into.join(both, "mid", "left_semi"), out.join(both, "mid", "left_semi")
    met = into.drop("mid").distinct().join(out.select(F.col("p").alias("path_id"), "dst").distinct(), "path_id") if global_product else into.join(out.drop("p"), "mid")
    gone = both.select(F.col("mid").alias("node_id"))
    kept = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    new = met.select("path_id", "src", "dst").distinct().join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return merge_edges(kept, as_edges(new, "boundary"))


def outermost(edges: DataFrame, boundaries: DataFrame) -> DataFrame:
    """R-13, O-5: boundaries (node_id) that reach no other boundary."""
    reach = reach_from(edges, boundaries).where("src <> dst").join(boundaries.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return boundaries.join(reach.select(F.col("src").alias("node_id")), "node_id", "left_anti")


#: Pairs that a shared node may bring together in one task; nodes that bring more are dealt over several.
MEET = 2_000_000


def _product(one: DataFrame, two: DataFrame, heavy: DataFrame, width: int) -> DataFrame:
    """Columns of one but x, and second: rows of one (r, x, first and others) and two (r, x, second) with the same r and x. At heavy
    ones (r, x, parts; width: the sum of parts) the rows of one are dealt by first, and those of two go to each part."""
    columns = [*(c for c in one.columns if c != "x"), "second"]
    if not width:
        return one.hint("merge").join(two, ["r", "x"]).select(*columns)
    few = F.broadcast(heavy)  # at most one for each MEET pairs of the result
    a = one.join(few, ["r", "x"]).withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")).select(*one.columns, "part")
    b = two.join(few, ["r", "x"]).select("r", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "second")
    n_tasks = min(max(width, 8), 2000)
    dealt = a.repartition(n_tasks, "r", "x", "part").hint("merge").join(b.repartition(n_tasks, "r", "x", "part"), ["r", "x", "part"])
    rest = one.join(few, ["r", "x"], "left_anti").hint("merge").join(two.join(few, ["r", "x"], "left_anti"), ["r", "x"])
    return rest.select(*columns).unionByName(dealt.select(*columns))


def _heavy(one: DataFrame, two: DataFrame) -> tuple[DataFrame, int]:
    """r, x, parts where rows of one and two make more than MEET pairs, and the sum of parts."""
    mark = lambda rows, n: rows.select("r", "x", *(F.lit(int(c == n)).alias(c) for c in ("n1", "n2")))
    pairs = F.col("n1") * F.col("n2")
    each = mark(one, "n1").unionByName(mark(two, "n2")).groupBy("r", "x").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).where(pairs > MEET)
    heavy = materialise(each.select("r", "x", F.ceil(pairs / MEET).cast("int").alias("parts")))
    return heavy, heavy.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]


def product(one: DataFrame, two: DataFrame) -> DataFrame:
    """Columns of one but x, and second: all pairs of rows of one (r, x, first and others) and two (r, x, second) with the same r
    and x, dealt over tasks by their number."""
    return _product(one, two, *_heavy(one, two))


def _met(ends: DataFrame, names: DataFrame) -> DataFrame:
    """path_id, ord, rule, first, second, each once: nodes of a rule's first (side 1) and second (side 2) group that meet at x. ends:
    path_id, r, side, node, x, dealt by node; names: r, ord, rule.

    The path is that of the first node's edge. Ends are made distinct, and counted for a node, where they lie. What a rule is called comes to its first nodes, not to each
    pair, unless pairs have to be made distinct."""
    ends = ends.withColumn("path_id", F.when(F.col("side") == 1, F.col("path_id"))).distinct().withColumn("more", F.count("*").over(Window.partitionBy("node", "r", "side")) > 1)
    ends = materialise(ends, by="side")
    one = ends.where("side = 1").select("path_id", "r", "x", F.col("node").alias("first"), "more")
    two = ends.where("side = 2").select("r", "x", F.col("node").alias("second"), "more")
    heavy, width = _heavy(one, two)
    has = [{r[0] for r in t.select("more").distinct().collect()} for t in (one, two)]
    names, columns, out = F.broadcast(names), ["path_id", "ord", "rule", "first", "second"], None
    for a in sorted(has[0]):
        for b in sorted(has[1]) if a else [None]:
            left = one.where(F.col("more") == a).drop("more")
            right = (two if b is None else two.where(F.col("more") == b)).drop("more")
            if a and b:
                met = _product(left, right, heavy, width).where("first <> second").distinct().join(names, "r")
            else:
                met = _product(left.join(names, "r"), right, heavy, width).where("first <> second")
            out = met.select(*columns) if out is None else out.unionByName(met.select(*columns))
    return one.join(names, "r").join(two.select("second", "r").where("false"), "r").select(*columns) if out is None else out


PART_ROWS = 1_000_000  # edges that a part has, about, where nodes meet their edges
#: Rows of a rule's first nodes that may go to every task; of more, links and nodes meet by key.
FEW = 20_000


def own_pairs(edges: DataFrame, groups: DataFrame, rules: DataFrame) -> DataFrame:
    """J-2 to J-6: first and second node of each ownership rule. groups: node_id, group_name. rules: see schema.

    The intersections give each pair that a shared node brings together, so their size is that of the result. A pair comes
    more than once only if both its nodes have several shared ones; others are not shuffled once they have met.
    Backward: first <- second. Forward: first -> second. IntersectForward: first -> x <- second. IntersectBackward:
    first <- x -> second. Another method raises. Result: path_id, ord, rule, first, second."""
    wrong = [r[0] for r in rules.where(~F.col("method").isin(*METHODS)).select("method").distinct().limit(5).collect()]
    if wrong:
        raise NotImplementedError(f"ownership method {wrong}")
    e = edges.select("path_id", "src", "dst")
    order = Window.orderBy("ord", "id", "first_node", "second_node", "method")  # a config table
    rules = config_table(materialise(config_table(rules).distinct().withColumn("r", F.row_number().over(order))))
    used = {r[0] for r in rules.select("method").distinct().collect()}
    names = rules.select("r", "ord", F.col("id").alias("rule"))
    out, parts = None, 0
    for method in METHODS:
        if method not in used:
            continue
        mine = rules.where(F.col("method") == method)
        first = groups.join(F.broadcast(mine), groups["group_name"] == mine["first_node"]).select("r", F.col("node_id").alias("first"))
        second = groups.join(F.broadcast(mine), groups["group_name"] == mine["second_node"]).select("r", F.col("node_id").alias("second"))
        if method in ("Backward", "Forward"):
            a, b = ("dst", "src") if method == "Backward" else ("src", "dst")
            links = e.select("path_id", F.col(a).alias("first"), F.col(b).alias("second"))
            few = materialise(first.limit(FEW + 1))  # boundaries are few: links to them are found where links are read
            met = links.join(F.broadcast(few) if few.count() <= FEW else first, "first").join(second, ["second", "r"]).select("path_id", "r", "first", "second").distinct()
            found = met.join(F.broadcast(names), "r").select("path_id", "ord", "rule", "first", "second")
        else:  # only nodes of the rules' groups meet at the shared one
            shared, far = ("dst", "src") if method == "IntersectForward" else ("src", "dst")
            sides = first.select("r", F.lit(1).alias("side"), F.col("first").alias("node")).unionByName(second.select("r", F.lit(2).alias("side"), F.col("second").alias("node")))
            if not parts:  # each rule reads the edges; tasks get no more of them as they grow
                e, n = counted(e)
                parts = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PART_ROWS))
            links = e.select("path_id", F.col(far).alias("node"), F.col(shared).alias("x")).repartition(parts, "node")
            found = _met(links.join(sides.repartition(parts, "node").hint("merge"), "node").select("path_id", "r", "side", "node", "x"), names)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return e.select("path_id", F.lit(0).alias("ord"), F.lit("").alias("rule"), F.col("src").alias("first"), F.col("dst").alias("second")).where("false")
    alike = rules.groupBy("ord", "id").count().where("count > 1")
    return out if alike.isEmpty() else out.distinct()


def group_pairs(edges: DataFrame, groups: DataFrame, first: str, second: str) -> DataFrame:
    """J-7: edges from nodes of one group to nodes of another."""
    a = groups.where(F.col("group_name") == first).select(F.col("node_id").alias("src"))
    b = groups.where(F.col("group_name") == second).select(F.col("node_id").alias("dst"))
    return pairs_of(edges).join(a, "src", "left_semi").join(b, "dst", "left_semi").distinct()
