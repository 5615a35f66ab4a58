"""Euler tours of forests by list ranking: where each node of a tree opens and closes, without gathering a tree.

Most nodes of a wide tree are leaves. They are counted among their siblings only; the list is that of nodes with children.
Every such node has two stops, one where it opens and one where it closes; each stop knows the next one from its own parent, child
or sibling alone. Ranks follow by pointer jumping: each round a stop adds what its next one knows and jumps to where that
one leads, so that a tree of n such nodes takes about log2(2n) rounds, however deep it is. A stop is the next one of one other
at most, so the joins have no hot keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import counted, materialise


def euler_tour(forest: DataFrame) -> DataFrame:
    """forest: node (unique), parent (null for roots), ord (the order of siblings, then by node).

    node, root, opens, closes (places in the tour of its tree, from 0), depth (0 for roots). Parents that are no node of their
    own, and cycles, are refused with ValueError."""
    rows = materialise(forest.select("node", "parent", "ord"))
    parents = materialise(rows.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct())
    if not parents.join(rows, "node", "left_anti").isEmpty():
        raise ValueError("the forest has a cycle, or a parent that is no node")
    inner = parents.withColumn("wide", F.lit(True))
    kids = _placed_siblings(rows.where("parent IS NOT NULL").join(inner, "node", "left").select("node", "parent", "ord", F.coalesce("wide", F.lit(False)).alias("wide")))
    # leaves: how many stand before; wide: number among its parent's nodes with children
    kids = materialise(kids)
    wide = kids.where("wide").select("node", "parent", "leaves", "k")
    sums = kids.groupBy("parent").agg(F.count_if(~F.col("wide")).alias("all_leaves"), F.count_if("wide").alias("all_wide")).withColumnRenamed("parent", "node")
    at = lambda rows_, **names: rows_.select(*(F.col(v).alias(k) for k, v in names.items()))
    first = at(wide.where("k = 1"), node="parent", child="node", before="leaves")
    second = wide.select("parent", (F.col("k") - 1).alias("k"), F.col("node").alias("sibling"), F.col("leaves").alias("later"))
    known = rows.join(parents, "node", "left_semi").select("node", "parent").join(sums, "node").join(first, "node", "left")
    known = known.join(wide.select("node", "leaves", "k"), "node", "left").join(second, ["parent", "k"], "left").join(sums.select(F.col("node").alias("parent"), F.col("all_leaves").alias("around")), "parent", "left")
    stop = lambda node, closes: F.struct(node.alias("node"), F.lit(closes).alias("closes"))
    own = F.col("node")
    child, sibling, top = F.col("child").isNotNull(), F.col("sibling").isNotNull(), F.col("parent").isNull()
    # a stop's next one among nodes with children, and how many stops on it is: leaves between have two each
    after_open = F.when(child, stop(F.col("child"), False)).otherwise(stop(own, True))
    far_open = 1 + 2 * F.when(child, F.col("before")).otherwise(F.col("all_leaves"))
    after_close = F.when(sibling, stop(F.col("sibling"), False)).when(~top, stop(F.col("parent"), True))
    far_close = F.when(top, 1).otherwise(1 + 2 * (F.when(sibling, F.col("later")).otherwise(F.col("around")) - F.col("leaves")))
    long = lambda x: x.cast("long")
    rise_open, rise_close = F.when(child, 1).otherwise(0), F.when(sibling, 0).otherwise(-1)
    both = F.array(
        F.struct(stop(own, False).alias("stop"), after_open.alias("next"), long(far_open).alias("n"), long(rise_open).alias("d")),
        F.struct(stop(own, True).alias("stop"), after_close.alias("next"), long(far_close).alias("n"), long(rise_close).alias("d")),
    )
    state, n = counted(known.select(F.inline(both)).withColumn("root", F.when(F.col("next").isNull(), F.col("stop.node"))))
    for _ in range(math.ceil(math.log2(max(2, n))) + 1):
        if state.where("next IS NOT NULL").isEmpty():
            break
        there = state.select(F.col("stop").alias("next"), F.col("next").alias("onward"), F.col("n").alias("more"), F.col("d").alias("rise"), F.col("root").alias("end"))
        met = state.join(there, "next", "left")
        state = materialise(met.select("stop", F.col("onward").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("rise", F.lit(0))).alias("d"), F.coalesce("root", "end").alias("root")))
    if not state.where("next IS NOT NULL OR root IS NULL").isEmpty():
        raise ValueError("the forest has a cycle, or a parent that is no node")
    total = state.where("NOT stop.closes AND stop.node = root").select("root", F.col("n").alias("total"))
    placed = state.join(total, "root").select("root", "stop", (F.col("total") - F.col("n")).alias("at"), (-1 - F.col("d")).alias("depth"))
    opens = placed.where("NOT stop.closes").select(F.col("stop.node").alias("node"), "root", F.col("at").alias("opens"), "depth")
    closes = placed.where("stop.closes").select(F.col("stop.node").alias("node"), F.col("at").alias("closes"))
    inside = materialise(opens.join(closes, "node").select("node", "root", "opens", "closes", "depth"))
    # a leaf stands behind its parent's opening, or behind the last wide sibling before it, and the leaves between
    leaves = kids.where("NOT wide").join(inside.select(F.col("node").alias("parent"), "root", F.col("opens").alias("start"), F.col("depth").alias("above")), "parent")
    past = wide.join(inside.select("node", "closes"), "node").select("parent", "k", F.col("leaves").alias("passed"), F.col("closes").alias("since"))
    opened = F.coalesce("since", "start") + 1 + 2 * (F.col("leaves") - F.coalesce("passed", F.lit(0)))
    outer = leaves.join(past, ["parent", "k"], "left").select("node", "root", opened.alias("opens"), (opened + 1).alias("closes"), (F.col("above") + 1).alias("depth"))
    alone = rows.where("parent IS NULL").join(parents, "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("opens"), F.lit(1).cast("long").alias("closes"), F.lit(0).cast("long").alias("depth"))
    return materialise(inside.unionByName(outer).unionByName(alone))


def _placed_siblings(rows: DataFrame) -> DataFrame:
    """rows: node, parent, ord, wide. With leaves and k: how many siblings that are not wide stand before it in the order of ord
    and node, and how many wide ones up to it. Siblings are dealt by ranges of that order and counted within a range; what the
    ranges before hold is added, so that a parent's children need not be in one place."""
    dealt = materialise(rows.repartitionByRange("parent", "ord", "node").withColumn("range", F.spark_partition_id()))
    w = Window.partitionBy("parent", "range").orderBy("ord", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda x: F.sum(F.when(x, 1).otherwise(0))
    near = dealt.withColumns({"leaves": of(~F.col("wide")).over(w) - F.when(~F.col("wide"), 1).otherwise(0), "k": of(F.col("wide")).over(w)})
    before = Window.partitionBy("parent").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("parent", "range").agg(of(~F.col("wide")).alias("l"), of(F.col("wide")).alias("w"))
    past = held.select("parent", "range", F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w"))
    return near.join(past, ["parent", "range"]).select("node", "parent", "wide", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("k") + F.col("w")).alias("k"))
