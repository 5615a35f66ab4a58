"""Data-flow diagrams: elements, containment, flows, external entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .lineage import materialise
from .schema import config_table
from .tagging import display_name

GLOBAL = "Cloud"


def elements(tagged: DataFrame, profile: DataFrame) -> DataFrame:
    """O-1, O-2: path_id, id, kind, name, group_name, annotation. The group decides the kind: boundary before process
    before data store."""
    rank = F.when(F.col("section") == "boundaries", 0).when(F.col("section") == "processes", 1).otherwise(2)
    kinds = profile.select("group_name", rank.alias("k")).groupBy("group_name").agg(F.min("k").alias("k"))
    kind = F.element_at(F.array(*map(F.lit, ("TrustBoundary", "Process", "DataStore"))), F.col("k") + 1)
    of = tagged.where("tagged").join(config_table(kinds), "group_name")
    name = F.when(F.col("k") == 0, display_name(False)).otherwise(display_name())
    return of.select("path_id", F.col("node_id").alias("id"), kind.alias("kind"), name.alias("name"), "group_name", "annotation")


def containment(owned: DataFrame, found: DataFrame) -> DataFrame:
    """O-3, T-4: path_id, parent, child. Each element is placed once: by the first rule, then the smallest parent.

    owned: as graph.own_pairs gives it. Where a rule's first node is the component and the second the boundary, the
    boundary is the parent."""
    kinds = found.select("id", (F.col("kind") == "TrustBoundary").alias("b"))
    both = owned.join(kinds.select(F.col("id").alias("first"), F.col("b").alias("b1")), "first").join(kinds.select(F.col("id").alias("second"), F.col("b").alias("b2")), "second")
    turned = F.col("b2") & ~F.col("b1")
    laid = both.where("first <> second").select("path_id", "ord", F.when(turned, F.col("second")).otherwise(F.col("first")).alias("parent"), F.when(turned, F.col("first")).otherwise(F.col("second")).alias("child"))
    best = laid.groupBy("path_id", "child").agg(F.min(F.struct("ord", "parent")).alias("m"))
    return best.select("path_id", F.col("m.parent").alias("parent"), "child")


def under_global(found: DataFrame, placed: DataFrame, outer: DataFrame) -> DataFrame:
    """O-4, O-5: path_id, child of the global boundary: components without a place, and outermost boundaries."""
    components = found.where("kind <> 'TrustBoundary'").join(placed.select(F.col("child").alias("id")), "id", "left_anti")
    return components.select("path_id", F.col("id").alias("child")).union(outer.select("path_id", F.col("node_id"))).distinct()


def tree(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """O-10: path_id, id, parent, depth (1 under the global boundary), to the deepest."""
    level = materialise(roots.select("path_id", F.col("child").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("depth")))
    out = level
    depth = 1
    while True:
        depth += 1
        level = materialise(level.select("path_id", F.col("id").alias("parent")).join(placed.select("parent", F.col("child").alias("id")), "parent").select("path_id", "id", "parent", F.lit(depth).alias("depth")).join(out, "id", "left_anti"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
        if depth % 8 == 0:
            out = materialise(out)
    return out


def _met(pairs: DataFrame, one: str, two: str, found: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of different components, each once, with columns of their elements as {one}_* and {two}_*. Pairs are dealt by their first
    end, where the same ones lie together and meet its element, and then by the second; they are shuffled no more than that."""
    met = pairs.where(F.col(one) != F.col(two)).repartition(one).distinct()
    for end in (one, two):
        own = found.where("kind <> 'TrustBoundary'").select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        met = met.join(own, end, "inner" if columns else "left_semi")
    return met


def connections(edges: DataFrame, found: DataFrame) -> DataFrame:
    """O-6: edges between processes and data stores."""
    return _met(graph.pairs_of(edges), "src", "dst", found, []).select("path_id", "src", "dst")


def unordered(pairs: DataFrame) -> DataFrame:
    """path_id, a, b: pairs with the smaller end as a, as often as they come."""
    return pairs.select("path_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("path_id", F.explode(F.array(F.struct(F.col("a").alias("sender"), F.col("b").alias("recipient")), F.struct(F.col("b").alias("sender"), F.col("a").alias("recipient")))).alias("f")).select("path_id", "f.*")


def flows(pairs: DataFrame) -> DataFrame:
    """O-7: path_id, sender, recipient: each unordered pair of different ends once, then in both directions."""
    return _both_ways(unordered(pairs).where("a <> b").distinct())


def component_flows(edges: DataFrame, found: DataFrame) -> DataFrame:
    """O-6, O-7: `flows` of `connections`, without shuffling pairs a third time."""
    return _both_ways(_met(unordered(edges), "a", "b", found, []))


def external_flows(entities: DataFrame, public: DataFrame) -> DataFrame:
    """O-8, J-21: every external entity (path_id, id) with every public node (path_id, id) of its project, both ways."""
    e = entities.select("path_id", F.col("id").alias("src"))
    return flows(e.join(public.select("path_id", F.col("id").alias("dst")).distinct(), "path_id"))


def public_nodes(tagged: DataFrame, exposed: DataFrame) -> DataFrame:
    """O-9: nodes public by profile or by exposure (path_id, node_id)."""
    by_profile = tagged.where("tagged AND can_public AND section <> 'boundaries'").select("path_id", F.col("node_id").alias("id"))
    return by_profile.union(exposed.select("path_id", F.col("node_id"))).distinct()


def named(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Flows with both elements: types, annotations, names, and the flow's name 'a->b'. Flows of missing elements go."""
    s = found.select(F.col("id").alias("sender"), F.col("kind").alias("sender_type"), F.col("annotation").alias("sender_anno"), F.col("name").alias("sender_name"))
    r = found.select(F.col("id").alias("recipient"), F.col("kind").alias("recipient_type"), F.col("annotation").alias("recipient_anno"), F.col("name").alias("recipient_name"))
    return pairs.join(s, "sender").join(r, "recipient").withColumn("flow", F.concat("sender_name", F.lit("->"), "recipient_name"))


#: What `named` gives of an element.
OF_ELEMENT = ["kind", "annotation", "name"]


def _named_ways(met: DataFrame) -> DataFrame:
    """Both directions of pairs a, b with their elements, as `named` gives them. Each column is chosen by itself, so that a job that
    asks for no names carries none."""
    both = met.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    pick = lambda x, y, name: F.when(F.col("back"), F.col(y)).otherwise(F.col(x)).alias(name)
    short = {"kind": "type", "annotation": "anno", "name": "name"}
    ends = [pick("a", "b", "sender"), pick("b", "a", "recipient")]
    own = [pick(f"{x}_{c}", f"{y}_{c}", f"{end}_{short[c]}") for end, x, y in (("sender", "a", "b"), ("recipient", "b", "a")) for c in OF_ELEMENT]
    return both.select("path_id", *ends, *own).withColumn("flow", F.concat("sender_name", F.lit("->"), "recipient_name"))


def named_component_flows(edges: DataFrame, found: DataFrame) -> DataFrame:
    """`named` for `component_flows`: elements come with the joins that tell components."""
    return _named_ways(_met(unordered(edges), "a", "b", found, OF_ELEMENT))


def named_external_flows(entities: DataFrame, public: DataFrame) -> DataFrame:
    """`named` for `external_flows` of elements, each given once: they meet by project with their own columns, so no pair is looked up
    again."""
    a = public.select("path_id", F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in OF_ELEMENT))
    b = entities.select("path_id", F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in OF_ELEMENT))
    return _named_ways(a.join(b, "path_id"))
