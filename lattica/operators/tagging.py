"""Tagging nodes by a profile of resource type patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import materialise
from .schema import CONFIG_ROWS, config_table


def full_match(value, pattern):
    """F-2: whole-string regular expression match, as columns."""
    return F.rlike(value, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


def match_types(nodes: DataFrame, profile: DataFrame) -> DataFrame:
    """P-1: resource_type with each profile row that matches it. Types are few: they are matched once each, not per node."""
    kinds = nodes.select("resource_type").where("resource_type IS NOT NULL").distinct()
    return kinds.join(config_table(profile), full_match(F.col("resource_type"), F.col("tf_name")))


def tag_nodes(nodes: DataFrame, profile: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """P-1, F-3, V-6: nodes with sections (all that match), section, group_name, general_name, annotation (of the last
    match in profile order), can_public (any match) and tagged. profile is a config table of tens of rows.

    types: resource_type of all nodes and perhaps others, where they can be had without the nodes. Nodes are not shuffled by their
    types, which are few, unless more than a config table's rows match."""
    each = match_types(nodes if types is None else types, profile).groupBy("resource_type").agg(
        F.array_sort(F.collect_set("section")).alias("sections"),
        F.max(F.struct("ord", "section", "group_name", F.col("member_name").alias("general_name"), "annotation")).alias("m"),
        F.max(F.coalesce("can_public", F.lit(False))).alias("can_public"),
    )
    each = materialise(each)
    few = each.limit(CONFIG_ROWS + 1).count() <= CONFIG_ROWS
    out = nodes.join(F.broadcast(each) if few else each, "resource_type", "left")
    return out.select(*nodes.columns, "sections", "m.section", "m.group_name", "m.general_name", "m.annotation", F.coalesce("can_public", F.lit(False)).alias("can_public"), F.col("m").isNotNull().alias("tagged"))


def tag_public(nodes: DataFrame, subnets: DataFrame) -> DataFrame:
    """P-2: is_public for nodes whose resource_name is a public subnet's (subnets: path_id, resource_name)."""
    hit = subnets.select("path_id", "resource_name").distinct().withColumn("is_public", F.lit(True))
    of = nodes.join(hit, ["path_id", "resource_name"], "left")
    return of.select(*nodes.columns, (F.coalesce("is_public", F.lit(False)) & (F.col("resource_type") == "aws_subnet")).alias("is_public"))


def display_name(with_name: bool = True):
    """P-3: 'group (general) - name', or without the name."""
    return F.format_string("%s (%s) - %s", "group_name", "general_name", "name") if with_name else F.format_string("%s (%s)", "group_name", "general_name")


def compress_patterns(profile: DataFrame) -> list[str]:
    """SC-10: patterns to contract, in profile order; a config table of tens of rows."""
    return [r["tf_name"] for r in profile.where("compress").orderBy("ord").select("tf_name").collect()]
