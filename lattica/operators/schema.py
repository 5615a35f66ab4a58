"""The tables every operator works on.

nodes      path_id, node_id (unique over all projects), node_type, resource_type, resource_name, name, parent_id, ...
edges      path_id, src, dst, method, details, confidence: src depends on dst. Operators carry no other columns.
props      path_id, node_id, key, value
profile    section, group_name, annotation, member_name, tf_name, compress, can_public, ord
own_rules  ord, id, first_node, second_node, method
patterns   threat, stride, sender_type, sender_anno, recipient_type, recipient_anno, location_end
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "path_id string, node_id long, node_type string, resource_type string, resource_name string, name string, parent_id string"
EDGES = "path_id string, src long, dst long, method string, details string, confidence double"
PROFILE = "section string, group_name string, annotation string, member_name string, tf_name string, compress boolean, can_public boolean, ord int"
OWN_RULES = "ord int, id string, first_node string, second_node string, method string"
PATTERNS = "threat string, stride string, sender_type string, sender_anno string, recipient_type string, recipient_anno string, location_end string"
CONFIG_ROWS = 20_000
EDGE_COLUMNS = ["path_id", "src", "dst", "method", "details", "confidence"]


def config_table(df: DataFrame, most: int = CONFIG_ROWS) -> DataFrame:
    """df, a table of configuration, to be sent to every executor. One of more than `most` rows is refused: it is none."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a config table has more than {most} rows")
    return F.broadcast(df)


def as_edges(pairs: DataFrame, method: str | None = None) -> DataFrame:
    """path_id, src, dst (and what it has of the rest) as a full edge table."""
    have = set(pairs.columns)
    kinds = {"method": "string", "details": "string", "confidence": "double"}
    rest = [F.col(c) if c in have else F.lit(method if c == "method" else None).cast(k).alias(c) for c, k in kinds.items()]
    return pairs.select("path_id", "src", "dst", *rest)
