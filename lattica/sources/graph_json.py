"""Graph documents ({nodes: [{data}], edges: [{data}]}) as nodes, edges and props; variants flattened to leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lineage import materialise

DOCUMENT = "nodes array<struct<data: struct<id: string, parent: string, label: string, type: string, attributes: variant, `default`: string, value: string>>>, edges array<struct<data: struct<source: string, target: string>>>"


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file: path_id (of its folder) and document."""
    files = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), "value")
    return files.select(T.path_id(F.regexp_replace("path", "/[^/]*$", "")).alias("path_id"), F.col("value").alias("document"))


def load(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """SC-5 to SC-8: (nodes, edges, attributes, dangling) of documents (path_id, document).

    A node's id is a hash of project and document id; of several nodes with one id the least stays; edges whose ends are missing are counted in dangling (Q17).
    Edges keep the document ids of their ends (source, target) as well. Documents are made and parsed once, for all four."""
    d = materialise(documents.select("path_id", F.from_json("document", DOCUMENT).alias("d")))
    key = lambda x: F.xxhash64("path_id", x)
    n = d.select("path_id", F.explode("d.nodes.data").alias("n")).select("path_id", "n.*")
    label = F.col("label")
    nodes = n.select(
        "path_id", key("id").alias("node_id"), F.coalesce("type", F.lit("resource")).alias("node_type"),
        T.type_of(label).alias("resource_type"), T.name_of(label).alias("resource_name"), label.alias("name"), F.coalesce("parent", F.lit("")).alias("parent_id"),
        F.array_compact(F.array("path_id", "type", F.when(F.col("type") == "var", "Variable").when(F.col("type") == "local", "Local"))).alias("labels"),
        "default", "value",
    )
    rest = [c for c in nodes.columns if c != "node_id"]
    nodes = nodes.groupBy("node_id").agg(F.min(F.struct(*rest)).alias("m")).select("node_id", "m.*").select(*nodes.columns)
    e = d.select("path_id", F.explode("d.edges.data").alias("e")).select("path_id", key("e.source").alias("src"), key("e.target").alias("dst"), "e.source", "e.target")
    ids = nodes.select("node_id")
    whole = e.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("path_id", "src", "dst", "source", "target")
    dangling = e.groupBy("path_id").agg(F.count("*").alias("n_edges")).join(whole.groupBy("path_id").agg(F.count("*").alias("n_whole")), "path_id", "left").select("path_id", (F.col("n_edges") - F.coalesce("n_whole", F.lit(0))).alias("n_dangling"))
    return nodes, whole, n.where("attributes IS NOT NULL").select("path_id", key("id").alias("node_id"), F.col("attributes").alias("v")), dangling


def flatten(values: DataFrame, keys: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """E-8, SC-7: keys, v (variant) -> keys, key (path), value (string) for each leaf; objects add .name, lists [i].

    A field named in skip (lower case; in any case there) goes with all below it, before it is taken apart.
    One round a level of nesting, until no container is left."""
    spark = values.sparkSession
    level = values.select(*keys, F.lit("").alias("key"), "v")
    out = None
    depth = 0
    while True:
        depth += 1
        level = materialise(level.withColumn("kind", F.schema_of_variant("v")).withColumn("inner", F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")))
        leaves = level.where("NOT inner AND kind <> 'VOID'").select(*keys, "key", F.variant_get("v", "$", "string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        if depth % 8 == 0:
            out = materialise(out)
        deep = level.where("inner").select(*keys, "key", "v")
        if deep.isEmpty():
            break
        each = deep.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "k", "item"))
        if skip:
            each = each.where(F.col("k").isNull() | ~F.lower("k").isin(*skip))
        step = F.when(F.col("k").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key") == "", F.col("k")).otherwise(F.concat(F.lit("."), F.col("k")))
        level = each.select(*keys, F.concat("key", step).alias("key"), F.col("item").alias("v"))
    return out


def collapse(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """E-8 (parity, Q13): one value for each last part of a key, the last in order of paths; scalars of lists go."""
    own = leaves.where(~F.col("key").endswith("]"))
    last = F.element_at(F.split(F.regexp_replace("key", r"\[\d+\]", ""), r"\."), -1)
    return own.groupBy(*keys, last.alias("leaf")).agg(F.max(F.struct("key", "value")).alias("m")).select(*keys, F.col("leaf").alias("key"), F.col("m.value").alias("value"))
