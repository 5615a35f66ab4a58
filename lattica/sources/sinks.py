"""Writing results: tables by project, threat lists, diagrams as DOT text and as model documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import while_writing
from ..operators.tour import euler_tour

SHAPES = {"Process": "ellipse", "DataStore": "cylinder", "ExternalEntity": "box"}


def replace_projects(df: DataFrame, path: str) -> None:
    """SK-6: writes df by project; projects that df holds are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path_id").parquet(path)


def write_threats(threats: DataFrame, path: str) -> None:
    """SK-8, H-2. Names repeat in thousands of rows, so the files are packed."""
    with while_writing(threats.sparkSession):
        threats.select("path_id", "threat", "stride", "element", "flow").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def quoted(x):
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(elements: DataFrame, placed: DataFrame, flows: DataFrame) -> DataFrame:
    """SK-9: path_id, part, line of a Graphviz document for each project: part 0 opens it, 1 holds its statements (in any
    order), 2 closes it. Containment is drawn as dashed edges, so that a line needs nothing but its own row."""
    shape = F.create_map(*(F.lit(x) for kv in SHAPES.items() for x in kv))[F.col("kind")]
    node = elements.select("path_id", F.concat(F.lit("n"), F.hex("id"), F.lit(" [label="), quoted(F.col("name")), F.lit(", shape="), F.coalesce(shape, F.lit("folder")), F.lit("];")).alias("line"))
    inside = placed.select("path_id", F.concat(F.lit("n"), F.hex("parent"), F.lit(" -> n"), F.hex("child"), F.lit(" [style=dashed, arrowhead=none];")).alias("line"))
    flow = flows.select("path_id", F.concat(F.lit("n"), F.hex("sender"), F.lit(" -> n"), F.hex("recipient"), F.lit(";")).alias("line"))
    lines = node.unionByName(inside).unionByName(flow).select("path_id", F.lit(1).alias("part"), "line")
    frame = F.array(F.struct(F.lit(0).alias("part"), F.lit("digraph {").alias("line")), F.struct(F.lit(2).alias("part"), F.lit("}").alias("line")))
    return lines.unionByName(elements.select("path_id").distinct().select("path_id", F.inline(frame)))


def write_dot(lines: DataFrame, path: str) -> None:
    """One folder for each project; its files, read in the order of their names, are one document. Projects are dealt by ranges
    of (path_id, part), so a large one may take several files."""
    lines.repartitionByRange("path_id", "part", F.xxhash64("line")).sortWithinPartitions("path_id", "part").drop("part").write.mode("overwrite").partitionBy("path_id").text(path)


def _nested(elements: DataFrame, placed: DataFrame) -> DataFrame:
    """elements' columns with opens, closes and depth in the tour of their project (boundaries by name, then what is in no
    boundary or directly within one)."""
    top = lambda path: F.xxhash64(F.lit("project"), path)
    parent = placed.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"))
    inner = elements.join(parent, "id", "left").select(F.col("id").alias("node"), F.coalesce("parent", top(F.col("path_id"))).alias("parent"), F.concat_ws(" ", F.when(F.col("kind") == "TrustBoundary", "0").otherwise("1"), "name").alias("ord"))
    roots = elements.select("path_id").distinct()
    forest = inner.unionByName(roots.select(top(F.col("path_id")).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("").alias("ord")))
    tour = euler_tour(forest)
    return elements.join(tour.select(F.col("node").alias("id"), "opens", "closes", "depth"), "id")


#: The place of what stands behind all elements: flows, and the end of the document.
LAST = (1 << 63) - 1


def _lines(elements: DataFrame, placed: DataFrame, flows: DataFrame, frame: tuple[str, str], opening, leaf, closing, flow) -> DataFrame:
    laid = _nested(elements, placed)
    wall = F.col("kind") == "TrustBoundary"
    deep = lambda line: F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), line)
    row = lambda at, line, part=0: F.struct(at.cast("long").alias("at"), F.lit(part).alias("part"), line.alias("line"))
    own = F.when(wall, F.array(row(F.col("opens"), deep(opening)), row(F.col("closes"), deep(F.lit(closing))))).otherwise(F.array(row(F.col("opens"), deep(leaf))))
    body = laid.select("path_id", F.inline(own))
    ends = F.array(row(F.lit(0), F.lit(frame[0])), row(F.lit(LAST), F.lit(frame[1]), 2))
    between = flows.select("path_id", F.lit(LAST).alias("at"), F.lit(1).alias("part"), F.concat(F.lit("  "), flow).alias("line"))
    return body.unionByName(elements.select("path_id").distinct().select("path_id", F.inline(ends))).unionByName(between)


def nested_dot(elements: DataFrame, placed: DataFrame, flows: DataFrame) -> DataFrame:
    """SK-9: path_id, at, part, line: a Graphviz document for each project, boundaries as nested clusters. In the order of at, part
    and line it is the document; flows (part 1) come last."""
    shape = F.coalesce(F.create_map(*(F.lit(x) for kv in SHAPES.items() for x in kv))[F.col("kind")], F.lit("folder"))
    opening = F.concat(F.lit('subgraph "cluster_'), F.hex("id"), F.lit('" { label='), quoted(F.col("name")), F.lit(";"))
    leaf = F.concat(F.lit("n"), F.hex("id"), F.lit(" [label="), quoted(F.col("name")), F.lit(", shape="), shape, F.lit("];"))
    return _lines(elements, placed, flows, ("digraph {", "}"), opening, leaf, "}", F.concat(F.lit("n"), F.hex("sender"), F.lit(" -> n"), F.hex("recipient"), F.lit(";")))


def escaped(x):
    """Text for an XML attribute."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def nested_xml(elements: DataFrame, placed: DataFrame, flows: DataFrame) -> DataFrame:
    """SK-7: path_id, at, part, line: a model document for each project, elements within their boundaries."""
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    own = F.concat(attr("id", F.hex("id")), attr("name", escaped(F.col("name"))), F.coalesce(attr("annotation", escaped(F.col("annotation"))), F.lit("")))
    leaf = F.concat(F.lit("<element"), attr("kind", F.col("kind")), own, F.lit("/>"))
    flow = F.concat(F.lit("<flow"), attr("sender", F.hex("sender")), attr("recipient", F.hex("recipient")), F.lit("/>"))
    return _lines(elements, placed, flows, ("<model>", "</model>"), F.concat(F.lit("<boundary"), own, F.lit(">")), leaf, "</boundary>", flow)


def write_nested(lines: DataFrame, path: str) -> None:
    """One folder for each project; its files, read in the order of their names, are one document. Lines are dealt by ranges of
    (path_id, at, part, line), so a large project may take several files and none is gathered."""
    with while_writing(lines.sparkSession):
        lines.repartitionByRange("path_id", "at", "part", "line").sortWithinPartitions("path_id", "at", "part", "line").select("path_id", "line").write.mode("overwrite").partitionBy("path_id").text(path)


def model_rows(elements: DataFrame, placed: DataFrame, flows: DataFrame) -> DataFrame:
    """SK-7: path_id, kind, id, name, annotation, parent, sender, recipient: a diagram's elements and flows as one table."""
    parent = placed.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"))
    e = elements.join(parent, "id", "left").select("path_id", "kind", "id", "name", "annotation", "parent", F.lit(None).cast("long").alias("sender"), F.lit(None).cast("long").alias("recipient"))
    f = flows.select("path_id", F.lit("DataFlow").alias("kind"), F.xxhash64("path_id", "sender", "recipient").alias("id"), F.col("flow").alias("name"), F.lit(None).cast("string").alias("annotation"), F.lit(None).cast("long").alias("parent"), "sender", "recipient")
    return e.unionByName(f)


def write_model(rows: DataFrame, path: str) -> None:
    """SK-7: as XML, one element a row, packed: marks and names make most of it."""
    with while_writing(rows.sparkSession):
        rows.write.mode("overwrite").format("xml").option("rootTag", "model").option("rowTag", "element").option("compression", "gzip").save(path)


def catalog_xml(fanned: DataFrame, path: str) -> None:
    """SK-10: a catalog of fanned-out threats (threats.fan_out) as XML."""
    fanned.write.mode("overwrite").format("xml").option("rootTag", "catalog").option("rowTag", "threat").save(path)
