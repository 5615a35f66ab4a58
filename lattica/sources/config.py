"""Profiles, ownership rules (YAML) and threat catalogs (XML, JSON): dimension tables of tens to hundreds of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.schema import OWN_RULES, PROFILE, config_table


def read_yaml(spark: SparkSession, path: str) -> dict:
    """SC-9: what a YAML file holds; of a folder, its only file."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}


def profile(spark: SparkSession, config: dict) -> DataFrame:
    """D6, SC-10: a profile's sections, groups and members, in their order."""
    rows = []
    for section in ("processes", "boundaries", "data_stores"):
        for group in config.get(section) or []:
            for m in group.get("members") or []:
                rows.append((section, group["group_name"], group.get("annotation"), m["name"], m["tf_name"], bool(m.get("compress")), bool(m.get("can_public")), len(rows)))
    return spark.createDataFrame(rows, PROFILE)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """SC-9."""
    return profile(spark, read_yaml(spark, path))


def external_entities(spark: SparkSession, config: dict) -> DataFrame:
    """D6: name and annotation of a profile's external entities."""
    rows = [(x["name"], x.get("annotation") or x["name"]) if isinstance(x, dict) else (x, x) for x in config.get("external_entities") or []]
    return spark.createDataFrame(rows, "name string, annotation string")


def rules(spark: SparkSession, config: dict) -> DataFrame:
    """D7: ownership rules with their order."""
    own = (config.get("relations") or {}).get("own") or []
    return spark.createDataFrame([(i, x.get("id"), x["first_node"], x["second_node"], x["method"]) for i, x in enumerate(own)], OWN_RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return rules(spark, read_yaml(spark, path))


#: What a threat pattern may say; `w` stands for a name. Statements come in any order and may repeat.
STATEMENTS = {
    "sender": r"DataFlow\.sender\(\s*(\w+)\s*,\s*(\w+)\s*\)",
    "recipient": r"DataFlow\.recipient\(\s*(\w+)\s*,\s*(\w+)\s*\)",
    "annotation": r"ModelElementAnnotation\(\s*(\w+)\s*\)()",
    "value": r"ModelElementAnnotation\.value\(\s*(\w+)\s*,\s*\x22([^\x22]*)\x22\s*\)",
    "annotated": r"(?:Process|DataStore|ExternalEntity)\.annotations\(\s*(\w+)\s*,\s*(\w+)\s*\)",
}
HEAD = r"^\s*pattern\s+\w+\s*\(([^)]*)\)\s*\{(.*)\}\s*$"


def pattern_facts(texts: DataFrame) -> DataFrame:
    """texts: id, text of patterns. One row per fact: id, fact, a, b: 'type' (a name and its type), the keys of STATEMENTS with
    the names or the value that they hold, and 'rest' with what a text says beyond that, if anything; comments are left out."""
    bare = F.regexp_replace("text", r"(?s)(\x22[^\x22]*\x22)|/\*.*?\*/|//[^\n]*", "$1 ")
    body, names = F.regexp_extract(bare, "(?s)" + HEAD, 2), F.regexp_extract(bare, "(?s)" + HEAD, 1)
    t = texts.select("id", body.alias("body"), names.alias("names"), F.rlike(bare, F.lit("(?s)" + HEAD)).alias("whole"), bare.alias("bare"))
    kinds = t.select("id", F.explode(F.split("names", ",")).alias("n")).select("id", F.lit("type").alias("fact"), F.trim(F.substring_index("n", ":", 1)).alias("a"), F.trim(F.substring_index("n", ":", -1)).alias("b"))
    rest = F.col("body")
    for how in STATEMENTS.values():
        rest = F.regexp_replace(rest, how, "")
    rest = F.when(F.col("whole"), F.regexp_replace(rest, r"[\s;]+", "")).otherwise(F.col("bare"))
    out = kinds.unionByName(t.select("id", F.lit("rest").alias("fact"), rest.alias("a"), F.lit(None).cast("string").alias("b")).where("a <> '' OR a IS NULL"))
    for fact, how in STATEMENTS.items():
        both = F.arrays_zip(F.regexp_extract_all("body", F.lit(how), F.lit(1)).alias("a"), F.regexp_extract_all("body", F.lit(how), F.lit(2)).alias("b"))
        out = out.unionByName(t.select("id", F.inline(both)).select("id", F.lit(fact).alias("fact"), "a", "b"))
    return out


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """D12, SC-13: one row per pattern of an XML threat catalog, see PATTERNS.

    A pattern's text is taken apart into facts (`pattern_facts`), which are joined again: which names are the two ends of the
    flow, their types, and the value of the annotation that each must have; without one it is null and fits any. A pattern
    that can't be put this way raises, as it would fit other flows than it says: other statements, not one sender and one
    recipient of one flow, an end without a type or with several annotations, an annotation without one value, a place that
    is neither end. A catalog without patterns gives no rows."""
    shape = "_name string, _description string, threatpattern array<struct<patterns: string, mapping: array<struct<_key: string, _value: string>>>>"
    read = spark.read.format("xml").option("rowTag", "threat").schema(shape).load(path).select("_name", F.posexplode("threatpattern").alias("k", "p"))
    at = F.get(F.filter("p.mapping", lambda m: m["_key"] == "location"), F.lit(0))["_value"]
    p = read.select(F.xxhash64("_name", "k", "p.patterns").alias("id"), "_name", F.col("p.patterns").alias("text"), at.alias("at"))
    facts = pattern_facts(p.select("id", "text").distinct())
    of = lambda *names: F.filter("facts", lambda x: x["fact"].isin(*names))
    one = p.join(facts.groupBy("id").agg(F.collect_set(F.struct("fact", "a", "b")).alias("facts")), "id", "left")

    def pick(fact: str, key: Column, field: str) -> Column:
        """The field of the only fact of this kind about key; null if there is none or there are several."""
        found = F.filter(of(fact), lambda x: x["a"] == key)
        return F.when(F.size(found) == 1, F.get(found, F.lit(0))[field])

    only = lambda fact, field: F.when(F.size(of(fact)) == 1, F.get(of(fact), F.lit(0))[field])
    one = one.withColumns({"s": only("sender", "b"), "r": only("recipient", "b"), "flow": only("sender", "a"), "same": only("sender", "a") == only("recipient", "a")})
    notes = lambda who: F.filter(of("annotated"), lambda x: x["a"] == who)
    for end in ("s", "r"):
        own = notes(F.col(end))
        one = one.withColumns({f"{end}_type": pick("type", F.col(end), "b"), f"{end}_n": F.size(own), f"{end}_note": F.get(own, F.lit(0))["b"]})
        one = one.withColumn(f"{end}_anno", pick("value", F.col(f"{end}_note"), "b"))
    loose = F.size(F.filter(of("annotated"), lambda x: ~x["a"].isin(F.col("s"), F.col("r")))) > 0
    fine = F.col("same") & (pick("type", F.col("flow"), "b") == "DataFlow") & (F.size(of("rest")) == 0) & ~loose & (F.col("s") != F.col("r")) & F.col("at").isin(F.col("s"), F.col("r"))
    for end in ("s", "r"):
        fine = fine & F.col(f"{end}_type").isNotNull() & (F.col(f"{end}_n") <= 1) & ((F.col(f"{end}_n") == 0) | F.col(f"{end}_anno").isNotNull())
    one = config_table(one.withColumn("fine", F.coalesce(fine, F.lit(False))))
    wrong = [r[0] for r in one.where("NOT fine").select("_name").distinct().sort("_name").limit(5).collect()]
    if wrong:
        raise ValueError(f"patterns that say more than ends, annotations and a place, in {wrong}")
    place = F.when(F.col("at") == F.col("s"), "sender").otherwise("recipient")
    return one.select(F.col("_name").alias("threat"), F.trim(F.substring_index("_name", ":", 1)).alias("stride"), F.col("s_type").alias("sender_type"), F.col("s_anno").alias("sender_anno"), F.col("r_type").alias("recipient_type"), F.col("r_anno").alias("recipient_anno"), place.alias("location_end"))


def read_threat_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """D13, SC-14: id, name, problem, aggressors, victims, stride of JSON threat documents, one a file or one a line."""
    shape = "id string, metadata struct<`ns:textName`: string, `ns:textReviewProblem`: string>, context struct<`ns:hasAffectedComponent`: array<string>>, security struct<`ns:hasAggressor`: array<string>, `ns:hasSTRIDE`: array<string>>"
    d = spark.read.option("multiLine", not lines).schema(shape).json(path)
    bare = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"^\w+:(comp_|STRIDE_)?", ""))
    return d.select("id", F.col("metadata.`ns:textName`").alias("name"), F.col("metadata.`ns:textReviewProblem`").alias("problem"), bare(F.col("security.`ns:hasAggressor`")).alias("aggressors"), bare(F.col("context.`ns:hasAffectedComponent`")).alias("victims"), bare(F.col("security.`ns:hasSTRIDE`")).alias("stride"))


def read_findings(spark: SparkSession, path: str, variables: list[str] | None = None, lines: bool = False) -> DataFrame:
    """SC-11: path_id (of the folder of the file that a finding is in), variable, value, once each: what a pattern scanner's
    JSON results (results[].path, results[].extra.metavars) bind to the given variables, or to all. lines: a result a line."""
    shape = "results array<struct<path: string, extra: struct<metavars: map<string, struct<abstract_content: string>>>>>"
    each = spark.read.option("multiLine", not lines).schema(shape).json(path).select(F.explode("results").alias("r")).select("r.path", F.explode("r.extra.metavars").alias("variable", "m"))
    own = each if variables is None else each.where(F.col("variable").isin(*variables))
    return own.select(T.path_id(F.regexp_replace("path", "/[^/]*$", "")).alias("path_id"), "variable", F.col("m.abstract_content").alias("value")).where("value IS NOT NULL").distinct()
