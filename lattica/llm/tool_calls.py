"""Linking tool calls with their results; built-in functions only.

Calls and results are hash-joined by conversation and identifier, so equal identifiers in several conversations are
apart. Each call may name calls of its conversation it comes after; its level is one more than the highest of theirs.
Levels are found in two steps. Calls after a single one point along the chain to the nearest call that has none or
several before it, by pointer doubling (each round jumps twice as far, so a chain of n calls takes log2(n) rounds and no
conversation is ever gathered). Calls after several then take the highest of what they point to, round by round, as many
rounds as such calls stand one behind the other. Arguments are parsed as VARIANT and checked against JSON-schema-like
rules; the record of each call is canonical JSON: keys sorted, no spaces.

Traffic comes from messages in one of two forms: JSON messages as chat services write them (`json_traffic`), or plain
dialogue (`dialogue_traffic`), where a user turn is a call of the tool `reply` and the assistant turn that follows is
its result.

Defined results:
    null conversation or turn   no identifier: status 'no id', not linked, level null
    null or empty text          a call with a null or empty prompt, which the schema of `reply` refuses; a null result
                                counts as a result
    very long texts             whole, up to what a VARIANT holds (128 MB); beyond that the arguments are 'not JSON'
    ties, repeated rows         of calls with one identifier in a conversation the least (turn, name, arguments) counts, of
                                results the least (turn, content); `copies` and `n_results` tell how many there were
    cycles, links into cycles   level null, error 'cycle'
    links to unknown calls      ignored; a call with no other link is a root
    results without a call      a row with status 'orphan'
    empty table                 empty result
    further columns             ignored
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise

#: The tool that plain dialogue is read as calling.
REPLY = {"reply": {"properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}}


def dialogue_traffic(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of conv_id, turn, role, text."""
    at = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    named = lambda back: F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), at(back))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")), {"ignoreNullFields": "false"})
    calls = messages.where("role = 'user'").select("conv_id", "turn", named(0).alias("call_id"), F.array(named(2)).alias("after_ids"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", named(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def json_traffic(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages whose text is JSON: tool_calls of assistants (`after`: the ids of the calls that one comes
    after), tool_call_id and content of tools. Without a conversation there is no identifier."""
    kind = "tool_calls array<struct<id:string,after:array<string>,name:string,arguments:string>>, tool_call_id string, content string"
    read = messages.select("conv_id", "turn", "role", F.from_json("text", kind).alias("m"))
    own = lambda c: F.when(F.col("conv_id").isNotNull(), F.col(c)).alias("call_id")
    calls = read.where("role = 'assistant'").select("conv_id", "turn", F.explode("m.tool_calls").alias("c"))
    calls = calls.select("conv_id", "turn", own("c.id"), F.col("c.after").alias("after_ids"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    results = read.where("role = 'tool' AND m.tool_call_id IS NOT NULL").select("conv_id", "turn", own("m.tool_call_id"), F.col("m.content").alias("content"))
    return calls, results


def _one_error(name: str, rules: dict, v: Column) -> Column:
    """The first rule that parsed arguments v break, or null."""

    def of(arg: str) -> Column:
        return F.try_variant_get(v, f'$["{arg}"]', "variant")

    tests: list[tuple[Column, str]] = [(v.isNull(), "not JSON"), (~F.schema_of_variant(v).startswith("OBJECT"), "not an object")]
    for arg in rules.get("required", []):
        tests.append((of(arg).isNull() | F.is_variant_null(of(arg)), f"{arg} is missing"))
    for arg, rule in sorted(rules.get("properties", {}).items()):
        there = of(arg).isNotNull() & ~F.is_variant_null(of(arg))
        kind = F.schema_of_variant(of(arg))
        same = {"string": kind == "STRING", "integer": kind == "BIGINT", "number": kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "boolean": kind == "BOOLEAN", "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT")}
        if "type" in rule:
            tests.append((there & ~same[rule["type"]], f"{arg} is not of type {rule['type']}"))
        text, number = F.try_variant_get(v, f'$["{arg}"]', "string"), F.try_variant_get(v, f'$["{arg}"]', "double")
        for key, bad in (("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x), ("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("enum", lambda x: ~text.isin(*map(str, x)))):
            if key in rule:
                tests.append((there & bad(rule[key]), f"{arg} breaks {key}"))
    if rules.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        tests.append((F.size(F.array_except(keys, F.array(*map(F.lit, rules.get("properties", {}))).cast("array<string>"))) > 0, "unknown argument"))
    out = F.lit(None).cast("string")
    for bad, what in reversed(tests):
        out = F.when(bad, what).otherwise(out)
    return out


def argument_error(name: Column, v: Column, schemas: dict) -> Column:
    out = F.lit("unknown tool")
    for tool, rules in sorted(schemas.items()):
        out = F.when(name == tool, _one_error(tool, rules, v)).otherwise(out)
    return out


ID = ["conv_id", "call_id"]


def _named(df: DataFrame, call: str, *others: str) -> DataFrame:
    """conv_id, call_id renamed, others."""
    return df.select("conv_id", F.col("call_id").alias(call), *others)


def chains(single: DataFrame) -> DataFrame:
    """single: conv_id, call_id, at (the one call before it), unique. The nearest call before each that is not in single (at)
    and the steps to it (d); at null in and behind cycles."""
    more = lambda df: df.join(_named(single, "at", F.lit(True).alias("open")), ["conv_id", "at"], "left").select(*ID, "at", "d", F.coalesce("open", F.lit(False)).alias("open"))
    state = materialise(more(single.withColumn("d", F.lit(1).cast("long"))))
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if state.where("open").isEmpty():
            break
        there = _named(state, "at", F.col("at").alias("next"), F.col("d").alias("more"), F.col("open").alias("still"))
        went = state.join(there, ["conv_id", "at"], "left")
        further = materialise(went.select(*ID, F.coalesce("next", "at").alias("at"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.coalesce("still", F.lit(False)).alias("open")))
        drop(state)
        state = further
    return state.select(*ID, F.when(~F.col("open"), F.col("at")).alias("at"), "d")


def joined(several: DataFrame) -> DataFrame:
    """several: conv_id, call_id, at, d, start: links to calls d steps back, at level 0 (start true) or themselves among the
    call_ids here (at null: behind a cycle). conv_id, call_id, level of those that no cycle is before."""
    done = None
    rest = materialise(several.select(*ID, F.when(~F.col("start"), F.col("at")).alias("at"), (~F.col("start") | F.col("at").isNull()).alias("waits"), "d"))
    while True:
        ready = materialise(rest.groupBy(*ID).agg(F.bool_or("waits").alias("waits"), F.max("d").alias("level")).where("NOT waits").select(*ID, "level"))
        if ready.isEmpty():
            drop(rest)
            break
        done = ready if done is None else done.union(ready)
        left = rest.join(ready, ID, "left_anti").join(_named(ready, "at", "level"), ["conv_id", "at"], "left")
        further = materialise(left.select(*ID, "at", (F.col("waits") & F.col("level").isNull()).alias("waits"), (F.col("d") + F.coalesce(F.when(F.col("waits"), F.col("level")), F.lit(0))).alias("d")))
        drop(rest)
        rest = further
    return ready if done is None else done


def levels(links: DataFrame) -> DataFrame:
    """links: conv_id, call_id (unique together, not null), after_ids. conv_id, call_id, level; null in and behind cycles."""
    asked = links.select(*ID, F.explode("after_ids").alias("at")).distinct()
    edges = materialise(asked.join(_named(links, "at"), ["conv_id", "at"], "left_semi").select(*ID, "at"))
    count = materialise(edges.groupBy(*ID).agg(F.count("*").alias("k"), F.min("at").alias("at")))
    single = count.where("k = 1").select(*ID, "at")
    back = materialise(chains(single))
    deep = None
    if not count.where("k > 1").isEmpty():
        behind = edges.join(count.where("k > 1").select(*ID), ID, "left_semi").join(_named(back, "at", F.col("at").alias("far"), "d", F.lit(True).alias("chained")), ["conv_id", "at"], "left")
        ends = behind.select(*ID, F.when(F.col("chained"), F.col("far")).otherwise(F.col("at")).alias("at"), (F.coalesce("d", F.lit(0)) + 1).alias("d"))
        several = ends.join(_named(count.where("k > 1"), "at", F.lit(True).alias("joins")), ["conv_id", "at"], "left").select(*ID, "at", "d", (F.col("at").isNotNull() & F.col("joins").isNull()).alias("start"))
        deep = joined(several)
    found = back.withColumn("anchor", F.col("at"))
    if deep is None:
        up = found.select(*ID, F.when(F.col("anchor").isNotNull(), F.col("d")).alias("level"))
    else:
        up = found.join(_named(count.where("k > 1"), "at", F.lit(True).alias("joins")), ["conv_id", "at"], "left").join(_named(deep, "at", "level"), ["conv_id", "at"], "left")
        up = up.select(*ID, F.when(F.col("anchor").isNotNull(), F.col("d") + F.when(F.col("joins"), F.col("level")).otherwise(F.lit(0))).alias("level")).union(count.where("k > 1").join(deep, ID, "left").select(*ID, "level"))
    return links.select(*ID).join(count.select(*ID, F.lit(True).alias("after")), ID, "left").join(up, ID, "left").select(*ID, F.when(F.col("after"), F.col("level")).otherwise(F.lit(0)).cast("long").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """calls: conv_id, turn, call_id, after_ids, name, arguments; results: conv_id, turn, call_id, content.
    conv_id, call_id, turn, status, level, copies, n_results, valid, error, record (canonical JSON)."""
    known = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    one = materialise(calls.where(known).groupBy(*ID).agg(F.min(F.struct("turn", "name", "arguments", "after_ids")).alias("c"), F.count("*").alias("copies")).select(*ID, "c.*", "copies"))
    answers = results.where(known).groupBy(*ID).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    linked = one.join(levels(one.select(*ID, "after_ids")), ID).join(answers, ID, "left")
    orphans = answers.join(one, ID, "left_anti").select(*ID, F.col("r.turn").alias("turn"), "n_results", F.col("r.content").alias("content"))
    nameless = calls.where(~known).select("conv_id", "turn", "name", "arguments")
    rows = (
        linked.withColumn("content", F.col("r.content"))
        .withColumn("status", F.when(F.col("n_results").isNull(), "unanswered").otherwise("linked"))
        .drop("r", "after_ids")
        .unionByName(orphans.withColumn("status", F.lit("orphan")), allowMissingColumns=True)
        .unionByName(nameless.withColumn("status", F.lit("no id")), allowMissingColumns=True)
        .unionByName(results.where(~known).select("conv_id", "turn", "content", F.lit("no id").alias("status")), allowMissingColumns=True)
    )
    v = F.try_parse_json("arguments")
    rows = rows.withColumn("v", v)
    wrong = F.when(F.col("name").isNull(), F.lit(None)).when((F.col("status").isin("linked", "unanswered")) & F.col("level").isNull(), "cycle").otherwise(argument_error(F.col("name"), F.col("v"), schemas))
    record = F.to_json(F.struct(F.col("v").alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return rows.withColumn("error", wrong).select(
        "conv_id", "call_id", "turn", "status", "level", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("n_results", F.lit(0)).alias("n_results"), (F.col("name").isNotNull() & F.col("error").isNull()).alias("valid"), "error", record.alias("record")
    )
