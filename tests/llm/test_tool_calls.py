import json
import random

from pyspark.sql import functions as F

from lattica.llm import queries, tool_calls

TOOLS = {
    "add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number", "maximum": 10}}, "required": ["a"], "additionalProperties": False},
    "say": {"properties": {"text": {"type": "string", "maxLength": 5}, "tone": {"enum": ["calm", "loud"]}, "tags": {"type": "array"}, "more": {"type": "object"}, "on": {"type": "boolean"}}},
}
CALL = "conv_id long, turn long, call_id string, after_ids array<string>, name string, arguments string"
RESULT = "conv_id long, turn long, call_id string, content string"


def link(spark, calls, results):
    return {x["call_id"]: x for x in tool_calls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), TOOLS).collect()}


def test_levels_cycles_and_orphans(spark):
    chain = [(1, i, f"c{i}", [f"c{i - 1}"] if i else None, "add", '{"a": 1}') for i in range(40)]
    cycle = [(2, 0, "x", ["y"], "add", '{"a": 1}'), (2, 1, "y", ["x"], "add", '{"a": 1}'), (2, 2, "z", ["y"], "add", '{"a": 1}'), (2, 3, "w", ["gone", None], "add", '{"a": 1}')]
    got = link(spark, chain + cycle, [(1, 50, "c3", "r"), (1, 51, "nobody", "lost"), (1, 52, "c4", None)])
    assert all(got[f"c{i}"]["level"] == i for i in range(40))
    assert [got[k]["error"] for k in "xyzw"] == ["cycle", "cycle", "cycle", None] and got["w"]["level"] == 0
    assert got["nobody"]["status"] == "orphan" and got["c3"]["status"] == "linked" and got["c4"]["status"] == "linked" and got["c5"]["status"] == "unanswered"


def test_equal_identifiers_in_two_conversations(spark):
    calls = [(c, 0, "call_1", None, "add", f'{{"a": {c}}}') for c in (1, 2)] + [(2, 1, "call_2", ["call_1"], "add", '{"a": 3}'), (3, 0, "call_2", ["call_1"], "add", '{"a": 4}')]
    rows = tool_calls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame([(1, 5, "call_1", "one"), (2, 5, "call_1", "two")], RESULT), TOOLS).collect()
    assert sorted((x["conv_id"], x["call_id"], x["level"], json.loads(x["record"])["result"]) for x in rows if x["status"] == "linked") == [(1, "call_1", 0, "one"), (2, "call_1", 0, "two")]
    assert sorted((x["conv_id"], x["call_id"], x["level"]) for x in rows if x["status"] == "unanswered") == [(2, "call_2", 1), (3, "call_2", 0)]


def test_levels_of_random_graphs(spark):
    """Several calls before one, repeated links, cycles: against the longest path found by plain recursion."""
    r = random.Random(3)
    rows = []
    for conv in range(30):
        for i in range(r.randint(1, 24)):
            before = [f"c{r.randrange(i - 4, i)}" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] if i else []
            if conv % 3 == 0 and r.random() < 0.2:
                before.append(f"c{r.randrange(i, i + 3)}")
            rows.append((conv, i, f"c{i}", before, "add", '{"a": 1}'))
    before = {(c, k): [(c, x) for x in a] for c, _, k, a, _, _ in rows}

    def level(x, seen=()):
        if x in seen:
            return None
        found = [level(y, (*seen, x)) for y in before[x] if y in before]
        return None if None in found else max([y + 1 for y in found], default=0)

    got = tool_calls.link(spark.createDataFrame(rows, CALL), spark.createDataFrame([], RESULT), TOOLS).collect()
    want = {x: level(x) for x in before}
    assert None in want.values() and max(x or 0 for x in want.values()) > 4
    assert {(x["conv_id"], x["call_id"]): x["level"] for x in got} == want


def test_arguments_against_schemas(spark):
    cases = {
        '{"a": 1, "b": 2.5}': None,
        '{"a": -1}': "a breaks minimum",
        '{"b": 2}': "a is missing",
        '{"a": null}': "a is missing",
        '{"a": "1"}': "a is not of type integer",
        '{"a": 1, "b": 11}': "b breaks maximum",
        '{"a": 1, "c": 2}': "unknown argument",
        "[1]": "not an object",
        "{broken": "not JSON",
        "": "not JSON",
    }
    got = link(spark, [(1, i, str(i), None, "add", a) for i, a in enumerate(cases)] + [(1, 99, "99", None, "add", None)], [])
    assert [got[str(i)]["error"] for i in range(len(cases))] == list(cases.values()) and got["99"]["error"] == "not JSON"
    says = ['{"text": "short", "tone": "calm", "tags": [], "more": {}, "on": true}', '{"text": "too long"}', '{"tone": "odd"}', '{"tags": {}}', '{"more": 1}', '{"on": 1}', '{"other": 1}']
    got = link(spark, [(1, i, str(i), None, "say", a) for i, a in enumerate(says)] + [(1, 9, "9", None, "nothing", "{}")], [])
    assert [got[str(i)]["error"] for i in range(len(says))] == [None, "text breaks maxLength", "tone breaks enum", "tags is not of type array", "more is not of type object", "on is not of type boolean", None]
    assert got["9"]["error"] == "unknown tool" and not got["9"]["valid"]


def test_records_are_canonical(spark):
    got = link(spark, [(1, 0, "k", None, "add", '{ "b" : 2, "a": 1 }')], [(1, 1, "k", 'line\n"quoted" é')])
    record = got["k"]["record"]
    assert record == json.dumps(json.loads(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(record) == {"arguments": {"a": 1, "b": 2}, "id": "k", "level": 0, "name": "add", "result": 'line\n"quoted" é'}


def test_repeats_nulls_and_empty(spark):
    calls = [(1, 5, "k", None, "add", '{"a": 5}'), (1, 2, "k", None, "add", '{"a": 2}'), (None, None, None, None, "add", "{}")]
    results = [(1, 7, "k", "late"), (1, 6, "k", "early"), (None, 1, None, "x")]
    rows = tool_calls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), TOOLS).collect()
    k = next(x for x in rows if x["call_id"] == "k")
    assert (k["turn"], k["copies"], k["n_results"], json.loads(k["record"])["result"]) == (2, 2, 2, "early")
    assert sorted(x["status"] for x in rows) == ["linked", "no id", "no id"] and len(rows) == 3
    none = spark.createDataFrame([], CALL)
    assert tool_calls.link(none, spark.createDataFrame([], RESULT), TOOLS).count() == 0


def test_json_traffic(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": '{"a": 1}'}, {"id": "b", "after": ["a"], "name": "say", "arguments": "{}"}]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "2"})), (1, 3, "assistant", "no json"), (1, 4, "assistant", None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["call_id"]: x for x in tool_calls.link(*tool_calls.json_traffic(m), TOOLS).collect()}
    assert {k: (x["status"], x["level"], x["valid"]) for k, x in got.items()} == {"a": ("linked", 0, True), "b": ("unanswered", 1, True)}


def test_query_on_odd_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", ""), (1, 2, "user", ""), (1, 5, "assistant", "alone"), (2, 0, "user", None), (None, 0, "user", "x"), (3, None, "assistant", "y"), (4, 0, "system", "s"), (5, 0, "user", "long " * 50_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(7)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op4_tool_call_linking"](spark, str(tmp_path)).collect()
    assert sorted(x["status"] for x in got) == sorted(["linked", "unanswered", "unanswered", "unanswered", "orphan", "no id", "no id"])
    by = {x["call_id"]: x for x in got if x["call_id"]}
    assert by["1:2"]["copies"] == 2 and by["1:2"]["level"] == 1 and by["1:2"]["error"] == "prompt breaks minLength" and by["2:0"]["error"] == "prompt is missing" and by["5:0"]["valid"]
