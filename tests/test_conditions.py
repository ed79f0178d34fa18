"""The condition language: golden rows per operator and random trees against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sentryspark.functions.fields import double_text, parse_number, with_property_map
from sentryspark.functions.json_containment import json_contains
from sentryspark.functions.predicates import ConditionError, parse_condition, predicate
from sentryspark.operators.rules import prepare_events
from sentryspark.sources.catalog import Rule

PROPERTIES = '{"b":true,"c":"true","n":null,"d":1.0,"a":{"b":1},"a.b":2,"q":"it\'s \\\\ ok"}'


def field(name, operator, value):
    return {"type": "field", "field": name, "operator": operator, "value": value}


@pytest.fixture(scope="module")
def one_event(spark):
    row = {
        "event_type": "tool_invocation", "agent_id": "a1", "tool_name": "Web_Search",
        "input_tokens": 500, "latency_ms": 500.0, "properties": PROPERTIES, "session_id": "s1",
    }
    shape = ("event_type STRING, agent_id STRING, tool_name STRING, input_tokens INT, "
             "latency_ms DOUBLE, properties STRING, session_id STRING, model_id STRING")
    frame = spark.createDataFrame([{**row, "model_id": None}], shape)
    return with_property_map(frame)


CASES = [
    (field("modelId", "Eq", "x"), False),
    (field("modelId", "Neq", "x"), False),
    (field("modelId", "Gt", 1), False),
    ({"type": "any_of", "field": "modelId", "values": ["x"]}, False),
    ({"type": "not", "inner": field("modelId", "Eq", "x")}, True),
    ({"type": "list", "field": "modelId", "listId": "l", "negated": True}, True),
    ({"type": "list", "field": "modelId", "listId": "l"}, False),
    ({"type": "exists", "field": "modelId"}, False),
    (field("toolName", "Gt", 1), False),
    (field("toolName", "Eq", "web_search"), False),
    (field("toolName", "Contains", "B_SEA"), True),
    (field("toolName", "StartsWith", "WEB"), True),
    (field("toolName", "EndsWith", "SEARCH"), True),
    (field("toolName", "Regex", "^web"), False),
    (field("toolName", "Regex", "b_S"), True),
    (field("latencyMs", "Eq", 500), True),
    (field("latencyMs", "Eq", "500.0"), False),
    (field("inputTokens", "Gte", 500), True),
    (field("inputTokens", "Lt", 500), False),
    ({"type": "threshold", "field": "latencyMs", "limit": 500}, False),
    ({"type": "threshold", "field": "latencyMs", "limit": 500.5, "above": False}, True),
    (field("properties.b", "Eq", True), True),
    (field("properties.b", "Eq", "True"), True),
    (field("properties.c", "Eq", True), False),
    (field("properties.c", "Eq", "true"), True),
    ({"type": "exists", "field": "properties.n"}, True),
    (field("n", "Eq", None), True),
    (field("d", "Eq", 1), False),
    ({"type": "any_of", "field": "d", "values": [1.0]}, True),
    (field("properties.a.b", "Gte", 2), True),
    (field("properties.q", "Eq", "it's \\ ok"), True),
    ({"type": "exists", "field": "timestamp"}, False),
    ({"type": "and", "conditions": []}, True),
    ({"type": "or", "conditions": []}, False),
]


def test_each_operator(one_event):
    tests = [predicate(parse_condition(json.dumps(tree))).alias(f"c{i}")
             for i, (tree, _) in enumerate(CASES)]
    found = one_event.select(*tests).first()
    wrong = [tree for i, (tree, wanted) in enumerate(CASES) if found[i] is not wanted]
    assert wrong == []


@pytest.mark.parametrize("text, message", [
    ('{"field":"x"}', "'type'"), ('{"type":"zz"}', "Unknown condition type: zz"),
    ('{"type":"field","field":"x","operator":"Like","value":1}', "Unknown operator: Like"),
    ('{"type":"field","field":"x","value":1}', "'operator'"),
    ('{"type":"field","field":"x","operator":"Contains","value":1}', "needs a text value"),
    ('{"type":"field","field":"x","operator":"Gt","value":"1"}', "needs a number"),
    ('{"type":"and"}', "'conditions'"), ('{"type":"not"}', "'inner'"),
    ('{"type":"threshold","field":"x"}', "'limit'"), ("nope", "not valid JSON"),
])
def test_malformed_conditions_name_their_fault(text, message):
    with pytest.raises(ConditionError, match=message):
        parse_condition(text)


def test_number_and_text_forms(spark):
    texts = {"1d": None, " 2 ": 2.0, "1e3": 1000.0, ".5": 0.5, "-1.": -1.0, "": None, "0x1": None,
             "-Infinity": float("-inf"), "1,000": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert {r[0]: r[1] for r in rows.select("t", parse_number("t")).collect()} == texts
    doubles = {500.0: "500", 1.5e8: "150000000", 0.1: "0.1", 1e-4: "0.0001", 1.5e-4: "0.00015", 1e-5: "1E-05", 5e-5: "5E-05", 1e-6: "1E-06",
               1e15: "1E+15", 1.25e17: "1.25E+17", -2.5e9: "-2500000000"}
    rows = spark.createDataFrame([(d,) for d in doubles], "d DOUBLE")
    assert {r[0]: r[1] for r in rows.select("d", F.expr(double_text("d"))).collect()} == doubles


@pytest.mark.parametrize("size", [3, 1_005])
def test_lists_inline_and_joined(spark, make_events, size):
    events = make_events({"tool_name": "t1"}, {"tool_name": "t-none"}, {"tool_name": None})
    members = spark.createDataFrame([("l", f"t{i}") for i in range(size)],
                                    "list_id STRING, value STRING")
    trees = [{"type": "list", "field": "toolName", "listId": name, "negated": negated}
             for name in ("l", "unknown") for negated in (False, True)]
    rules = [Rule(str(i), "r", "low", "SingleEvent", t) for i, t in enumerate(trees)]
    prepared, member = prepare_events(events, rules, members)
    tests = [predicate(tree, member).alias(f"c{i}") for i, tree in enumerate(trees)]
    got = [tuple(r) for r in prepared.orderBy("event_id").select(*tests).collect()]
    assert got == [(True, False, False, True), (False, True, False, True),
                   (False, True, False, True)]


@pytest.mark.parametrize("pattern, wanted", [
    ('{"b":true}', True), ('{"c":true}', False), ('{"d":1}', True), ('{"a":{"b":1}}', True),
    ('{"a":{}}', True), ('{"l":[{"x":"y"}]}', True), ('{"l":[3]}', False), ('{"l":[[3]]}', True),
    ('{"n":null}', True), ('{"z":null}', False), ("{}", True), ("[]", False),
    ('{"l":[{"x":"z"}]}', False), ('{"l":[1,1]}', True), ('"x"', False),
])
def test_json_containment(spark, pattern, wanted):
    text = '{"b":true,"c":"true","n":null,"d":1.0,"a":{"b":1},"l":[1,{"x":"y","w":2},[3,4]]}'
    frame = spark.createDataFrame([(text,), ("not json",), (None,)], "t STRING")
    got = [r[0] for r in frame.select(json_contains(F.col("t"), pattern)).collect()]
    assert got == [wanted, False, False]


def naive(tree, event):
    """Plain evaluation of a tree over a dict of texts and numbers."""
    kind = tree["type"]
    if kind == "and":
        return all(naive(t, event) for t in tree["conditions"])
    if kind == "or":
        return any(naive(t, event) for t in tree["conditions"])
    if kind == "not":
        return not naive(tree["inner"], event)
    value = event.get(tree["field"])
    if value is None:
        return False
    if kind == "exists":
        return True
    if kind == "any_of":
        return str(value) in map(str, tree["values"])
    if kind == "threshold":
        if isinstance(value, str):
            return False
        return value > tree["limit"] if tree["above"] else value < tree["limit"]
    text, target = str(value).lower(), str(tree["value"]).lower()
    return {
        "Eq": str(value) == str(tree["value"]), "Neq": str(value) != str(tree["value"]),
        "Contains": target in text, "StartsWith": text.startswith(target),
        "EndsWith": text.endswith(target),
    }[tree["operator"]]


def random_tree(rng, depth):
    if depth and rng.random() < 0.6:
        kind = rng.choice(["and", "or", "not"])
        if kind == "not":
            return {"type": "not", "inner": random_tree(rng, depth - 1)}
        parts = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))]
        return {"type": kind, "conditions": parts}
    name = rng.choice(["toolName", "modelId", "inputTokens", "eventType"])
    kind = rng.choice(["field", "threshold", "exists", "any_of"])
    if kind == "field":
        return field(name, rng.choice(["Eq", "Neq", "Contains", "StartsWith", "EndsWith"]),
                     rng.choice(["web", "WEB_search", "gpt-4", "call", "7"]))
    extra = {"threshold": {"limit": rng.randrange(10), "above": rng.random() < 0.5},
             "exists": {}, "any_of": {"values": rng.sample(["web_search", "gpt-4", "7", 7], 2)}}
    return {"type": kind, "field": name, **extra[kind]}


def test_random_trees_match_plain_evaluation(make_events):
    rng = random.Random(7)
    events = [
        {"tool_name": rng.choice([None, "web_search", "call"]), "input_tokens": rng.choice([None, 7, 3]),
         "model_id": rng.choice([None, "gpt-4", "GPT-4-turbo"]), "event_type": "llm_call"}
        for _ in range(20)
    ]
    trees = [random_tree(rng, 3) for _ in range(40)]
    tests = [predicate(parse_condition(json.dumps(t))).alias(f"c{i}") for i, t in enumerate(trees)]
    rows = make_events(*events).orderBy("event_id").select(*tests).collect()
    for row, event in zip(rows, events):
        view = {"toolName": event["tool_name"], "modelId": event["model_id"],
                "inputTokens": event["input_tokens"], "eventType": event["event_type"]}
        assert list(row) == [naive(tree, view) for tree in trees]
