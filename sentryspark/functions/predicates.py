"""Condition trees (JSON) to boolean SQL expressions.

Every leaf is two-valued: an absent field is false, so ``not`` of it is true. Errors in
a tree surface when the rule is loaded, never while rows are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sentryspark.functions.fields import (
    FieldValue, property_key, resolve_field, sql_string,
)

# Comparison operators of a field condition.
TEXT_OPERATORS = ["Eq", "Neq"]
PATTERN_OPERATORS = ["Contains", "StartsWith", "EndsWith", "Regex"]
ORDER_OPERATORS = ["Gt", "Lt", "Gte", "Lte"]

# Error texts that clients of the rule catalog know.
MISSING_PROPERTY = "Missing required property '{}' in condition: {}"
UNKNOWN_TYPE = "Unknown condition type: {}"
UNKNOWN_OPERATOR = "Unknown operator: {}"

Membership = Callable[[str, str, FieldValue], str]


class ConditionError(ValueError):
    """The condition tree is not well formed."""


class RawNumber(float):
    """A JSON number that remembers how it was written."""

    def __new__(cls, text: str):
        value = super().__new__(cls, text)
        value.raw = text
        return value


def parse_condition(text: str) -> dict:
    """Decode condition JSON, keeping raw number text; raises ConditionError."""
    try:
        tree = json.loads(text, parse_float=RawNumber, parse_int=RawNumber)
    except (TypeError, ValueError) as error:
        raise ConditionError(f"Condition is not valid JSON: {error}") from error
    check_condition(tree)
    return tree


def required(node: dict, name: str, kind: type | tuple | None = None):
    if not isinstance(node, dict):
        raise ConditionError(f"Condition must be an object, got: {json.dumps(node)}")
    if name not in node:
        raise ConditionError(MISSING_PROPERTY.format(name, json.dumps(node)))
    value = node[name]
    if kind is not None and not isinstance(value, kind):
        raise ConditionError(f"Property '{name}' has the wrong type: {json.dumps(node)}")
    return value


def check_condition(node: dict) -> None:
    """Raise ConditionError naming the missing key, unknown type or bad target."""
    kind = required(node, "type")
    if kind in ("and", "or"):
        for child in required(node, "conditions", list):
            check_condition(child)
    elif kind == "not":
        check_condition(required(node, "inner"))
    elif kind == "field":
        check_field(node)
    elif kind == "threshold":
        required(node, "field", str)
        required(node, "limit", (int, float))
        if not isinstance(node.get("above", True), bool):
            raise ConditionError(f"Property 'above' has the wrong type: {json.dumps(node)}")
    elif kind == "list":
        required(node, "field", str)
        required(node, "listId", str)
        if not isinstance(node.get("negated", False), bool):
            raise ConditionError(f"Property 'negated' has the wrong type: {json.dumps(node)}")
    elif kind == "exists":
        required(node, "field", str)
    elif kind == "any_of":
        required(node, "field", str)
        required(node, "values", list)
    else:
        raise ConditionError(UNKNOWN_TYPE.format(kind))


def check_field(node: dict) -> None:
    required(node, "field", str)
    name = required(node, "operator", str)
    value = required(node, "value")
    if name in PATTERN_OPERATORS:
        if not isinstance(value, str):
            raise ConditionError(f"Operator {name} needs a text value: {json.dumps(node)}")
    elif name in ORDER_OPERATORS:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ConditionError(f"Operator {name} needs a number: {json.dumps(node)}")
    elif name not in TEXT_OPERATORS:
        raise ConditionError(UNKNOWN_OPERATOR.format(name))


def leaves(node: dict) -> Iterator[dict]:
    """All leaf conditions of a tree."""
    if node["type"] in ("and", "or"):
        for child in node["conditions"]:
            yield from leaves(child)
    elif node["type"] == "not":
        yield from leaves(node["inner"])
    else:
        yield node


def uses_properties(node: dict) -> bool:
    return any(property_key(leaf["field"]) is not None for leaf in leaves(node))


def check_patterns(spark: SparkSession, node: dict) -> None:
    """Reject regular expressions that Spark's dialect (Java's) cannot compile."""
    for leaf in leaves(node):
        if leaf["type"] == "field" and leaf["operator"] == "Regex":
            try:
                spark._jvm.java.util.regex.Pattern.compile(leaf["value"])
            except IllegalArgumentException as error:
                raise ConditionError(f"Unsupported pattern: {leaf['value']}") from error


def literal_text(value) -> str:
    """Text of a JSON literal under the same rules as field texts."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, RawNumber):
        return value.raw
    if isinstance(value, (dict, list)):
        return json.dumps(value, separators=(",", ":"))
    return str(value)


def no_lists(field: str, list_id: str, value: FieldValue) -> str:
    """Membership when no managed list exists: nothing is a member."""
    return "false"


def build_predicate(node: dict, member: Membership = no_lists) -> str:
    """A checked condition tree as a boolean SQL expression that is never NULL.

    SQL text costs one call per rule set where a Column per operator would cost thousands.
    ``member(field, list_id, value)`` gives the membership test of a managed list.
    """
    kind = node["type"]
    if kind in ("and", "or"):
        parts = [build_predicate(child, member) for child in node["conditions"]]
        neutral = "true" if kind == "and" else "false"
        return "(" + f" {kind.upper()} ".join([*parts] or [neutral]) + ")"
    if kind == "not":
        return f"(NOT {build_predicate(node['inner'], member)})"
    value = resolve_field(node["field"])
    if kind == "exists":
        return value.present
    if kind == "list":
        inside = or_false(member(node["field"], node["listId"], value))
        return f"(NOT {inside})" if node.get("negated", False) else inside
    if kind == "any_of":
        return or_false(is_one_of(value.text, [literal_text(v) for v in node["values"]]))
    if kind == "threshold":
        name = "Gt" if node.get("above", True) else "Lt"
        return or_false(ordered(name, value.number, float(node["limit"])))
    return or_false(compare(node["operator"], value, node["value"]))


def predicate(node: dict, member: Membership = no_lists) -> Column:
    """``build_predicate`` as a Column."""
    return F.expr(build_predicate(node, member))


def is_one_of(text: str, values: list[str]) -> str:
    if not values:
        return "false"
    return f"({text}) IN ({', '.join(map(sql_string, values))})"


def compare(name: str, value: FieldValue, target) -> str:
    if name in ORDER_OPERATORS:
        return ordered(name, value.number, float(target))
    wanted = sql_string(literal_text(target))
    if name == "Eq":
        return f"({value.text}) = {wanted}"
    if name == "Neq":
        return f"({value.text}) <> {wanted}"
    if name == "Regex":
        return f"({value.text}) RLIKE {wanted}"
    return f"{name.lower()}(lower({value.text}), lower({wanted}))"


def ordered(name: str, number: str, limit: float) -> str:
    """Numeric order; NaN, which Spark ranks above all numbers, compares false."""
    sign = {"Gt": ">", "Lt": "<", "Gte": ">=", "Lte": "<="}[name]
    test = f"({number}) {sign} double('{limit!r}')"
    return test if name in ("Lt", "Lte") else f"({test} AND NOT isnan({number}))"


def or_false(test: str) -> str:
    return f"coalesce({test}, false)"
