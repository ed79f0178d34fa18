"""JSON containment: does a JSON text hold a given pattern, at any depth of the pattern.

Objects contain a pattern when every key of the pattern is there and contains its value,
arrays when every pattern element is contained in some element, scalars when equal by type.
The pattern is fixed per query, so it unrolls to one Column.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric types that a JSON number may take in a VARIANT.
NUMBER_KINDS = r"^(BIGINT|DECIMAL\(.*\)|DOUBLE)$"


def json_contains(text: Column, pattern_json: str) -> Column:
    """True when JSON ``text`` contains ``pattern_json``; false for invalid or NULL text."""
    value = F.try_parse_json(text)
    pattern = json.loads(pattern_json)
    test = contains(value, pattern)
    if not isinstance(pattern, (dict, list)):
        # A bare scalar is also contained in a top-level array that lists it.
        test = test | some_element(value, pattern)
    return F.coalesce(test, F.lit(False))


def contains(value: Column, pattern) -> Column:
    if isinstance(pattern, dict):
        members = F.try_variant_get(value, "$", "map<string,variant>")
        tests = [members.isNotNull()]
        tests += [contains(members[key], item) for key, item in pattern.items()]
        return reduce(Column.__and__, (F.coalesce(t, F.lit(False)) for t in tests))
    if isinstance(pattern, list):
        is_array = F.try_variant_get(value, "$", "array<variant>").isNotNull()
        tests = [is_array] + [some_element(value, item) for item in pattern]
        return reduce(Column.__and__, (F.coalesce(t, F.lit(False)) for t in tests))
    return equals_scalar(value, pattern)


def some_element(value: Column, pattern) -> Column:
    elements = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(F.exists(elements, lambda item: contains(item, pattern)), F.lit(False))


def equals_scalar(value: Column, pattern) -> Column:
    kind = F.schema_of_variant(value)
    if pattern is None:
        test = kind == "VOID"
    elif isinstance(pattern, bool):
        test = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == pattern)
    elif isinstance(pattern, (int, float)):
        number = F.try_variant_get(value, "$", "double")
        test = kind.rlike(NUMBER_KINDS) & (number == float(pattern))
        if isinstance(pattern, int) and abs(pattern) < 10 ** 38:
            # Whole numbers beyond 2^53 share doubles; where both are whole, compare digits.
            whole = F.try_variant_get(value, "$", "decimal(38,0)")
            exact = whole == F.lit(str(pattern)).cast("decimal(38,0)")
            test = test & ((kind == "DOUBLE") | F.coalesce(exact, F.lit(True)))
    else:
        test = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == pattern)
    return F.coalesce(test, F.lit(False))


def json_or_empty(text: Column) -> Column:
    """``text`` when it is valid JSON, else ``{}``."""
    valid = F.try_parse_json(text).isNotNull() & (F.trim(text) != "")
    return F.when(valid, text).otherwise(F.lit("{}"))
