"""Rule evaluation: every rule against every event, as projections over one scan."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.functions.alert_text import json_text, span_text
from sentryspark.functions.fields import (
    FieldValue, event_millis, property_key, resolve_field, sql_string, with_property_map,
)
from sentryspark.functions.predicates import (
    Membership, build_predicate, leaves, no_lists, uses_properties,
)
from sentryspark.operators.chains import run_machines
from sentryspark.operators.sliding import sliding_count
from sentryspark.session import cut_lineage
from sentryspark.sources.catalog import Rule

KINDS = ("SingleEvent", "Temporal", "Sequence")
RULES_PER_ARRAY = 50
MATCH_EVENT_COLUMNS = ["event_id", "timestamp", "agent_id", "agent_name", "session_id"]
MATCH_COLUMNS = ["rule_id", "severity", *MATCH_EVENT_COLUMNS, "ms", "detail", "context"]


def evaluate(events: DataFrame, rules: list[Rule], members: DataFrame | None = None) -> DataFrame:
    """All triggered results of ``rules``: one row per (rule, event).

    ``members`` holds (list_id, value) of the managed lists that conditions refer to. One scan and
    one projection find the rows that any rule's condition hits, whatever its kind; they are few
    next to the events, are written once, and the kinds go on from there.
    """
    hits = tagged_hits(events, rules, members)
    if any(rule.kind != "SingleEvent" for rule in rules):
        hits = cut_lineage(hits)
    kinds = {"SingleEvent": single_results, "Temporal": temporal_results, "Sequence": sequence_matches}
    used = [run for kind, run in kinds.items() if of_kind(rules, kind)] or [single_results]
    return reduce(DataFrame.unionByName, [run(hits, rules) for run in used])


def tagged_hits(
    events: DataFrame, rules: list[Rule], members: DataFrame | None = None
) -> DataFrame:
    """Rows that a rule's condition hits, once per rule, tagged with the rule's ``kind``.

    ``rule`` is its position among the rules of its kind. Window rules add the partition value as
    ``key``, sequence rules the numbers of the steps the row matches as ``steps``: only the condition of
    the current step is tested later, so rows that match no step of a rule change nothing.
    """
    prepared, member = prepare_events(events, rules, members)
    hits = []
    for kind in KINDS:
        for i, rule in enumerate(of_kind(rules, kind)):
            tests = [build_predicate(tree, member) for tree in rule.conditions()]
            key, steps = "CAST(NULL AS STRING)", "CAST(NULL AS ARRAY<INT>)"
            if kind == "Temporal":
                key = partition_key(rule)
            if kind == "Sequence":
                marks = ", ".join(f"CASE WHEN {test} THEN {n} END" for n, test in enumerate(tests))
                steps = f"array_compact(array({marks}))"
            hits.append((f"({' OR '.join(tests)})",
                         f"struct('{kind}' AS kind, {i} AS rule, {key} AS key, {steps} AS steps)"))
    return explode_hits(prepared, hits, "kind STRING, rule INT, key STRING, steps ARRAY<INT>")


def hits_of(events: DataFrame, rules: list[Rule], members: DataFrame | None, kind: str) -> DataFrame:
    return tagged_hits(events, of_kind(rules, kind), members)


def kind_rows(hits: DataFrame, kind: str) -> DataFrame:
    return hits.where(F.col("kind") == kind).drop("kind")


def eval_single(
    events: DataFrame, rules: list[Rule], members: DataFrame | None = None
) -> DataFrame:
    """Triggered single-event rules."""
    return single_results(hits_of(events, rules, members, "SingleEvent"), rules)


def single_results(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    found = kind_rows(hits, "SingleEvent").drop("key", "steps")
    return with_facts(found, of_kind(rules, "SingleEvent"), lambda rule: {
        "rule_id": rule.id, "severity": rule.severity, "detail": rule.detail(), "context": "{}",
    }).select(*MATCH_COLUMNS)


def temporal_rows(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """Events that match a sliding-window rule, once per rule, with key and settings."""
    found = kind_rows(hits, "Temporal").drop("steps")
    return with_facts(found, of_kind(rules, "Temporal"), lambda rule: {
        "rule_id": rule.id, "severity": rule.severity, "window_ms": rule.window_ms,
        "threshold": rule.threshold, "is_rate": rule.is_rate, "minutes": rule.window_minutes,
        "span": span_text(rule.window_ms),
    })


def partition_key(rule: Rule) -> str:
    return f"coalesce({resolve_field(rule.partition_field).text}, 'global')"


def eval_temporal(
    events: DataFrame, rules: list[Rule], members: DataFrame | None = None
) -> DataFrame:
    """Triggered sliding-window rules; all windows are counted in one pass."""
    # Counting reads its rows more than once; they are few next to the events.
    return temporal_results(cut_lineage(hits_of(events, rules, members, "Temporal")), rules)


def temporal_results(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """A rule counts its matching events per partition value and fires on each one for which
    the count (or the rate per minute) has reached the threshold."""
    counted = sliding_count(
        temporal_rows(hits, rules), ["rule_id", "key"], "ms", "window_ms", ["event_id"], "window_count")
    # A window of no length has an endless rate once it holds an event; it stops no other rule.
    rate = F.when(F.col("minutes") > 0, F.try_divide("window_count", "minutes")).when(
        F.col("window_count") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    measure = F.when(F.col("is_rate"), rate).otherwise(F.col("window_count").cast("double"))
    return counted.where(measure >= F.col("threshold")).select(
        "rule_id", "severity", *MATCH_EVENT_COLUMNS, "ms",
        F.concat(F.col("window_count").cast("string"), F.lit(" events in "),
                 F.col("span")).alias("detail"),
        json_text(F.col("window_count")).alias("context"),
    )


def sequence_rows(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """Events that match any step of a sequence rule, once per rule, with the steps' numbers."""
    found = kind_rows(hits, "Sequence").drop("key")
    return with_facts(found, of_kind(rules, "Sequence"), lambda rule: {
        "n_steps": len(rule.steps), "span_ms": rule.span_ms,
    })


def sequence_results(fired: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches of fired rows, which carry their rule's position."""
    return with_facts(fired, of_kind(rules, "Sequence"), lambda rule: {
        "rule_id": rule.id, "severity": rule.severity, "detail": rule.detail(),
        "context": sequence_context(rule),
    }).select(*MATCH_COLUMNS)


def sequence_context(rule: Rule) -> str:
    facts = {"sequence_steps": len(rule.steps), "final_step": rule.steps[-1][0]}
    return json.dumps(facts, separators=(",", ":"), ensure_ascii=False)


def eval_sequence(
    events: DataFrame, rules: list[Rule], members: DataFrame | None = None
) -> DataFrame:
    """Triggered sequence rules: ordered steps per session, each within the span of the last."""
    return sequence_matches(cut_lineage(hits_of(events, rules, members, "Sequence")), rules)


def sequence_matches(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    fired = run_machines(sequence_rows(hits, rules), ["rule", "session_id"], ["event_id"], "last")
    return sequence_results(fired, rules)


def of_kind(rules: list[Rule], kind: str) -> list[Rule]:
    return [rule for rule in rules if rule.kind == kind]


def with_facts(
    found: DataFrame, rules: list[Rule], facts: Callable[[Rule], dict]
) -> DataFrame:
    """Add the constants of each row's rule, looked up by position in a literal array."""
    # Without a rule of this kind no row looks anything up, but the shape must hold.
    known = rules or [Rule("", "", "", "", {}, steps=[("", {})])]
    rows = ", ".join(
        "struct(" + ", ".join(f"{sql_value(v)} AS {k}" for k, v in facts(rule).items()) + ")"
        for rule in known
    )
    return found.withColumn("_fact", F.expr(f"array({rows})[rule]")).select(
        *found.columns, "_fact.*"
    )


def hit_facts(
    hits: DataFrame, rules: list[Rule], facts: dict[str, Callable[[Rule], dict]]
) -> DataFrame:
    """Hits of all kinds with id, severity and the constants of their rule, in one projection.

    A kind without some constant has NULL there.
    """
    rows = [(kind, i, {"rule_id": rule.id, "severity": rule.severity, **facts[kind](rule)})
            for kind in KINDS for i, rule in enumerate(of_kind(rules, kind))]
    # One unused rule per kind gives every column a type.
    shapes = [facts[kind](Rule("", "", "", kind, {}, steps=[("", {})])) for kind in KINDS]
    types = {"rule_id": "STRING", "severity": "STRING"}
    types |= {name: sql_type(value) for shape in shapes for name, value in shape.items()}
    entries = [
        f"'{kind}:{i}', struct(" + ", ".join(
            f"CAST({sql_value(row[name]) if name in row else 'NULL'} AS {kind_type}) AS {name}"
            for name, kind_type in types.items()) + ")"
        for kind, i, row in rows
    ]
    empty = "MAP<STRING, STRUCT<" + ", ".join(f"{n}: {t}" for n, t in types.items()) + ">>"
    table = f"map({', '.join(entries)})" if entries else f"CAST(map() AS {empty})"
    found = hits.withColumn("_fact", F.expr(f"({table})[concat(kind, ':', rule)]"))
    return found.select(*hits.columns, "_fact.*")


def sql_type(value: str | bool | int | float) -> str:
    return {str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE"}[type(value)]


def sql_value(value: str | bool | int | float) -> str:
    """A SQL literal; whole numbers are BIGINT, others DOUBLE."""
    if isinstance(value, str):
        return sql_string(value)
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value}L" if isinstance(value, int) else f"double('{value!r}')"


def explode_hits(events: DataFrame, hits: list[tuple[str, str]], shape: str) -> DataFrame:
    """One row per event and hit, a hit being (test, struct of columns)."""
    cases = [f"CASE WHEN {test} THEN {row} END" for test, row in hits]
    chunks = [
        f"array_compact(array({', '.join(cases[at:at + RULES_PER_ARRAY])}))"
        for at in range(0, len(cases), RULES_PER_ARRAY)
    ]
    if not chunks:
        found = f"CAST(NULL AS ARRAY<STRUCT<{as_struct(shape)}>>)"
    else:
        found = f"flatten(array({', '.join(chunks)}))" if len(chunks) > 1 else chunks[0]
    return events.select(
        *MATCH_EVENT_COLUMNS, event_millis().alias("ms"), F.expr(f"inline({found})")
    )


def as_struct(shape: str) -> str:
    return ",".join(":".join(part.split(maxsplit=1)) for part in shape.split(", "))


def prepare_events(
    events: DataFrame, rules: list[Rule], members: DataFrame | None
) -> tuple[DataFrame, Membership]:
    """Add the helper columns the rules need, and the way to test list membership.

    A list of any length is joined on the field's text as a flag column; Spark broadcasts its
    distinct values where their measured size is small.
    """
    trees = [tree for rule in rules for tree in rule.conditions()]
    partition_keys = [r.partition_field for r in rules if r.kind == "Temporal"]
    if any(uses_properties(t) for t in trees) or any(map(property_key, partition_keys)):
        events = with_property_map(events)
    pairs = sorted({
        (leaf["field"], leaf["listId"])
        for tree in trees for leaf in leaves(tree) if leaf["type"] == "list"
    })
    if not pairs or members is None:
        return events, no_lists
    flags = {}
    for number, (name, list_id) in enumerate(pairs):
        flags[name, list_id] = f"_listed_{number}"
        events = flag_members(events, members, name, list_id, flags[name, list_id])

    def member(name: str, list_id: str, value: FieldValue) -> str:
        return flags[name, list_id]

    return events, member


def flag_members(
    events: DataFrame, members: DataFrame, name: str, list_id: str, flag: str
) -> DataFrame:
    """Add boolean ``flag``: the field's text is a member of the list."""
    values = (
        members.where(F.col("list_id") == list_id)
        .select(F.col("value").alias("_value")).distinct().withColumn(flag, F.lit(True))
    )
    joined = events.join(values, F.expr(f"{resolve_field(name).text} = _value"), "left")
    return joined.drop("_value").withColumn(flag, F.coalesce(flag, F.lit(False)))
