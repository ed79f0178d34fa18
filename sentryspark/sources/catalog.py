"""Rules and managed lists: small control tables that steer the large jobs."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.functions.alert_text import SINGLE_DETAIL, sequence_detail
from sentryspark.functions.predicates import (
    ConditionError, check_patterns, parse_condition, required,
)
from sentryspark.schema import RULE_KINDS, SEVERITIES


@dataclass(frozen=True)
class Rule:
    """A checked rule, ready to become Columns."""

    id: str
    name: str
    severity: str
    kind: str
    condition: dict
    actions_json: str | None = None
    window_ms: int = 0
    threshold: float = 0.0
    is_rate: bool = False
    window_minutes: float = 0.0
    partition_field: str = "agentId"
    span_ms: int = 0
    steps: list[tuple[str, dict]] = field(default_factory=list)

    def conditions(self) -> list[dict]:
        """Every condition the rule's kind evaluates."""
        return [tree for _, tree in self.steps] if self.kind == "Sequence" else [self.condition]

    def detail(self) -> str:
        return sequence_detail([label for label, _ in self.steps]) if self.steps else SINGLE_DETAIL


def rule_severity(text: str | None) -> str:
    lowered = (text or "").lower()
    return lowered if lowered in SEVERITIES else "medium"


def build_rule(row: dict) -> Rule:
    """Turn one catalog row into a Rule; raises on any malformed part."""
    base = {
        "id": row["id"], "name": row["name"], "severity": rule_severity(row["severity"]),
        "condition": parse_condition(row["condition_json"]),
        "actions_json": row.get("actions_json"),
    }
    if row["evaluation_type"] == "Temporal" and row.get("temporal_config") is not None:
        return Rule(kind="Temporal", **base, **temporal_settings(row["temporal_config"]))
    if row["evaluation_type"] == "Sequence" and row.get("sequence_config") is not None:
        return Rule(kind="Sequence", **base, **sequence_settings(row["sequence_config"]))
    return Rule(kind="SingleEvent", **base)


def temporal_settings(text: str) -> dict:
    """Only the exact word ``Rate`` selects the rate; anything else counts."""
    config = json.loads(text)
    seconds = float(required(config, "windowSeconds"))
    return {
        "window_ms": int(seconds * 1000),
        "window_minutes": seconds / 60,
        "threshold": float(required(config, "threshold")),
        "partition_field": required(config, "partitionField") or "agentId",
        "is_rate": config.get("aggregation") == "Rate",
    }


def sequence_settings(text: str) -> dict:
    config = json.loads(text)
    steps = [
        (required(step, "label") or "", parse_condition(json.dumps(required(step, "condition"))))
        for step in required(config, "steps", list)
    ]
    if not steps:
        raise ConditionError("A sequence needs at least one step")
    return {"span_ms": int(float(required(config, "maxSpanSeconds")) * 1000), "steps": steps}


def load_rules(rules: DataFrame) -> tuple[list[Rule], DataFrame]:
    """Enabled rules, and one error row per rule that cannot be used.

    The catalog is written by people and holds the query text of the job, so it is read on
    the driver; a bad row never stops the others.
    """
    spark = rules.sparkSession
    good, errors = [], []
    for row in rules.where("enabled").orderBy("id").toLocalIterator():
        try:
            rule = build_rule(row.asDict())
            for tree in rule.conditions():
                check_patterns(spark, tree)
            good.append(rule)
        except (ValueError, TypeError, KeyError) as error:
            errors.append((row["id"], row["name"], str(error)))
    return good, spark.createDataFrame(errors, "rule_id STRING, name STRING, error STRING")


def condition_problem(text: str | None) -> str | None:
    try:
        parse_condition(text)
    except ConditionError as error:
        return str(error)
    return None


def condition_problems(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(problem=batch["condition_json"].map(condition_problem))


def rule_catalog_check(rules: DataFrame) -> DataFrame:
    """One row per defect of a rule row: missing names, unknown kinds, bad conditions."""
    checked = rules.mapInPandas(
        condition_problems, _with_problem(rules)
    )
    blank = lambda name: F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    known_severity = F.coalesce(F.lower("severity").isin(SEVERITIES), F.lit(False))
    known_kind = F.coalesce(F.col("evaluation_type").isin(RULE_KINDS), F.lit(False))
    defects = F.array_compact(F.array(
        F.when(blank("name"), F.lit("name is required")),
        F.when(blank("created_by"), F.lit("created_by is required")),
        F.when(~known_severity, F.lit("severity is unknown")),
        F.when(~known_kind, F.lit("evaluation_type is unknown")),
        F.when((F.col("evaluation_type") == "Temporal") & F.col("temporal_config").isNull(),
               F.lit("temporal_config is required")),
        F.when((F.col("evaluation_type") == "Sequence") & F.col("sequence_config").isNull(),
               F.lit("sequence_config is required")),
        F.col("problem"),
    ))
    return checked.select("id", "name", F.explode(defects).alias("error"))


def _with_problem(rules: DataFrame):
    return rules.withColumn("problem", F.lit(None).cast("string")).schema


def load_lists(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(list_id, value) of enabled lists; a disabled or unknown list has no rows."""
    enabled = lists.where("enabled").select(F.col("id").alias("list_id"))
    return members.join(enabled, "list_id", "left_semi").select("list_id", "value").distinct()


def list_summary(lists: DataFrame, members: DataFrame) -> DataFrame:
    """All lists by name with their member counts, empty lists included."""
    counts = members.groupBy(F.col("list_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        lists.join(counts, "id", "left")
        .select("id", "name", "description", "enabled",
                F.coalesce("n", F.lit(0)).alias("member_count"))
        .orderBy("name", "id")
    )


def no_members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "list_id STRING, value STRING")
