"""The whole batch flow: events, rules and suppressions in, alerts and counters out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.operators.alerting import (
    NoiseLimits, enrich, label_stages, new_outbox, route, stage_counters,
)
from sentryspark.operators.rules import evaluate
from sentryspark.session import cut_lineage
from sentryspark.sources.catalog import load_rules


@dataclass(frozen=True)
class Detection:
    """Results of one run."""

    matches: DataFrame
    staged: DataFrame
    alerts: DataFrame
    rule_errors: DataFrame

    def counters(self) -> DataFrame:
        return stage_counters(self.matches, self.staged)

    def outbox(self) -> DataFrame:
        return new_outbox(route(self.alerts))

    def alert_events(self) -> DataFrame:
        return self.alerts.select(
            "alert_id", "event_id", F.col("triggered_at").alias("event_timestamp"),
            F.lit(None).cast("int").alias("sequence_order"),
        )


def run_detection(
    events: DataFrame,
    rules: DataFrame,
    suppressions: DataFrame,
    members: DataFrame | None = None,
    history: DataFrame | None = None,
    limits: NoiseLimits = NoiseLimits(),
) -> Detection:
    """Evaluate all rules, thin the results out and enrich what remains.

    Matches are few next to events and feed several steps, so they are computed once.
    """
    usable, errors = load_rules(rules)
    matches = cut_lineage(evaluate(events, usable, members))
    staged = cut_lineage(label_stages(matches, suppressions, limits))
    created = staged.where("stage = 'created'").drop("stage")
    return Detection(matches, staged, enrich(created, rules, events, history), errors)
