"""Alert tables: alerts, their event links, outbox and session marks, replayable per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.operators.alerting import new_outbox, route
from sentryspark.schema import ALERTS
from sentryspark.session import scratch, written
from sentryspark.sources.batches import Batch, read_table

LINKS = "alert_id STRING, event_id STRING, event_timestamp TIMESTAMP, sequence_order INT"
OUTBOX = "alert_id STRING, channel STRING, state STRING, attempts INT, next_attempt_at TIMESTAMP"


def alert_rows(enriched: DataFrame) -> DataFrame:
    """Enriched alerts in the columns of the alert table."""
    shape = enriched.sparkSession.createDataFrame([], ALERTS).schema
    given = {"labels": F.to_json("labels"), "suppressed": F.lit(False)}
    return enriched.select(*[
        (given[f.name] if f.name in given else F.col(f.name) if f.name in enriched.columns
         else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in shape
    ])


def link_rows(enriched: DataFrame) -> DataFrame:
    """The triggering event of each alert; no row carries a sequence position."""
    return enriched.select(
        "alert_id", "event_id", F.col("triggered_at").alias("event_timestamp"),
        F.lit(None).cast("int").alias("sequence_order"),
    )


def add_alerts(batch: Batch, enriched: DataFrame) -> None:
    """Alerts, links, outbox and session marks of a batch, to be committed together.

    Alert ids come from rule and event, so a replay names the same alerts.
    """
    with scratch(batch.spark):
        rows = written(enriched, "enriched")
        batch.write("alerts", alert_rows(rows))
        batch.write("alert_events", link_rows(rows))
        batch.write("outbox", new_outbox(route(rows)))
        batch.write("session_marks", rows.select("session_id", "alert_id", "severity"))


def write_alerts(enriched: DataFrame, batch_id: int, root: str) -> None:
    batch = Batch(enriched.sparkSession, root, "alerts", batch_id)
    add_alerts(batch, enriched)
    batch.commit()


def read_alerts(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Alerts written so far, each once even if two batches raised it; with ``batch_id``.

    ``before`` leaves out that batch and later ones first, so a replay sees what it saw at first.
    """
    table = read_table(spark, root, "alerts", ALERTS).drop("source")
    if before is not None:
        table = table.where(F.col("batch_id") < before)
    return table.dropDuplicates(["alert_id"])


def read_links(spark: SparkSession, root: str) -> DataFrame:
    table = read_table(spark, root, "alert_events", LINKS)
    return table.drop("source", "batch_id").dropDuplicates(["alert_id"])


def read_outbox(spark: SparkSession, root: str) -> DataFrame:
    table = read_table(spark, root, "outbox", OUTBOX)
    return table.drop("source", "batch_id").dropDuplicates(["alert_id", "channel"])
