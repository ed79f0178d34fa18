"""Session table as partial rows per batch, merged when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.operators.sessions import session_alert_rollup
from sentryspark.sources.batches import Batch, read_table
from sentryspark.sources.event_store import read_events

PARTIALS = """
    session_id STRING, agent_id STRING, agent_name STRING, started_at TIMESTAMP,
    last_event_at TIMESTAMP, event_count BIGINT
"""
MARKS = "session_id STRING, alert_id STRING, severity STRING"


def session_parts(events: DataFrame) -> DataFrame:
    """One batch's share of every session it touches."""
    first = F.struct("agent_id", "agent_name", F.col("timestamp").alias("started_at"))
    return events.groupBy("session_id").agg(
        F.min_by(first, F.struct("timestamp", "event_id")).alias("first"),
        F.max("timestamp").alias("last_event_at"),
        F.count(F.lit(1)).alias("event_count"),
    ).select("session_id", "first.*", "last_event_at", "event_count")


def write_session_batch(events: DataFrame, batch_id: int, root: str) -> None:
    """Add one batch's share of its sessions; a replay replaces it."""
    batch = Batch(events.sparkSession, root, "sessions", batch_id)
    batch.write("sessions", session_parts(events))
    batch.commit()


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """One row per session: first arrival's agent and start, last event, events so far."""
    first = F.struct("agent_id", "agent_name", "started_at")
    return (
        read_table(spark, root, "sessions", PARTIALS).groupBy("session_id").agg(
            F.min_by(first, F.struct("batch_id", "started_at")).alias("first"),
            F.max("last_event_at").alias("last_event_at"),
            F.sum("event_count").alias("event_count"),
        ).select("session_id", "first.*", "last_event_at", "event_count",
                 F.lit("{}").alias("metadata"))
    )


def read_marked_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions with the marks that alert batches left: has_alerts, alert_count, max_severity."""
    marks = read_table(spark, root, "session_marks", MARKS).dropDuplicates(["alert_id"])
    return session_alert_rollup(read_sessions(spark, root), marks)


def read_session_events(spark: SparkSession, root: str, session_id: str) -> DataFrame:
    """Stored events of one session; only the days between its first and last event are opened.

    The days come from the session table, where the session's few rows are found by a pushed-down
    filter. An unknown session has no events.
    """
    parts = read_table(spark, root, "sessions", PARTIALS).where(F.col("session_id") == session_id)
    start, end = parts.agg(F.min("started_at"), F.max("last_event_at")).first()
    events = read_events(spark, root, start, end) if end else read_events(spark, root).where(F.lit(False))
    return events.where(F.col("session_id") == session_id)
