"""Hourly and daily activity tables, from events or from states that batches add up to.

A state row stands for a batch's events of one (hour, agent, type, session, tool). All tables but the
percentile follow from sums, minima, maxima and distinct values of such rows, so a day's table never
needs the day's events again; the percentile follows from counts of equal latencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentryspark.functions.fields import time_bucket
from sentryspark.operators.percentiles import exact_percentiles

HOURLY_KEYS = ["bucket", "agent_id", "agent_name", "event_type"]
DAILY_KEYS = ["bucket", "agent_id", "agent_name"]
TOOL_KEYS = ["bucket", "tool_name", "agent_id"]


def token_sum() -> Column:
    """Input plus output tokens of events that have input tokens."""
    both = F.col("input_tokens").cast("long") + F.col("output_tokens")
    return F.sum(F.when(F.col("input_tokens").isNotNull(), both))


def agent_activity_hourly(events: DataFrame) -> DataFrame:
    """Per hour, agent and event type: counts, tokens, latency (with exact p95), distincts."""
    bucketed = events.withColumn("bucket", time_bucket("hour"))
    totals = bucketed.groupBy(*HOURLY_KEYS).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        token_sum().alias("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("tool_name").alias("unique_tools_used"),
    )
    slow = exact_percentiles(bucketed, HOURLY_KEYS, "latency_ms", {"p95_latency_ms": 0.95})
    return totals.join(slow, HOURLY_KEYS, "left")


def agent_activity_daily(events: DataFrame) -> DataFrame:
    """Per day and agent: counts, tokens, distinct sessions and types, first and last event."""
    return (
        events.withColumn("bucket", time_bucket("day")).groupBy(*DAILY_KEYS).agg(
            F.count(F.lit(1)).alias("event_count"),
            token_sum().alias("total_tokens"),
            F.count_distinct("session_id").alias("unique_sessions"),
            F.count_distinct("event_type").alias("event_type_variety"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )


def tool_usage_hourly(events: DataFrame) -> DataFrame:
    """Per hour, tool and agent: invocations, average latency, distinct sessions."""
    used = events.where("event_type = 'tool_invocation' AND tool_name IS NOT NULL")
    return (
        used.withColumn("bucket", time_bucket("hour")).groupBy(*TOOL_KEYS).agg(
            F.count(F.lit(1)).alias("invocation_count"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.count_distinct("session_id").alias("unique_sessions"),
        )
    )


STATE_KEYS = [*HOURLY_KEYS, "session_id", "tool_name"]
STATES = """
    bucket TIMESTAMP, agent_id STRING, agent_name STRING, event_type STRING, session_id STRING,
    tool_name STRING, event_count BIGINT, total_input_tokens BIGINT, total_output_tokens BIGINT,
    total_tokens BIGINT, latency_sum DOUBLE, latency_count BIGINT, max_latency_ms DOUBLE,
    first_seen TIMESTAMP, last_seen TIMESTAMP
"""
LATENCIES = """
    bucket TIMESTAMP, agent_id STRING, agent_name STRING, event_type STRING, latency_ms DOUBLE, n BIGINT
"""


def activity_states(events: DataFrame) -> DataFrame:
    """Sums and extremes per hour, agent, type, session and tool."""
    return events.withColumn("bucket", time_bucket("hour")).groupBy(*STATE_KEYS).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        token_sum().alias("total_tokens"),
        F.sum("latency_ms").alias("latency_sum"),
        F.count("latency_ms").alias("latency_count"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def latency_states(events: DataFrame) -> DataFrame:
    """Counts of equal latencies per hour, agent and type."""
    return events.where("latency_ms IS NOT NULL").withColumn("bucket", time_bucket("hour")).groupBy(
        *HOURLY_KEYS, "latency_ms").agg(F.count(F.lit(1)).alias("n"))


def mean_latency() -> Column:
    return F.try_divide(F.sum("latency_sum"), F.sum("latency_count")).alias("avg_latency_ms")


def hourly_of_states(states: DataFrame, latencies: DataFrame) -> DataFrame:
    """``agent_activity_hourly`` of the events behind the states."""
    totals = states.groupBy(*HOURLY_KEYS).agg(
        F.sum("event_count").alias("event_count"),
        F.sum("total_input_tokens").alias("total_input_tokens"),
        F.sum("total_output_tokens").alias("total_output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        mean_latency(),
        F.max("max_latency_ms").alias("max_latency_ms"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("tool_name").alias("unique_tools_used"),
    )
    slow = exact_percentiles(latencies, HOURLY_KEYS, "latency_ms", {"p95_latency_ms": 0.95}, "n")
    return totals.join(slow, HOURLY_KEYS, "left")


def daily_of_states(states: DataFrame) -> DataFrame:
    """``agent_activity_daily`` of the events behind the states."""
    return states.withColumn("bucket", F.date_trunc("day", "bucket")).groupBy(*DAILY_KEYS).agg(
        F.sum("event_count").alias("event_count"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("event_type").alias("event_type_variety"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def tools_of_states(states: DataFrame) -> DataFrame:
    """``tool_usage_hourly`` of the events behind the states."""
    used = states.where("event_type = 'tool_invocation' AND tool_name IS NOT NULL")
    return used.groupBy(*TOOL_KEYS).agg(
        F.sum("event_count").alias("invocation_count"),
        mean_latency(),
        F.count_distinct("session_id").alias("unique_sessions"),
    )
