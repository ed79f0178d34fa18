"""Dashboard reports over the roll-up tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentryspark.operators.search import clamp, last_hours
from sentryspark.schema import SEVERITIES

TOP_LIMIT = 20
TOP_MAX = 100
SPIKE_FACTOR = 1.5


def top_agents(hourly: DataFrame, as_of: datetime, hours: int = 24, limit: int = TOP_LIMIT):
    """Busiest agents of the last hours."""
    return (
        last_hours(hourly, "bucket", hours, as_of).groupBy("agent_id", "agent_name").agg(
            F.sum("event_count").alias("total_events"),
            F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
            F.max(F.coalesce("max_latency_ms", F.lit(0.0))).alias("max_latency_ms"),
        )
        .orderBy(F.desc("total_events"), "agent_id", "agent_name")
        .limit(clamp(limit, 1, TOP_MAX))
    )


def event_volume(hourly: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Events and tokens per hour, oldest first."""
    return (
        last_hours(hourly, "bucket", hours, as_of).groupBy("bucket").agg(
            F.sum("event_count").alias("event_count"),
            F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
        ).orderBy("bucket")
    )


def alert_distribution(alerts: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Alerts per severity and status, most frequent first."""
    return (
        last_hours(alerts, "triggered_at", hours, as_of).groupBy("severity", "status")
        .agg(F.count(F.lit(1)).alias("alert_count"))
        .orderBy(F.desc("alert_count"), "severity", "status")
    )


def tool_usage(tool_hourly: DataFrame, as_of: datetime, hours: int = 24, limit: int = TOP_LIMIT):
    """Most used tools. Latency is the plain mean of hourly means, and sessions are summed
    over the hourly rows, so a session active in two hours counts twice."""
    return (
        last_hours(tool_hourly, "bucket", hours, as_of).groupBy("tool_name").agg(
            F.sum("invocation_count").alias("invocation_count"),
            F.coalesce(F.avg("avg_latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
            F.sum("unique_sessions").alias("unique_sessions"),
        )
        .orderBy(F.desc("invocation_count"), "tool_name").limit(clamp(limit, 1, TOP_MAX))
    )


def alert_severity_totals(distribution: DataFrame) -> DataFrame:
    """Alerts per severity, zero where none, plus their total."""
    counts = [
        F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("alert_count"))), F.lit(0)).alias(s)
        for s in SEVERITIES
    ]
    total = reduce(Column.__add__, (F.col(s) for s in SEVERITIES))
    rows = F.array(*[
        F.struct(F.lit(name).alias("severity"), value.alias("alert_count"))
        for name, value in [*((s, F.col(s)) for s in SEVERITIES), ("total", total)]
    ])
    return distribution.agg(*counts).select(F.inline(rows))


def headline_metrics(volume: DataFrame, distribution: DataFrame) -> DataFrame:
    """Latest hour's events, tokens per minute, open alerts, and whether the hour spikes.

    A spike is a latest value above one and a half times the mean of at least two points.
    """
    minute_tokens = F.floor(F.col("total_tokens") / 60 + 0.5)
    latest = volume.agg(
        F.count(F.lit(1)).alias("points"),
        F.max_by("event_count", "bucket").alias("events"),
        F.max_by(minute_tokens, "bucket").alias("tokens"),
        F.avg("event_count").alias("mean_events"), F.avg(minute_tokens).alias("mean_tokens"),
    )
    waiting = distribution.agg(
        F.coalesce(F.sum(F.when(F.col("status") == "open", F.col("alert_count"))), F.lit(0))
        .alias("open_alerts")
    )

    def spikes(value: str, mean: str) -> Column:
        high = F.col(value) > F.col(mean) * SPIKE_FACTOR
        return F.coalesce((F.col("points") >= 2) & high, F.lit(False))

    # Both sides are single rows, joined on a constant.
    one = F.lit(1).alias("one")
    return latest.select("*", one).join(waiting.select("*", one), "one").select(
        F.coalesce("events", F.lit(0)).alias("events_last_hour"),
        F.coalesce("tokens", F.lit(0)).alias("tokens_per_minute"),
        "open_alerts",
        spikes("events", "mean_events").alias("events_spike"),
        spikes("tokens", "mean_tokens").alias("tokens_spike"),
    )


def tool_share(usage: DataFrame) -> DataFrame:
    """Invocations of each tool as a percentage of the most used one.

    ``usage`` is the bounded result of ``tool_usage``.
    """
    largest = F.max("invocation_count").over(Window.partitionBy(F.lit(1)))
    share = F.col("invocation_count") * 100.0 / largest
    return usage.select("tool_name", "invocation_count", share.alias("share_percent"))
