"""Per-agent risk summary."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAKDOWN_SIZE = 10


def top_breakdown(
    df: DataFrame, key: str, value: str, size: int = BREAKDOWN_SIZE
) -> DataFrame:
    """(key, breakdown): JSON object of the key's most frequent values and their counts.

    Counting comes first, so only distinct values are ranked and at most ``size`` collected.
    """
    ranking = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(value))
    best = (
        df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_rank", F.row_number().over(ranking)).where(F.col("_rank") <= size)
    )
    entries = F.array_sort(F.collect_list(F.struct(value, "n")))
    return best.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias("breakdown"))


def agent_risk_summary(
    events: DataFrame,
    alerts: DataFrame,
    as_of: datetime,
    agent_id: str | None = None,
    lookback: timedelta = timedelta(hours=24),
) -> DataFrame:
    """Activity, open alerts and breakdowns of every active agent, or of one agent.

    Asking for one agent always gives a row; an agent without events gets zeros.
    """
    cutoff = F.lit(as_of - lookback)
    recent = events.where(F.col("timestamp") >= cutoff)
    raised = alerts.where((F.col("triggered_at") >= cutoff) & (F.col("status") == "open"))
    if agent_id is not None:
        recent = recent.where(F.col("agent_id") == agent_id)
        raised = raised.where(F.col("agent_id") == agent_id)
    minutes = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.min("timestamp"))) / 6e7
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    stats = recent.groupBy("agent_id").agg(
        F.max("agent_name").alias("agent_name"),
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.count_distinct("tool_name").alias("unique_tools"),
        F.sum(tokens.cast("long")).alias("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        (F.count(F.lit(1)) / F.greatest(minutes, F.lit(1.0))).alias("events_per_minute"),
    )
    alarm = raised.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("open_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
    )
    types = top_breakdown(recent, "agent_id", "event_type")
    tools = top_breakdown(recent, "agent_id", "tool_name")
    joined = (
        stats.join(alarm, "agent_id", "left")
        .join(types.withColumnRenamed("breakdown", "top_event_types"), "agent_id", "left")
        .join(tools.withColumnRenamed("breakdown", "top_tools"), "agent_id", "left")
    )
    if agent_id is not None:
        asked = events.sparkSession.range(1).select(F.lit(agent_id).alias("agent_id"))
        joined = asked.join(joined, "agent_id", "left")
    return joined.select(
        "agent_id", "agent_name",
        or_zero("total_events"), or_zero("total_sessions"), or_zero("open_alerts"),
        or_zero("critical_alerts"), or_zero("unique_tools"), or_zero("total_tokens"),
        or_zero("avg_latency_ms", 0.0), or_zero("events_per_minute", 0.0),
        F.coalesce("top_event_types", F.lit("{}")).alias("top_event_types"),
        F.coalesce("top_tools", F.lit("{}")).alias("top_tools"),
    )


def or_zero(name: str, zero: int | float = 0) -> Column:
    return F.coalesce(name, F.lit(zero)).alias(name)
