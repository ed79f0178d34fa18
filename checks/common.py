"""Registry of queries and the SQL pieces their checks share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.plans.adapter import (
    ALERTS_SQL, RAW_EVENTS_SQL, agent_events, as_written, sample_alert_events, sample_alerts,
)
from sentryspark.session import prepare

AS_OF = datetime(2024, 1, 31)
DECIMALS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its result is written with zone-less times and rounded doubles."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return rounded(as_written(build(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(F.col(name), DECIMALS) for name in doubles})


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_events(spark, sf_dir)


def alerts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_alerts(spark, agent_events(spark, sf_dir))


def links_of(alerts: DataFrame) -> DataFrame:
    return sample_alert_events(alerts)


RAW = f"raw AS ({RAW_EVENTS_SQL.format(events='events')})"
AE = f"""{RAW}, ae AS (SELECT *, CASE raw_event_type WHEN 'Tool.Invoke' THEN 'tool_invocation'
 WHEN 'gen_ai.chat' THEN 'llm_call' WHEN 'on_chain_start' THEN 'agent_decision'
 WHEN 'rag.query' THEN 'rag_retrieval' ELSE raw_event_type END AS event_type,
 epoch_us(timestamp) // 1000 AS ms FROM raw)"""
ALERTS = f"{AE}, alerts AS ({ALERTS_SQL.format(agent_events='ae')})"

HOURLY = f"""{AE}, hourly AS (
SELECT date_trunc('hour', timestamp) AS bucket, agent_id, agent_name, event_type,
 count(*) AS event_count, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
 CAST(sum(input_tokens + output_tokens) FILTER (WHERE input_tokens IS NOT NULL) AS BIGINT)
   AS total_tokens,
 avg(latency_ms) AS avg_latency_ms, max(latency_ms) AS max_latency_ms,
 quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
 count(DISTINCT session_id) AS unique_sessions, count(DISTINCT tool_name) AS unique_tools_used
FROM ae GROUP BY 1, 2, 3, 4)"""

TOOLS = f"""{AE}, tool_hourly AS (
SELECT date_trunc('hour', timestamp) AS bucket, tool_name, agent_id,
 count(*) AS invocation_count, avg(latency_ms) AS avg_latency_ms,
 count(DISTINCT session_id) AS unique_sessions
FROM ae WHERE event_type = 'tool_invocation' AND tool_name IS NOT NULL GROUP BY 1, 2, 3)"""
