"""The driver's generic ``events`` table read as agent telemetry.

``RAW_EVENTS_SQL`` and ``ALERTS_SQL`` are plain SQL that other engines can run unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.functions.normalize import normalize_event_type

RAW_EVENTS_SQL = """
SELECT concat('evt-', CAST(event_id AS STRING)) AS event_id, event_id AS seq, ts AS timestamp,
 concat('trace-', CAST(event_id AS STRING)) AS trace_id,
 concat('agent-', CAST(user_id % 10 AS STRING)) AS agent_id,
 concat('Agent ', CAST(user_id % 10 AS STRING)) AS agent_name,
 concat('sess-', CAST(user_id AS STRING)) AS session_id,
 CASE event_type WHEN 'click' THEN 'Tool.Invoke' WHEN 'view' THEN 'gen_ai.chat'
   WHEN 'purchase' THEN 'external_api_call' WHEN 'signup' THEN 'on_chain_start'
   ELSE 'rag.query' END AS raw_event_type,
 CASE WHEN event_type = 'view' THEN CASE k % 4 WHEN 0 THEN 'gpt-4' WHEN 1 THEN 'claude-3-opus'
   WHEN 2 THEN 'claude-3-sonnet' ELSE 'gpt-4-turbo' END END AS model_id,
 CASE WHEN event_type = 'view' THEN 50 + k * 19 END AS input_tokens,
 CASE WHEN event_type = 'view' AND k % 7 <> 0 THEN 50 + k * 39 END AS output_tokens,
 CASE WHEN k % 17 <> 0 THEN value * 10 END AS latency_ms,
 CASE WHEN event_type = 'click' AND k % 11 <> 0 THEN CASE k % 8 WHEN 0 THEN 'web_search'
   WHEN 1 THEN 'file_read' WHEN 2 THEN 'code_execute' WHEN 3 THEN 'shell_run'
   WHEN 4 THEN 'database_query' WHEN 5 THEN 'send_email' WHEN 6 THEN 'api_call'
   ELSE 'calculator' END END AS tool_name,
 props AS properties
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) AS keyed
"""

ALERTS_SQL = """
SELECT concat('alert-', CAST(seq AS STRING)) AS alert_id,
 CASE WHEN event_type = 'external_api_call' THEN 'rule-api' ELSE 'rule-tool' END AS rule_id,
 CASE WHEN event_type = 'external_api_call' THEN 'Outside call' ELSE 'Risky tool' END AS rule_name,
 CASE seq % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END
   AS severity,
 CASE WHEN seq % 5 = 0 THEN 'acknowledged' WHEN seq % 7 = 0 THEN 'resolved' ELSE 'open' END
   AS status,
 concat(CASE WHEN event_type = 'external_api_call' THEN 'Outside call: ' ELSE 'Risky tool: ' END,
   agent_name) AS title,
 CASE WHEN seq % 3 = 0 THEN 'Rule conditions matched' END AS detail,
 CASE seq % 6 WHEN 0 THEN '' WHEN 1 THEN 'not json' ELSE properties END AS context,
 agent_id, agent_name, session_id, event_id, timestamp AS triggered_at,
 CASE WHEN seq % 5 = 0 THEN timestamp + INTERVAL 1 HOUR END AS acknowledged_at,
 CASE WHEN seq % 5 <> 0 AND seq % 7 = 0 THEN timestamp + INTERVAL 2 HOUR END AS resolved_at,
 CAST(NULL AS STRING) AS assigned_to, CAST(NULL AS STRING) AS resolution_note,
 CASE WHEN seq % 2 = 0 THEN concat(chr(123), '"category":"', event_type, '"', chr(125)) END AS labels,
 FALSE AS suppressed, CAST(NULL AS STRING) AS suppressed_by,
 CAST(NULL AS TIMESTAMP) AS suppression_expires_at
FROM {agent_events}
WHERE tool_name IN ('shell_run', 'code_execute')
   OR (event_type = 'external_api_call' AND latency_ms > 600)
"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter rows before the event type is normalised."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = spark.sql(RAW_EVENTS_SQL, events=table)
    return raw.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical agent events of a driver folder."""
    return raw_events(spark, sf_dir).withColumn(
        "event_type", normalize_event_type(F.col("raw_event_type"))
    )


def sample_alerts(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Alert rows derived from the events, for reports that read a stored alert table."""
    return spark.sql(ALERTS_SQL, agent_events=events)


def sample_alert_events(alerts: DataFrame) -> DataFrame:
    """The junction rows of ``sample_alerts``."""
    return alerts.select(
        "alert_id", "event_id", F.col("triggered_at").alias("event_timestamp"),
        F.lit(None).cast("int").alias("sequence_order"),
    )


def as_written(df: DataFrame) -> DataFrame:
    """Timestamps as zone-less UTC, the form in which the driver tables hold them."""
    stamped = [name for name, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in stamped})
