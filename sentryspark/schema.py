"""Table schemas (DDL strings) and the fixed vocabularies of the data model."""

from __future__ import annotations

# Raw message as it arrives on the topic; every field may be missing.
RAW_EVENT_FIELDS = {
    "eventId": "STRING",
    "timestamp": "TIMESTAMP",
    "sessionId": "STRING",
    "traceId": "STRING",
    "agentId": "STRING",
    "agentName": "STRING",
    "eventType": "STRING",
    "modelId": "STRING",
    "inputTokens": "INT",
    "outputTokens": "INT",
    "latencyMs": "DOUBLE",
    "toolName": "STRING",
    "toolInput": "STRING",
    "toolOutput": "STRING",
    "contentHash": "STRING",
    "extra": "STRING",
}

# The sixteen columns the event writer fills, in table order.
STORED_EVENT_COLUMNS = [
    "event_id", "timestamp", "agent_id", "agent_name", "session_id", "trace_id",
    "event_type", "model_id", "input_tokens", "output_tokens", "latency_ms",
    "tool_name", "tool_input", "tool_output", "content_hash", "properties",
]

EVENTS = """
    event_id STRING, timestamp TIMESTAMP, agent_id STRING, agent_name STRING,
    session_id STRING, trace_id STRING, event_type STRING, severity_hint STRING,
    model_id STRING, input_tokens INT, output_tokens INT, latency_ms DOUBLE,
    tool_name STRING, tool_input STRING, tool_output STRING, content_hash STRING,
    properties STRING, ingested_at TIMESTAMP, kafka_partition SMALLINT,
    kafka_offset BIGINT, source_sdk STRING
"""

RULES = """
    id STRING, name STRING, description STRING, enabled BOOLEAN, severity STRING,
    condition_json STRING, evaluation_type STRING, temporal_config STRING,
    sequence_config STRING, actions_json STRING, tags ARRAY<STRING>,
    created_by STRING, created_at TIMESTAMP, updated_at TIMESTAMP
"""

LISTS = """
    id STRING, name STRING, description STRING, enabled BOOLEAN,
    created_at TIMESTAMP, updated_at TIMESTAMP
"""

LIST_MEMBERS = "list_id STRING, value STRING, added_at TIMESTAMP"

SUPPRESSIONS = """
    id STRING, rule_id STRING, agent_id STRING, reason STRING, created_by STRING,
    created_at TIMESTAMP, expires_at TIMESTAMP
"""

ALERTS = """
    alert_id STRING, rule_id STRING, rule_name STRING, severity STRING, status STRING,
    title STRING, detail STRING, context STRING, agent_id STRING, session_id STRING,
    triggered_at TIMESTAMP, acknowledged_at TIMESTAMP, resolved_at TIMESTAMP,
    assigned_to STRING, resolution_note STRING, labels STRING, suppressed BOOLEAN,
    suppressed_by STRING, suppression_expires_at TIMESTAMP
"""

ALERT_EVENTS = "alert_id STRING, event_id STRING, event_timestamp TIMESTAMP, sequence_order INT"

# Severities in rising order, alert states and the legal moves between them.
SEVERITIES = ["low", "medium", "high", "critical"]
ALERT_STATES = ["open", "acknowledged", "resolved"]
ALERT_MOVES = [("open", "acknowledged"), ("open", "resolved"), ("acknowledged", "resolved")]

# The three kinds of rule.
RULE_KINDS = ["SingleEvent", "Temporal", "Sequence"]
