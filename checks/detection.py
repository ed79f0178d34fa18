"""Rules against the events, and what becomes of their results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import AE, ALERTS, alerts_of, events_of, query
from checks.conditions import field
from sentryspark.operators.alerting import (
    NoiseLimits, dedup, live_feed, new_outbox,
    retry_plan, route, suppress, throttle, transition_alerts,
)
from sentryspark.operators.rules import eval_sequence, eval_single, eval_temporal, evaluate
from sentryspark.operators.sliding import HOUR_MS, sliding_count
from sentryspark.functions.fields import event_millis
from sentryspark.plans.detection import run_detection
from sentryspark.schema import RULES
from sentryspark.session import cut_lineage
from sentryspark.sources.catalog import load_rules

DAY_SECONDS = 86_400
LIMITS = NoiseLimits(dedup_ms=12 * HOUR_MS, throttle_limit=3, throttle_ms=6 * HOUR_MS)


def rule_row(rule_id: str, severity: str, condition: dict, kind: str = "SingleEvent",
             temporal: dict | None = None, sequence: dict | None = None,
             labels: dict | None = None) -> tuple:
    actions = [{"type": "create_alert", "labels": labels}] if labels else None
    return (
        rule_id, f"Rule {rule_id}", None, True, severity, json.dumps(condition), kind,
        temporal and json.dumps(temporal), sequence and json.dumps(sequence),
        actions and json.dumps(actions), None, "checks", None, None,
    )


def step(label: str, event_type: str) -> dict:
    return {"label": label, "condition": field("eventType", "Eq", event_type)}


RULE_ROWS = {
    "slow": rule_row("slow", "High", {"type": "and", "conditions": [
        field("eventType", "Eq", "rag_retrieval"), field("latencyMs", "Gt", 300)]},
        labels={"category": "latency"}),
    "claude": rule_row("claude", "low", {"type": "and", "conditions": [
        field("modelId", "Contains", "Claude"),
        {"type": "threshold", "field": "inputTokens", "limit": 1000}]}),
    "shell": rule_row("shell", "critical", {"type": "any_of", "field": "toolName",
                                            "values": ["shell_run", "code_execute"]}),
    "busy": rule_row("busy", "medium", field("eventType", "Eq", "tool_invocation"), "Temporal",
                     {"windowSeconds": DAY_SECONDS, "threshold": 10, "partitionField": "agentId"}),
    "rate": rule_row("rate", "unheard", field("eventType", "Eq", "llm_call"), "Temporal",
                     {"windowSeconds": DAY_SECONDS, "threshold": 0.0055, "aggregation": "Rate",
                      "partitionField": "agentId"}),
    "flood": rule_row("flood", "low", field("eventType", "Eq", "external_api_call"), "Temporal",
                      {"windowSeconds": 5400.5, "threshold": 6, "aggregation": "rate",
                       "partitionField": "properties.none"}),
    "pair": rule_row("pair", "critical", field("eventType", "Eq", "never"), "Sequence", None,
                     {"maxSpanSeconds": DAY_SECONDS, "steps": [
                         step("read", "rag_retrieval"), step("call", "external_api_call")]}),
    "triple": rule_row("triple", "high", field("eventType", "Eq", "never"), "Sequence", None,
                       {"maxSpanSeconds": 2 * DAY_SECONDS, "steps": [
                           step("read", "rag_retrieval"), step("use", "tool_invocation"),
                           step("call", "external_api_call")]}),
    "broken": rule_row("broken", "high", {"type": "field", "field": "toolName"}),
}
SUPPRESSIONS_SQL = """SELECT 'slow' AS rule_id, CAST(NULL AS STRING) AS agent_id,
 TIMESTAMP '2024-01-05 00:00:00' AS created_at, TIMESTAMP '2024-01-12 00:00:00' AS expires_at
 UNION ALL SELECT NULL, 'agent-3', TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-20 00:00:00'
 UNION ALL SELECT 'shell', 'agent-1', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-25 00:00:00'
 UNION ALL SELECT NULL, NULL, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00'"""


def rules_of(spark, *names: str) -> DataFrame:
    rows = [RULE_ROWS[name] for name in names or RULE_ROWS]
    return spark.createDataFrame(rows, RULES)


def loaded(spark, *names: str):
    return load_rules(rules_of(spark, *names))[0]


def matches_of(spark, sf_dir) -> DataFrame:
    return cut_lineage(evaluate(events_of(spark, sf_dir), loaded(spark)))


PAYLOAD = "event_id, timestamp, agent_id, agent_name, session_id, ms"


def single_sql(rule: str, severity: str, where: str) -> str:
    return f"""SELECT '{rule}' AS rule_id, '{severity}' AS severity, {PAYLOAD},
 'Event matched rule conditions' AS detail, '{{}}' AS context FROM ae WHERE {where}"""


def temporal_sql(rule: str, severity: str, where: str, key: str, window_ms: int, fires: str,
                 span: str) -> str:
    return f"""SELECT '{rule}' AS rule_id, '{severity}' AS severity, {PAYLOAD},
 concat(n, ' events in {span}') AS detail, concat('{{"window_count":', n, '}}') AS context FROM (
 SELECT *, count(*) OVER (PARTITION BY {key} ORDER BY ms RANGE BETWEEN {window_ms - 1} PRECEDING
   AND CURRENT ROW) - count(*) OVER (PARTITION BY {key}, ms)
   + row_number() OVER (PARTITION BY {key}, ms ORDER BY event_id) AS n
 FROM ae WHERE {where}) WHERE {fires}"""


def walk_sql(name: str, kinds: list[str], span_ms: int) -> str:
    """CTEs that walk a sequence rule over each session; rows that fire end in <name>."""
    bits = " + ".join(f"CASE WHEN event_type = '{k}' THEN {1 << i} ELSE 0 END"
                      for i, k in enumerate(kinds))
    steps = len(kinds)
    state = "CASE WHEN {w}.k > 0 AND {o}.ms >= {w}.expiry THEN 0 ELSE {w}.k END"
    here = state.format(w="w", o="o")
    return f"""{name}_rows AS (SELECT *, {bits} AS bits, row_number() OVER (PARTITION BY session_id
 ORDER BY ms, event_id) AS rn FROM ae WHERE event_type IN ({', '.join(f"'{k}'" for k in kinds)})),
 {name}_walk AS (SELECT session_id, CAST(0 AS BIGINT) AS rn, 0 AS k, CAST(0 AS BIGINT) AS expiry,
   FALSE AS fired, '' AS event_id FROM {name}_rows WHERE rn = 1
 UNION ALL SELECT o.session_id, o.rn,
  CASE WHEN (o.bits >> {here}) & 1 = 1 THEN ({here} + 1) % {steps} ELSE {here} END,
  CASE WHEN (o.bits >> {here}) & 1 = 1 THEN o.ms + {span_ms} ELSE w.expiry END,
  (o.bits >> {here}) & 1 = 1 AND {here} = {steps - 1}, o.event_id
 FROM {name}_walk w JOIN {name}_rows o ON o.session_id = w.session_id AND o.rn = w.rn + 1),
 {name} AS (SELECT r.* FROM {name}_rows r JOIN {name}_walk w USING (session_id, rn) WHERE fired)"""


def sequence_sql(rule: str, severity: str, source: str, steps: int, final: str) -> str:
    return f"""SELECT '{rule}' AS rule_id, '{severity}' AS severity, {PAYLOAD},
 'Sequence complete ({steps} steps, final: {final})' AS detail,
 '{{"sequence_steps":{steps},"final_step":"{final}"}}' AS context FROM {source}"""


DAY_MS = DAY_SECONDS * 1000
SLOW = single_sql("slow", "high", "event_type = 'rag_retrieval' AND latency_ms > 300")
CLAUDE = single_sql("claude", "low", "model_id LIKE 'claude%' AND input_tokens > 1000")
SHELL = single_sql("shell", "critical", "tool_name IN ('shell_run', 'code_execute')")
BUSY = temporal_sql("busy", "medium", "event_type = 'tool_invocation'", "agent_id", DAY_MS,
                    "n >= 10", "1.00:00:00")
RATE = temporal_sql("rate", "medium", "event_type = 'llm_call'", "agent_id", DAY_MS,
                    "n / 1440.0 >= 0.0055", "1.00:00:00")
FLOOD = temporal_sql("flood", "low", "event_type = 'external_api_call'", "1", 5_400_500,
                     "n >= 6", "01:30:00.5000000")
PAIR_WALK = walk_sql("pair", ["rag_retrieval", "external_api_call"], DAY_MS)
TRIPLE_WALK = walk_sql(
    "triple", ["rag_retrieval", "tool_invocation", "external_api_call"], 2 * DAY_MS)
PAIR = sequence_sql("pair", "critical", "pair", 2, "call")
TRIPLE = sequence_sql("triple", "high", "triple", 3, "call")
MATCHES = f"""RECURSIVE {AE}, {PAIR_WALK}, {TRIPLE_WALK}, matches AS ({SLOW} UNION ALL {CLAUDE}
 UNION ALL {SHELL} UNION ALL {BUSY} UNION ALL {RATE} UNION ALL {FLOOD}
 UNION ALL {PAIR} UNION ALL {TRIPLE})"""
DEDUP = f"""{MATCHES}, printed AS (SELECT *, upper(substr(sha256(concat(rule_id, ':', agent_id, ':',
 upper(severity[1]), severity[2:])), 1, 16)) AS fingerprint FROM matches),
 turns AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ms, event_id) AS rn
 FROM printed), kept_walk AS (SELECT fingerprint, rn, ms AS accepted, TRUE AS keep FROM turns
 WHERE rn = 1 UNION ALL SELECT t.fingerprint, t.rn,
  CASE WHEN t.ms >= w.accepted + {LIMITS.dedup_ms} THEN t.ms ELSE w.accepted END,
  t.ms >= w.accepted + {LIMITS.dedup_ms}
 FROM kept_walk w JOIN turns t ON t.fingerprint = w.fingerprint AND t.rn = w.rn + 1),
 survivors AS (SELECT turns.* FROM turns JOIN kept_walk USING (fingerprint, rn) WHERE keep)"""
STAGED = f"""{DEDUP}, moments AS (SELECT rule_id, ms, count(*) OVER (PARTITION BY rule_id ORDER BY ms
 RANGE BETWEEN {LIMITS.throttle_ms - 1} PRECEDING AND CURRENT ROW) AS throttle_count
 FROM (SELECT DISTINCT rule_id, ms FROM survivors)),
 suppressions AS ({SUPPRESSIONS_SQL}),
 staged AS (SELECT s.*, throttle_count, CASE WHEN throttle_count > {LIMITS.throttle_limit}
  THEN 'throttled' WHEN EXISTS (SELECT 1 FROM suppressions x
   WHERE (x.rule_id = s.rule_id OR x.rule_id IS NULL) AND (x.agent_id = s.agent_id
   OR x.agent_id IS NULL) AND NOT (x.rule_id IS NULL AND x.agent_id IS NULL)
   AND x.created_at <= s.timestamp AND s.timestamp < x.expires_at)
  THEN 'suppressed' ELSE 'created' END AS stage
 FROM survivors s JOIN moments USING (rule_id, ms))"""
ID_PARTS = ", '-', ".join(
    f"substr(digest, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
CREATED = f"""{STAGED}, identified AS (SELECT *, sha256(concat(rule_id, ':', event_id)) AS digest
 FROM staged WHERE stage = 'created'), named AS (SELECT *, concat({ID_PARTS}) AS alert_id
 FROM identified), created AS (SELECT alert_id, rule_id, concat('Rule ', rule_id) AS rule_name,
 severity, 'open' AS status, concat('[', upper(severity), '] Rule ', rule_id, ': ', agent_name)
 AS title, detail, context, agent_id, agent_name, session_id, event_id, timestamp AS triggered_at,
 ms, CASE WHEN rule_id = 'slow' THEN 'latency' END AS category,
 count(*) OVER (PARTITION BY agent_id ORDER BY ms RANGE BETWEEN {DAY_MS} PRECEDING AND CURRENT ROW)
  - count(*) OVER (PARTITION BY agent_id, ms)
  + row_number() OVER (PARTITION BY agent_id, ms ORDER BY alert_id) - 1 AS recent_alert_count,
 (SELECT count(*) FROM ae e WHERE e.session_id = n.session_id AND (e.ms < n.ms OR
   (e.ms = n.ms AND e.event_id <= n.event_id))) AS session_event_count,
 coalesce((SELECT string_agg(tool_name, ',' ORDER BY tool_name) FROM (SELECT DISTINCT tool_name
   FROM ae e WHERE e.session_id = n.session_id AND tool_name IS NOT NULL
   AND e.timestamp <= n.timestamp AND e.timestamp >= n.timestamp - INTERVAL 1 HOUR)), '')
   AS recent_tools
 FROM named n)"""


@query("eval_single", f"WITH {AE} {SLOW} UNION ALL {CLAUDE} UNION ALL {SHELL}")
def eval_single_query(spark, sf_dir):
    return eval_single(events_of(spark, sf_dir), loaded(spark))


def temporal(name: str, sql: str) -> None:
    query(f"eval_temporal_{name}", f"WITH {AE} {sql}")(
        lambda spark, sf_dir: eval_temporal(events_of(spark, sf_dir), loaded(spark, name)))


temporal("busy", BUSY)
temporal("rate", RATE)
temporal("flood", FLOOD)


def sequence(name: str, walk: str, sql: str) -> None:
    query(f"eval_sequence_{name}", f"WITH RECURSIVE {AE}, {walk} {sql}")(
        lambda spark, sf_dir: eval_sequence(events_of(spark, sf_dir), loaded(spark, name)))


sequence("pair", PAIR_WALK, PAIR)
sequence("triple", TRIPLE_WALK, TRIPLE)


@query("evaluate", f"WITH {MATCHES} SELECT * FROM matches")
def evaluate_query(spark, sf_dir):
    return evaluate(events_of(spark, sf_dir), loaded(spark))


@query("sliding_count", f"""WITH {AE} SELECT event_id, count(*) OVER (PARTITION BY session_id
 ORDER BY ms RANGE BETWEEN {DAY_MS - 1} PRECEDING AND CURRENT ROW) - count(*) OVER (
 PARTITION BY session_id, ms) + row_number() OVER (PARTITION BY session_id, ms ORDER BY event_id) AS n
 FROM ae""")
def sliding_count_query(spark, sf_dir):
    rows = events_of(spark, sf_dir).select(
        "session_id", "event_id", event_millis().alias("ms"),
        F.lit(DAY_MS).cast("long").alias("window_ms"))
    counted = sliding_count(rows, ["session_id"], "ms", "window_ms", ["event_id"], "n")
    return counted.select("event_id", "n")


@query("dedup", f"WITH {DEDUP} SELECT rule_id, event_id, fingerprint, ms FROM survivors")
def dedup_query(spark, sf_dir):
    return dedup(matches_of(spark, sf_dir), LIMITS.dedup_ms).select(
        "rule_id", "event_id", "fingerprint", "ms")


@query("throttle", f"""WITH {STAGED} SELECT rule_id, event_id, throttle_count FROM staged
 WHERE stage <> 'throttled'""")
def throttle_query(spark, sf_dir):
    survivors = cut_lineage(dedup(matches_of(spark, sf_dir), LIMITS.dedup_ms))
    return throttle(survivors, LIMITS.throttle_limit, LIMITS.throttle_ms).select(
        "rule_id", "event_id", "throttle_count")


@query("suppress", f"""WITH {MATCHES}, suppressions AS ({SUPPRESSIONS_SQL}) SELECT rule_id, event_id
 FROM matches s WHERE NOT EXISTS (SELECT 1 FROM suppressions x
 WHERE (x.rule_id = s.rule_id AND x.agent_id IS NULL OR x.agent_id = s.agent_id AND x.rule_id IS NULL
  OR x.rule_id = s.rule_id AND x.agent_id = s.agent_id)
 AND x.created_at <= s.timestamp AND s.timestamp < x.expires_at)""")
def suppress_query(spark, sf_dir):
    return suppress(matches_of(spark, sf_dir), spark.sql(SUPPRESSIONS_SQL)).select(
        "rule_id", "event_id")


def detection_of(spark, sf_dir):
    return run_detection(
        events_of(spark, sf_dir), rules_of(spark), spark.sql(SUPPRESSIONS_SQL), limits=LIMITS)


@query("stage_counters", f"""WITH {STAGED}, ends AS (SELECT stage, severity, count(*) AS n
 FROM staged GROUP BY 1, 2) SELECT 'received' AS stage, 'all' AS severity, count(*) AS n FROM matches
 UNION ALL SELECT 'deduplicated', 'all', (SELECT count(*) FROM matches) - count(*) FROM survivors
 UNION ALL SELECT stage, 'all', CAST(sum(n) AS BIGINT) FROM ends GROUP BY 1
 UNION ALL SELECT stage, severity, n FROM ends WHERE stage = 'created'""")
def stage_counters_query(spark, sf_dir):
    return detection_of(spark, sf_dir).counters()


def flat_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        *[c for c in alerts.columns if c not in ("labels", "recent_tools")],
        F.col("labels")["category"].alias("category"),
        F.array_join("recent_tools", ",").alias("recent_tools"))


@query("created_alerts", f"WITH {CREATED} SELECT * EXCLUDE (ms) FROM created")
def created_alerts_query(spark, sf_dir):
    return flat_alerts(detection_of(spark, sf_dir).alerts)


@query("outbox", f"""WITH {CREATED}, channels AS (SELECT * FROM (VALUES ('live', 0), ('webhook', 1),
 ('slack', 2), ('pagerduty', 3)) AS c(channel, least)) SELECT alert_id, channel,
 'pending' AS state, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS next_attempt_at
 FROM created JOIN channels ON least <= CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2
 WHEN 'medium' THEN 1 ELSE 0 END""")
def outbox_query(spark, sf_dir):
    return detection_of(spark, sf_dir).outbox()


ROUTED = f"""{ALERTS}, channels AS (SELECT * FROM (VALUES ('live', 0), ('webhook', 1),
 ('slack', 2), ('pagerduty', 3)) AS c(channel, least)), routed AS (SELECT alert_id, channel,
 triggered_at FROM alerts JOIN channels ON least <= CASE severity WHEN 'critical' THEN 3
 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)"""


@query("route", f"WITH {ROUTED} SELECT alert_id, channel FROM routed")
def route_query(spark, sf_dir):
    return route(alerts_of(spark, sf_dir)).select("alert_id", "channel")


@query("live_feed", f"""WITH {ALERTS}, topics AS (SELECT alert_id, triggered_at,
 unnest(['all', concat('agent:', agent_id), concat('severity:', severity)]) AS topic FROM alerts)
 SELECT topic, alert_id, position FROM (SELECT *, row_number() OVER (PARTITION BY topic
 ORDER BY triggered_at DESC, alert_id) AS position FROM topics) WHERE position <= 50""")
def live_feed_query(spark, sf_dir):
    return live_feed(alerts_of(spark, sf_dir)).select("topic", "alert_id", "position")


@query("retry_plan", f"""WITH {ROUTED}, tries AS (SELECT *, CAST(right(alert_id, 1) AS INT) AS d
 FROM routed) SELECT alert_id, channel, CASE WHEN d < 3 THEN 'sent' WHEN d < 5 THEN 'failed'
 ELSE 'pending' END AS state, CASE WHEN d < 3 THEN 0 WHEN d < 5 THEN 3 WHEN d < 7 THEN 2
 WHEN d < 9 THEN 1 ELSE 0 END AS attempts, CASE WHEN d BETWEEN 5 AND 6
 THEN triggered_at + INTERVAL 10 MINUTE + INTERVAL 120 SECOND WHEN d BETWEEN 7 AND 8
 THEN triggered_at + INTERVAL 10 MINUTE + INTERVAL 30 SECOND END AS next_attempt_at FROM tries""")
def retry_plan_query(spark, sf_dir):
    # The last digit of the alert says how its deliveries go, with up to two earlier failures.
    digit = F.right("alert_id", F.lit(1)).cast("int")
    routed = route(alerts_of(spark, sf_dir))
    outbox = new_outbox(routed).withColumn(
        "attempts", F.when(digit.isin(3, 4), 2).when(digit.isin(5, 6), 1).otherwise(0))
    outcomes = routed.where(digit < 9).select(
        "alert_id", "channel", (digit < 3).alias("delivered"),
        (F.col("triggered_at") + F.expr("INTERVAL 10 MINUTES")).alias("at"))
    return retry_plan(outbox, outcomes)


COMMANDS_SQL = """SELECT alert_id, CASE WHEN alert_id LIKE '%2' THEN 'acknowledged' ELSE 'resolved' END
 AS target, triggered_at + INTERVAL 3 HOUR AS decided_at, concat('note ', alert_id) AS note FROM {alerts}
 WHERE right(alert_id, 1) IN ('2', '4', '5', '7')"""


@query("transition_alerts", f"""WITH {ALERTS}, commands AS ({COMMANDS_SQL.format(alerts='alerts')}),
 tried AS (SELECT a.*, target, decided_at, note, target IS NOT NULL AND (status = 'open' OR
  (status = 'acknowledged' AND target = 'resolved')) AS legal
  FROM alerts a LEFT JOIN commands USING (alert_id))
 SELECT alert_id, CASE WHEN legal THEN target ELSE status END AS status,
 CASE WHEN legal AND target = 'acknowledged' THEN decided_at ELSE acknowledged_at END AS acknowledged_at,
 CASE WHEN legal AND target = 'resolved' THEN decided_at ELSE resolved_at END AS resolved_at,
 CASE WHEN legal AND target = 'resolved' THEN note ELSE resolution_note END AS resolution_note
 FROM tried""")
def transition_alerts_query(spark, sf_dir):
    alerts = alerts_of(spark, sf_dir)
    updated, _ = transition_alerts(alerts, spark.sql(COMMANDS_SQL, alerts=alerts))
    return updated.select(
        "alert_id", "status", "acknowledged_at", "resolved_at", "resolution_note")


@query("rejected_transitions", f"""WITH {ALERTS}, commands AS ({COMMANDS_SQL.format(alerts='alerts')})
 SELECT alert_id, target, concat('Cannot move from ', status, ' to ', target) AS error
 FROM commands JOIN alerts USING (alert_id) WHERE NOT (status = 'open' OR
 (status = 'acknowledged' AND target = 'resolved'))""")
def rejected_transitions_query(spark, sf_dir):
    alerts = alerts_of(spark, sf_dir)
    return transition_alerts(alerts, spark.sql(COMMANDS_SQL, alerts=alerts))[1]
