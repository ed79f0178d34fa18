"""Scalar expressions, predicates of the condition language, searches and views."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import (
    AE, ALERTS, AS_OF, RAW, alerts_of, events_of, links_of, query,
)
from sentryspark.functions.alert_text import (
    alert_detail, alert_fingerprint, alert_title, rule_labels,
)
from sentryspark.functions.fields import (
    parse_number, resolve_field, severity_order, severity_text, time_bucket, with_property_map,
)
from sentryspark.functions.json_containment import json_contains, json_or_empty
from sentryspark.functions.predicates import parse_condition, predicate
from sentryspark.operators.rules import prepare_events
from sentryspark.operators.search import (
    ALERT_PAGE_MAX, EVENT_PAGE_MAX, alert_view, event_view, last_hours, list_alerts,
    list_sessions, newest_first, page_rows, search_events, session_view,
)
from sentryspark.operators.sessions import session_alert_rollup, sessions
from sentryspark.plans.adapter import raw_events
from sentryspark.plans.anomaly import z_score
from sentryspark.sources.catalog import Rule, load_lists


def field(name: str, operator: str, value) -> dict:
    return {"type": "field", "field": name, "operator": operator, "value": value}


# name -> (condition, WHERE clause); ``k`` is the number inside the properties.
CONDITIONS = {
    "cond_eq": (field("toolName", "Eq", "web_search"), "tool_name = 'web_search'"),
    "cond_eq_double_text": (field("latencyMs", "Eq", 100), "latency_ms = 100"),
    "cond_any_of_whole_doubles": (
        {"type": "any_of", "field": "latencyMs", "values": [str(n) for n in range(1000)]},
        "latency_ms = floor(latency_ms) AND latency_ms < 1000"),
    "cond_eq_property": (field("properties.k", "Eq", 42), "k = 42"),
    "cond_neq": (field("toolName", "Neq", "web_search"),
                 "tool_name IS NOT NULL AND tool_name <> 'web_search'"),
    "cond_contains": (field("modelId", "Contains", "CLAUDE"),
                      "model_id IS NOT NULL AND contains(lower(model_id), 'claude')"),
    "cond_starts_with": (field("toolName", "StartsWith", "Code"), "lower(tool_name) LIKE 'code%'"),
    "cond_ends_with": (field("modelId", "EndsWith", "-TURBO"), "lower(model_id) LIKE '%-turbo'"),
    "cond_regex": (field("toolName", "Regex", "^(file|shell)_"),
                   "regexp_matches(tool_name, '^(file|shell)_')"),
    "cond_gt": (field("latencyMs", "Gt", 500.5), "latency_ms > 500.5"),
    "cond_lt": (field("properties.k", "Lt", 10), "k < 10"),
    "cond_gte": (field("inputTokens", "Gte", 1000), "input_tokens >= 1000"),
    "cond_lte": (field("outputTokens", "Lte", 440), "output_tokens <= 440"),
    "cond_gt_not_numeric": (
        {"type": "or", "conditions": [field("toolName", "Gt", 1), field("k", "Gt", 90)]}, "k > 90"),
    "cond_threshold_above": ({"type": "threshold", "field": "latencyMs", "limit": 800.0},
                             "latency_ms > 800"),
    "cond_threshold_below": (
        {"type": "threshold", "field": "latencyMs", "limit": 50, "above": False},
        "latency_ms < 50"),
    "cond_exists": ({"type": "exists", "field": "modelId"}, "model_id IS NOT NULL"),
    "cond_exists_property": ({"type": "exists", "field": "properties.k"}, "k IS NOT NULL"),
    "cond_any_of": ({"type": "any_of", "field": "modelId", "values": ["gpt-4", "gpt-4-turbo"]},
                    "model_id IN ('gpt-4', 'gpt-4-turbo')"),
    "cond_and": ({"type": "and", "conditions": [
        field("eventType", "Eq", "tool_invocation"), field("latencyMs", "Gt", 300)]},
        "event_type = 'tool_invocation' AND latency_ms > 300"),
    "cond_and_empty": ({"type": "and", "conditions": []}, "TRUE"),
    "cond_or": ({"type": "or", "conditions": [
        field("eventType", "Eq", "llm_call"), field("toolName", "Eq", "shell_run")]},
        "event_type = 'llm_call' OR coalesce(tool_name = 'shell_run', FALSE)"),
    "cond_or_empty": ({"type": "or", "conditions": []}, "FALSE"),
    "cond_not": ({"type": "not", "inner": field("toolName", "Eq", "web_search")},
                 "NOT coalesce(tool_name = 'web_search', FALSE)"),
    "cond_tree": ({"type": "and", "conditions": [
        {"type": "not", "inner": {"type": "exists", "field": "toolName"}},
        {"type": "or", "conditions": [
            {"type": "threshold", "field": "latencyMs", "limit": 1000},
            {"type": "any_of", "field": "agentId", "values": ["agent-1", "agent-2"]}]}]},
        "tool_name IS NULL AND (coalesce(latency_ms > 1000, FALSE) "
        "OR agent_id IN ('agent-1', 'agent-2'))"),
}

KEYED = f"{AE}, keyed AS (SELECT *, CAST(regexp_extract(properties, '([0-9]+)', 1) AS INT) AS k FROM ae)"


def register_condition(name: str, tree: dict, where: str) -> None:
    condition = parse_condition(json.dumps(tree))

    @query(name, f"WITH {KEYED} SELECT event_id, event_type FROM keyed WHERE {where}")
    def run(spark, sf_dir):
        events = with_property_map(events_of(spark, sf_dir))
        return events.where(predicate(condition)).select("event_id", "event_type")


for _name, (_tree, _where) in CONDITIONS.items():
    register_condition(_name, _tree, _where)


# Managed lists taken from the data: sessions that saw a very slow retrieval, and a disabled
# list of all agents.
LISTS_SQL = """SELECT 'slow' AS id, 'Slow sessions' AS name, '' AS description, TRUE AS enabled
 UNION ALL SELECT 'off', 'All agents', '', FALSE
 UNION ALL SELECT 'none', 'Nobody', '', TRUE"""
MEMBERS_SQL = """SELECT DISTINCT 'slow' AS list_id, session_id AS value FROM {ae}
 WHERE event_type = 'rag_retrieval' AND latency_ms > 1500
 UNION ALL SELECT DISTINCT 'off', agent_id FROM {ae}"""
MEMBERS = f"{AE}, lists AS ({LISTS_SQL}), members AS ({MEMBERS_SQL.format(ae='ae')})"


def lists_of(spark, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return spark.sql(LISTS_SQL), spark.sql(MEMBERS_SQL, ae=events)


def listed(list_id: str, name: str, negated: bool):
    def run(spark, sf_dir):
        events = events_of(spark, sf_dir)
        members = load_lists(*lists_of(spark, events))
        tree = {"type": "list", "field": name, "listId": list_id, "negated": negated}
        rules = [Rule("r", "r", "low", "SingleEvent", tree)]
        prepared, member = prepare_events(events, rules, members)
        return prepared.where(predicate(tree, member)).select("event_id")

    return run


IN_LIST = f"WITH {MEMBERS} SELECT event_id FROM ae WHERE"
ENABLED = "SELECT value FROM members JOIN lists ON id = list_id WHERE enabled AND list_id ="
query("cond_in_list", f"{IN_LIST} session_id IN ({ENABLED} 'slow')")(
    listed("slow", "sessionId", False))
query("cond_not_in_list", f"{IN_LIST} session_id NOT IN ({ENABLED} 'slow')")(
    listed("slow", "sessionId", True))
query("cond_in_disabled_list", f"{IN_LIST} FALSE")(listed("off", "agentId", False))
query("cond_not_in_missing_list", f"{IN_LIST} TRUE")(listed("missing", "toolName", True))


@query("load_lists", f"""WITH {MEMBERS} SELECT list_id, value FROM members
 JOIN lists ON id = list_id WHERE enabled""")
def load_lists_query(spark, sf_dir):
    return load_lists(*lists_of(spark, events_of(spark, sf_dir)))


@query("list_summary", f"""WITH {MEMBERS} SELECT id, name, description, enabled,
 count(value) AS member_count FROM lists LEFT JOIN members ON id = list_id GROUP BY ALL""")
def list_summary_query(spark, sf_dir):
    from sentryspark.sources.catalog import list_summary
    return list_summary(*lists_of(spark, events_of(spark, sf_dir)))


@query("normalize_event_type", f"WITH {AE} SELECT event_id, raw_event_type, event_type FROM ae")
def normalize_event_type_query(spark, sf_dir):
    return events_of(spark, sf_dir).select("event_id", "raw_event_type", "event_type")


@query("resolve_field", f"""WITH {KEYED} SELECT event_id, CAST(k AS STRING) AS k_text,
 CAST(k AS DOUBLE) AS k_number, tool_name AS tool_text, CAST(NULL AS STRING) AS missing_text,
 FALSE AS missing_present, CAST(input_tokens AS STRING) AS input_text FROM keyed""")
def resolve_field_query(spark, sf_dir):
    by_key, tool, missing = (resolve_field(p) for p in ("properties.k", "toolName", "traceId"))
    return with_property_map(events_of(spark, sf_dir)).select(
        "event_id", F.expr(by_key.text).alias("k_text"), F.expr(by_key.number).alias("k_number"),
        F.expr(tool.text).alias("tool_text"), F.expr(missing.text).alias("missing_text"),
        F.expr(missing.present).alias("missing_present"),
        F.expr(resolve_field("inputTokens").text).alias("input_text"),
    )


@query("parse_number", f"""WITH {KEYED}, texts AS (SELECT event_id, k, CASE k % 5
 WHEN 0 THEN concat(k, 'd') WHEN 1 THEN concat(' ', k, ' ') WHEN 2 THEN concat('-', k, '.5')
 WHEN 3 THEN concat(k, 'e2') ELSE tool_name END AS txt FROM keyed)
 SELECT event_id, txt, CASE k % 5 WHEN 1 THEN CAST(k AS DOUBLE) WHEN 2 THEN -(k + 0.5)
 WHEN 3 THEN k * 100.0 END AS number FROM texts""")
def parse_number_query(spark, sf_dir):
    k = F.regexp_extract("properties", "([0-9]+)", 1)
    kind = k.cast("int") % 5
    text = (
        F.when(kind == 0, F.concat(k, F.lit("d"))).when(kind == 1, F.concat(F.lit(" "), k, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("-"), k, F.lit(".5"))).when(kind == 3, F.concat(k, F.lit("e2")))
        .otherwise(F.col("tool_name"))
    )
    rows = events_of(spark, sf_dir).select("event_id", text.alias("txt"))
    return rows.withColumn("number", parse_number("txt"))


@query("severity_maps", f"""WITH {ALERTS}, s AS (SELECT alert_id,
 CASE WHEN length(alert_id) % 2 = 0 THEN upper(severity) ELSE concat(severity, '?') END AS given
 FROM alerts) SELECT alert_id, CASE WHEN given LIKE '%?' THEN 'medium' ELSE lower(given) END
 AS severity, CASE lower(given) WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3
 ELSE 0 END AS severity_order FROM s""")
def severity_maps_query(spark, sf_dir):
    given = F.when(F.length("alert_id") % 2 == 0, F.upper("severity")).otherwise(
        F.concat("severity", F.lit("?")))
    return alerts_of(spark, sf_dir).select(
        "alert_id", severity_text(given).alias("severity"),
        severity_order(F.lower(given)).alias("severity_order"))


@query("alert_texts", f"""WITH {ALERTS} SELECT alert_id,
 concat('[', upper(severity), '] ', CASE WHEN rule_id = 'rule-api' THEN rule_name
   ELSE 'Rule triggered' END, ': ', agent_name) AS title,
 coalesce(detail, 'Rule conditions matched') AS detail,
 upper(substr(sha256(concat(rule_id, ':', agent_id, ':', upper(severity[1]), severity[2:])), 1, 16))
   AS fingerprint FROM alerts""")
def alert_texts_query(spark, sf_dir):
    name = F.when(F.col("rule_id") == "rule-api", F.col("rule_name"))
    return alerts_of(spark, sf_dir).select(
        "alert_id", alert_title(F.col("severity"), name, F.col("agent_name")).alias("title"),
        alert_detail(F.col("detail")).alias("detail"),
        alert_fingerprint(F.col("rule_id"), F.col("agent_id"), F.col("severity"))
        .alias("fingerprint"))


@query("rule_labels", f"""WITH {ALERTS} SELECT alert_id,
 CASE WHEN labels IS NOT NULL AND alert_id LIKE '%0' THEN
   CASE WHEN rule_id = 'rule-api' THEN 'external_api_call' ELSE 'tool_invocation' END END
   AS category FROM alerts""")
def rule_labels_query(spark, sf_dir):
    actions = F.when(F.col("alert_id").endswith("0"), F.concat(
        F.lit('[{"type":"webhook","labels":{"category":"no"}},{"type":"create_alert","labels":'),
        F.col("labels"), F.lit("}]"))).otherwise(F.lit("not json"))
    return alerts_of(spark, sf_dir).select(
        "alert_id", rule_labels(actions)["category"].alias("category"))


@query("json_or_empty", f"""WITH {ALERTS} SELECT alert_id,
 CASE WHEN context LIKE '%{{%' THEN context ELSE '{{}}' END AS context FROM alerts""")
def json_or_empty_query(spark, sf_dir):
    return alerts_of(spark, sf_dir).select(
        "alert_id", json_or_empty(F.col("context")).alias("context"))


@query("z_score", f"""WITH {AE}, s AS (SELECT agent_id, avg(latency_ms) AS m,
 stddev_samp(latency_ms) AS d FROM ae GROUP BY 1)
 SELECT event_id, round((latency_ms - m) / d, 6) AS z, 0.0 AS z_flat FROM ae JOIN s USING (agent_id)""")
def z_score_query(spark, sf_dir):
    events = events_of(spark, sf_dir)
    stats = events.groupBy("agent_id").agg(
        F.avg("latency_ms").alias("m"), F.stddev_samp("latency_ms").alias("d"))
    return events.join(stats, "agent_id").select(
        "event_id", z_score(F.col("latency_ms"), F.col("m"), F.col("d")).alias("z"),
        z_score(F.col("m"), F.col("m"), F.lit(0.0)).alias("z_flat"))


@query("time_bucket", f"""WITH {AE} SELECT event_id, date_trunc('hour', timestamp) AS by_hour,
 CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS by_day FROM ae""")
def time_bucket_query(spark, sf_dir):
    return events_of(spark, sf_dir).select(
        "event_id", time_bucket("hour").alias("by_hour"), time_bucket("day").alias("by_day"))


START, END = datetime(2024, 1, 10, 6), datetime(2024, 1, 20, 18)
RANGE = "timestamp BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'"


@query("search_events", f"""WITH {AE} SELECT event_id, timestamp FROM ae WHERE {RANGE}
 AND agent_id = 'agent-3' AND event_type = 'tool_invocation' AND tool_name = 'web_search'""")
def search_events_query(spark, sf_dir):
    return search_events(
        events_of(spark, sf_dir), AS_OF, START, END, agent_id="agent-3",
        event_type="tool_invocation", session_id=" ", tool_name="web_search",
    ).select("event_id", "timestamp")


@query("search_last_hour", f"""WITH {AE} SELECT event_id FROM ae
 WHERE timestamp BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 12:00:00'""")
def search_last_hour_query(spark, sf_dir):
    return search_events(events_of(spark, sf_dir), datetime(2024, 1, 15, 12)).select("event_id")


@query("json_contains", f"WITH {KEYED} SELECT event_id FROM keyed WHERE {RANGE} AND k = 7")
def json_contains_query(spark, sf_dir):
    return search_events(
        events_of(spark, sf_dir), AS_OF, START, END, properties='{"k": 7}').select("event_id")


@query("json_contains_nested", f"""WITH {KEYED} SELECT event_id FROM keyed
 WHERE k = 7 AND tool_name IS NOT NULL""")
def json_contains_nested_query(spark, sf_dir):
    nested = F.to_json(F.struct(
        F.from_json("properties", "k BIGINT").alias("p"),
        F.array("tool_name", "agent_id").alias("names"),
        F.array(F.struct(F.col("tool_name").isNotNull().alias("used"))).alias("flags"),
    ))
    pattern = '{"p": {"k": 7.0}, "flags": [{"used": true}], "names": []}'
    return events_of(spark, sf_dir).where(json_contains(nested, pattern)).select("event_id")


@query("list_alerts", f"""WITH {ALERTS} SELECT alert_id FROM alerts
 WHERE status = 'open' AND agent_id = 'agent-4'""")
def list_alerts_query(spark, sf_dir):
    return list_alerts(
        alerts_of(spark, sf_dir), status="Open", severity="severe", agent_id="agent-4",
    ).select("alert_id")


SESSIONS = f"""{ALERTS}, arrivals AS (SELECT *, row_number() OVER (PARTITION BY session_id
 ORDER BY timestamp, event_id) AS rn FROM ae), plain AS (SELECT session_id,
 max(CASE WHEN rn = 1 THEN agent_id END) AS agent_id,
 max(CASE WHEN rn = 1 THEN agent_name END) AS agent_name,
 min(timestamp) AS started_at, max(timestamp) AS last_event_at, count(*) AS event_count,
 '{{}}' AS metadata FROM arrivals GROUP BY 1), marks AS (SELECT session_id, count(*) AS n,
 max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS top
 FROM alerts GROUP BY 1), sessions AS (SELECT plain.*, n IS NOT NULL AS has_alerts,
 coalesce(n, 0) AS alert_count, CASE top WHEN 3 THEN 'critical' WHEN 2 THEN 'high'
 WHEN 1 THEN 'medium' WHEN 0 THEN 'low' END AS max_severity FROM plain LEFT JOIN marks USING (session_id))"""


def sessions_of(spark, sf_dir) -> DataFrame:
    return session_alert_rollup(sessions(events_of(spark, sf_dir)), alerts_of(spark, sf_dir))


query("sessions", f"WITH {SESSIONS} SELECT * FROM plain")(
    lambda spark, sf_dir: sessions(events_of(spark, sf_dir)))
query("session_alert_rollup", f"WITH {SESSIONS} SELECT * FROM sessions")(sessions_of)
query("session_view", f"""WITH {SESSIONS} SELECT session_id, agent_id, agent_name, started_at,
 last_event_at, event_count, has_alerts, alert_count, max_severity, metadata FROM sessions""")(
    lambda spark, sf_dir: session_view(sessions_of(spark, sf_dir)))
query("list_sessions", f"""WITH {SESSIONS} SELECT session_id FROM sessions
 WHERE agent_id = 'agent-2' AND has_alerts""")(
    lambda spark, sf_dir: list_sessions(sessions_of(spark, sf_dir), "agent-2", True)
    .select("session_id"))


@query("last_hours", f"""WITH {AE} SELECT event_id FROM ae
 WHERE timestamp >= TIMESTAMP '2024-01-28 00:00:00'""")
def last_hours_query(spark, sf_dir):
    return last_hours(events_of(spark, sf_dir), "timestamp", 72, AS_OF).select("event_id")


@query("page_events", f"""WITH {AE} SELECT event_id, timestamp FROM ae
 ORDER BY timestamp DESC, event_id LIMIT 500 OFFSET 500""")
def page_events_query(spark, sf_dir):
    events = events_of(spark, sf_dir).select("event_id", "timestamp")
    return page_rows(events, newest_first(("timestamp", "event_id")), 2, 1000, EVENT_PAGE_MAX)


@query("page_alerts", f"""WITH {ALERTS} SELECT alert_id, triggered_at FROM alerts
 ORDER BY triggered_at DESC, alert_id LIMIT 50 OFFSET 100""")
def page_alerts_query(spark, sf_dir):
    alerts = alerts_of(spark, sf_dir).select("alert_id", "triggered_at")
    return page_rows(alerts, newest_first(("triggered_at", "alert_id")), 3, 50, ALERT_PAGE_MAX)


@query("event_view", f"""WITH {AE} SELECT event_id, timestamp, agent_id, agent_name, session_id,
 event_type, model_id, input_tokens, output_tokens, latency_ms, tool_name, properties FROM ae""")
def event_view_query(spark, sf_dir):
    return event_view(events_of(spark, sf_dir))


@query("alert_view", f"""WITH {ALERTS} SELECT alert_id, rule_id, rule_name, severity, status, title,
 detail, CASE WHEN context LIKE '%{{%' THEN context ELSE '{{}}' END AS context, agent_id,
 session_id, triggered_at, acknowledged_at, resolved_at, assigned_to, resolution_note,
 coalesce(labels, '{{}}') AS labels, suppressed, suppressed_by, suppression_expires_at FROM alerts""")
def alert_view_query(spark, sf_dir):
    return alert_view(alerts_of(spark, sf_dir))


@query("raw_scan", f"WITH {RAW} SELECT event_id, timestamp, raw_event_type, trace_id FROM raw WHERE {RANGE}")
def raw_scan_query(spark, sf_dir):
    from sentryspark.operators.search import in_time_range
    return in_time_range(raw_events(spark, sf_dir), "timestamp", START, END).select(
        "event_id", "timestamp", "raw_event_type", "trace_id")


@query("alerts_with_events", f"""WITH {ALERTS} SELECT alert_id, severity,
 event_id AS event_ids, 1 AS n_events FROM alerts""")
def alerts_with_events_query(spark, sf_dir):
    from sentryspark.operators.sessions import alerts_with_events
    alerts = alerts_of(spark, sf_dir)
    joined = alerts_with_events(alerts, links_of(alerts))
    return joined.select(
        "alert_id", "severity", F.array_join("events.event_id", ",").alias("event_ids"),
        F.size("events").alias("n_events"))
