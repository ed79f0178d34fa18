"""Rule catalogs with defects, dead-letter headers, rendered messages, reads of stored tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import AE, ALERTS, alerts_of, events_of, links_of, query
from checks.conditions import KEYED, SESSIONS
from checks.reports import TIMELINE
from checks.stores import messages
from sentryspark.functions.alert_text import (
    render_live, render_pagerduty, render_slack, render_webhook,
)
from sentryspark.operators.sessions import session_timeline
from sentryspark.schema import RULES
from sentryspark.session import new_folder
from sentryspark.sources.batches import Batch, table_folders
from sentryspark.sources.catalog import load_rules, rule_catalog_check
from sentryspark.sources.event_store import (
    DAY, TABLE, apply_retention, read_events, stored_form, write_events,
)
from sentryspark.sources.raw import dead_letters, decode_events
from sentryspark.sources.session_store import (
    read_marked_sessions, read_session_events, session_parts,
)

# One rule per tool and agent that used it; defects go by the agent's number.
TOOL_RULES = f"""WITH {AE}, used AS (SELECT DISTINCT agent_id, tool_name,
 CAST(regexp_extract(agent_id, '([0-9]+)', 1) AS INT) AS n FROM ae WHERE tool_name IS NOT NULL),
 rules AS (SELECT concat(agent_id, '/', tool_name) AS id,
 CASE WHEN n = 1 THEN '  ' ELSE tool_name END AS name,
 CASE WHEN n = 2 THEN 'urgent' WHEN n = 3 THEN 'HIGH' ELSE 'low' END AS severity,
 CASE WHEN n = 4 THEN 'Sometimes' WHEN n = 5 THEN 'Temporal' WHEN n = 6 THEN 'Sequence' ELSE 'SingleEvent' END
   AS evaluation_type,
 CASE n WHEN 7 THEN 'not json' WHEN 8 THEN concat(chr(123), '"type":"exists"', chr(125))
   WHEN 9 THEN concat(chr(123), '"type":"field","field":"toolName","operator":"Regex","value":"(', tool_name, '"', chr(125))
   ELSE concat(chr(123), '"type":"field","field":"toolName","operator":"Eq","value":"', tool_name, '"', chr(125)) END
   AS condition_json, CASE WHEN n = 0 THEN NULL ELSE 'checks' END AS created_by, n FROM used)"""


def tool_rules(spark, sf_dir) -> DataFrame:
    """``TOOL_RULES`` as a rule table, derived from the events by Spark."""
    events = events_of(spark, sf_dir)
    used = events.where("tool_name IS NOT NULL").select(
        "agent_id", "tool_name", F.regexp_extract("agent_id", "([0-9]+)", 1).cast("int").alias("n")).distinct()
    leaf = lambda operator, value: F.to_json(F.struct(
        F.lit("field").alias("type"), F.lit("toolName").alias("field"), F.lit(operator).alias("operator"),
        value.alias("value")))
    n, tool = F.col("n"), F.col("tool_name")
    given = {
        "id": F.concat("agent_id", F.lit("/"), "tool_name"),
        "name": F.when(n == 1, F.lit("  ")).otherwise(tool), "enabled": F.lit(True),
        "severity": F.when(n == 2, F.lit("urgent")).when(n == 3, F.lit("HIGH")).otherwise(F.lit("low")),
        "evaluation_type": F.when(n == 4, F.lit("Sometimes")).when(n == 5, F.lit("Temporal")).when(
            n == 6, F.lit("Sequence")).otherwise(F.lit("SingleEvent")),
        "condition_json": F.when(n == 7, F.lit("not json")).when(n == 8, F.lit('{"type":"exists"}')).when(
            n == 9, leaf("Regex", F.concat(F.lit("("), tool))).otherwise(leaf("Eq", tool)),
        "created_by": F.when(n != 0, F.lit("checks")),
    }
    shape = spark.createDataFrame([], RULES).schema
    return used.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


@query("rule_catalog_check", f"""{TOOL_RULES}, found AS (
 SELECT id, name, unnest([CASE WHEN n = 0 THEN 'created_by is required' END,
 CASE WHEN n = 1 THEN 'name is required' END, CASE WHEN n = 2 THEN 'severity is unknown' END,
 CASE WHEN n = 4 THEN 'evaluation_type is unknown' END, CASE WHEN n = 5 THEN 'temporal_config is required' END,
 CASE WHEN n = 6 THEN 'sequence_config is required' END, CASE WHEN n IN (7, 8) THEN 'condition' END]) AS error
 FROM rules) SELECT * FROM found WHERE error IS NOT NULL""")
def rule_catalog_check_query(spark, sf_dir):
    """Defects of the rules; what exactly is wrong with a condition is left out."""
    known = F.col("error").rlike(" is (required|unknown)$") & ~F.col("error").contains("condition")
    return rule_catalog_check(tool_rules(spark, sf_dir)).select(
        "id", "name", F.when(known, F.col("error")).otherwise(F.lit("condition")).alias("error"))


@query("rule_errors", f"{TOOL_RULES} SELECT id AS rule_id, name FROM rules WHERE n IN (7, 8, 9)")
def rule_errors_query(spark, sf_dir):
    """Rules that can't be used: broken conditions and a pattern that does not compile."""
    return load_rules(tool_rules(spark, sf_dir))[1].select("rule_id", "name")


@query("dead_letter_headers", f"""WITH {KEYED}, bad AS (SELECT *, k % 10 AS kind FROM keyed WHERE k % 10 < 3),
 headers AS (SELECT unnest([['x-original-topic', 'files'], ['x-retry-count', '0'],
 ['x-error-type', CASE kind WHEN 2 THEN 'InvalidOperationException' ELSE 'EventDeserializationException' END]]) AS h
 FROM bad) SELECT h[1] AS header, h[2] AS text, count(*) AS n FROM headers GROUP BY 1, 2""")
def dead_letter_headers_query(spark, sf_dir):
    """Headers of the dead letters, without positions, messages and the time of writing."""
    _, bad = decode_events(messages(spark, sf_dir))
    headers = dead_letters(bad).select(F.explode("headers").alias("h"))
    return headers.select(
        F.col("h.key").alias("header"), F.decode("h.value", "UTF-8").alias("text")
    ).where("header IN ('x-original-topic', 'x-retry-count', 'x-error-type')").groupBy("header", "text").agg(
        F.count(F.lit(1)).alias("n"))


TIME_SQL = """concat(regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '[.]?0+$', ''), 'Z')"""


@query("alert_messages", f"""WITH {ALERTS} SELECT alert_id, severity, {TIME_SQL.format('triggered_at')} AS live_time,
 concat('/alerts/', alert_id) AS webhook_link, concat(strftime(triggered_at, '%Y-%m-%dT%H:%M:%S.%f'), '0Z') AS pager_time,
 concat('siem-', alert_id) AS pager_key, concat('siem-agent-', agent_id) AS pager_source,
 CASE WHEN labels IS NULL THEN 'uncategorized' ELSE regexp_extract(labels, ':"(.*)"', 1) END AS pager_group,
 concat('*Severity:*', chr(10), CASE severity WHEN 'critical' THEN ':rotating_light:' WHEN 'high' THEN ':warning:'
   WHEN 'medium' THEN ':large_yellow_circle:' ELSE ':information_source:' END, ' ', severity) AS chat_severity,
 title AS chat_title, concat('https://siem.test/sessions/', session_id) AS chat_link FROM alerts""")
def alert_messages_query(spark, sf_dir):
    """Fields of the messages that each channel gets for an alert."""
    alerts = alerts_of(spark, sf_dir).withColumns({
        "labels": F.coalesce(F.from_json("labels", "map<string,string>"), F.create_map().cast("map<string,string>")),
        "recent_alert_count": F.lit(1), "session_event_count": F.lit(2),
        "recent_tools": F.array(F.lit("x")), "detail": F.coalesce("detail", F.lit("")),
    })
    base = "https://siem.test"
    sent = alerts.select("alert_id", "severity", render_live().alias("live"), render_webhook().alias("webhook"),
                         render_slack("#alerts", base).alias("chat"), render_pagerduty("key", base).alias("pager"))
    field = F.get_json_object
    return sent.select(
        "alert_id", "severity", field("live", "$.triggeredAt").alias("live_time"),
        field("webhook", "$.siem_url").alias("webhook_link"), field("pager", "$.payload.timestamp").alias("pager_time"),
        field("pager", "$.dedup_key").alias("pager_key"), field("pager", "$.payload.source").alias("pager_source"),
        field("pager", "$.payload.group").alias("pager_group"),
        field("chat", "$.blocks[1].fields[0].text").alias("chat_severity"),
        field("chat", "$.blocks[0].text.text").alias("chat_title"),
        field("chat", "$.blocks[3].elements[1].url").alias("chat_link"))


KEPT_FROM = datetime(2024, 1, 12)


@query("event_retention", f"""WITH {AE} SELECT event_id, timestamp, (SELECT count(DISTINCT date_trunc('day', timestamp))
 FROM ae WHERE timestamp >= TIMESTAMP '2024-01-12 00:00:00') AS days_left FROM ae
 WHERE timestamp >= TIMESTAMP '2024-01-12 00:00:00'""")
def event_retention_query(spark, sf_dir):
    """Stored events after the days before were dropped, and the day folders that are left."""
    folder = new_folder(spark, "events")
    write_events(events_of(spark, sf_dir), folder)
    apply_retention(spark, folder, "agent_events", KEPT_FROM + timedelta(days=90))
    days = len(table_folders(spark, folder, "events"))
    return read_events(spark, folder).select("event_id", "timestamp", F.lit(days).cast("long").alias("days_left"))


def stored(spark, sf_dir, parts: int = 2) -> str:
    """Events, their sessions and the marks of the sample alerts, committed in several batches."""
    folder = new_folder(spark, "store")
    events, alerts = events_of(spark, sf_dir), alerts_of(spark, sf_dir)
    for part in range(parts):
        batch = Batch(spark, folder, "ingest", part)
        rows = batch.write(TABLE, stored_form(events.where(f"pmod(hash(event_id), {parts}) = {part}")), DAY)
        batch.write("sessions", session_parts(rows))
        batch.write("session_marks", alerts.where(f"pmod(hash(alert_id), {parts}) = {part}").select(
            "session_id", "alert_id", "severity"))
        batch.commit()
    return folder


@query("session_timeline_stored", TIMELINE)
def session_timeline_stored_query(spark, sf_dir):
    """The timeline from the stored events; the session's days come from the session table."""
    alerts = alerts_of(spark, sf_dir)
    events = read_session_events(spark, stored(spark, sf_dir), "sess-7")
    timeline = session_timeline(events, links_of(alerts), alerts, "sess-7")
    return timeline.withColumns({
        name: F.array_join(name, ",") for name in ("alert_ids", "alert_severities")})


@query("session_marks", f"""WITH {SESSIONS} SELECT session_id, event_count, has_alerts, alert_count,
 max_severity FROM sessions""")
def session_marks_query(spark, sf_dir):
    """Sessions with the marks that alert batches wrote back."""
    return read_marked_sessions(spark, stored(spark, sf_dir)).select(
        "session_id", "event_count", "has_alerts", "alert_count", "max_severity")
