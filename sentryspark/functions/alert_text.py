"""Alert titles, details, identity and the messages sent to each channel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fallback texts and message formats that receivers rely on.
SINGLE_DETAIL = "Event matched rule conditions"
FALLBACK_DETAIL = "Rule conditions matched"
FALLBACK_TITLE = "Rule triggered"
FALLBACK_RULE_NAME = "Unknown rule"
FALLBACK_GROUP = "uncategorized"
SEVERITY_MARKS = {
    "critical": ":rotating_light:",
    "high": ":warning:",
    "medium": ":large_yellow_circle:",
}
DEFAULT_MARK = ":information_source:"
DEDUP_KEY_PREFIX = "siem-"
SOURCE_PREFIX = "siem-agent-"
LINK_FIELD = "siem_url"
LINK_LABEL = "View in SIEM"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def span_text(millis: int) -> str:
    """A duration as ``hh:mm:ss``, with ``d.`` in front from one day and a 7-digit fraction."""
    seconds, rest = divmod(millis, 1000)
    days, seconds = divmod(seconds, 86_400)
    hours, seconds = divmod(seconds, 3_600)
    minutes, seconds = divmod(seconds, 60)
    text = f"{hours:02d}:{minutes:02d}:{seconds:02d}"
    text = f"{days}.{text}" if days else text
    return f"{text}.{rest:03d}0000" if rest else text


def sequence_detail(labels: list[str]) -> str:
    return f"Sequence complete ({len(labels)} steps, final: {labels[-1]})"


def alert_title(severity: Column, rule_name: Column, agent_name: Column) -> Column:
    return F.concat(
        F.lit("["), F.upper(severity), F.lit("] "),
        F.coalesce(rule_name, F.lit(FALLBACK_TITLE)), F.lit(": "), agent_name,
    )


def alert_detail(detail: Column) -> Column:
    return F.coalesce(detail, F.lit(FALLBACK_DETAIL))


def alert_fingerprint(rule_id: Column, agent_id: Column, severity: Column) -> Column:
    """First 16 hex digits, upper case, of the SHA-256 of ``rule:agent:Severity``."""
    identity = F.concat_ws(":", rule_id, agent_id, F.initcap(severity))
    return F.upper(F.substring(F.sha2(identity, 256), 1, 16))


def alert_identity(rule_id: Column, event_id: Column) -> Column:
    """Stable alert id in UUID shape, so that a replay writes the same row again."""
    digest = F.sha2(F.concat_ws(":", rule_id, event_id), 256)
    starts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in starts])


def rule_labels(actions_json: Column) -> Column:
    """Labels of the first ``create_alert`` action; empty when absent or malformed."""
    actions = F.from_json(actions_json, "array<struct<type:string,labels:map<string,string>>>")
    creating = F.filter(actions, lambda action: action["type"] == "create_alert")
    labels = F.when(F.size(creating) > 0, F.element_at(creating, 1)["labels"])
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(
        F.transform_values(labels, lambda _, text: F.coalesce(text, F.lit(""))), empty
    )


def json_text(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def timestamp_text(column: Column) -> Column:
    """UTC time with as many fraction digits as it needs, none for a whole second."""
    return F.concat(F.regexp_replace(F.date_format(column, TIMESTAMP_FORMAT), "[.]?0+$", ""), F.lit("Z"))


def full_timestamp_text(column: Column) -> Column:
    """UTC time with seven fraction digits."""
    return F.concat(F.date_format(column, TIMESTAMP_FORMAT), F.lit("0Z"))


def renamed(pairs: dict[str, Column | str]) -> list[Column]:
    """Columns renamed for a message: message field -> column or column name."""
    return [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in pairs.items()]


def render_live() -> Column:
    """Message pushed to connected viewers."""
    return json_text(*renamed({
        "alertId": "alert_id", "ruleId": "rule_id", "ruleName": "rule_name",
        "severity": "severity", "title": "title", "agentId": "agent_id",
        "agentName": "agent_name", "sessionId": "session_id",
        "triggeredAt": timestamp_text(F.col("triggered_at")),
        "recentAlertCount": "recent_alert_count", "labels": "labels",
    }))


def render_webhook() -> Column:
    """Message posted to generic endpoints. ``context`` is embedded as an object."""
    return json_text(*renamed({
        "alert_id": "alert_id", "rule_id": "rule_id", "rule_name": "rule_name",
        "severity": "severity", "title": "title", "detail": "detail",
        "agent_id": "agent_id", "agent_name": "agent_name", "session_id": "session_id",
        "triggered_at": timestamp_text(F.col("triggered_at")),
        "context": F.try_parse_json("context"), "labels": "labels",
        LINK_FIELD: F.concat(F.lit("/alerts/"), F.col("alert_id")),
    }))


def markdown(label: str, text: Column) -> Column:
    body = F.concat(F.lit(f"*{label}:*\n"), text)
    return F.struct(F.lit("mrkdwn").alias("type"), body.alias("text"))


def button(label: str, url: Column) -> Column:
    text = F.struct(F.lit("plain_text").alias("type"), F.lit(label).alias("text"))
    return F.struct(F.lit("button").alias("type"), text.alias("text"), url.alias("url"))


def link(base: str, path: str, key: str) -> Column:
    return F.concat(F.lit(f"{base}/{path}/"), F.col(key))


def render_slack(channel: str, base_url: str) -> Column:
    """Chat message of four blocks: header, facts, detail, buttons."""
    mark = F.lit(DEFAULT_MARK)
    for name, text in SEVERITY_MARKS.items():
        mark = F.when(F.col("severity") == name, F.lit(text)).otherwise(mark)
    tools = F.when(
        F.size("recent_tools") > 0, F.array_join(F.slice("recent_tools", 1, 5), ", ")
    ).otherwise(F.lit("none"))
    facts = F.array(
        markdown("Severity", F.concat_ws(" ", mark, F.col("severity"))),
        markdown("Agent", F.col("agent_name")),
        markdown("Session events", F.col("session_event_count").cast("string")),
        markdown("Recent alerts (24h)", F.col("recent_alert_count").cast("string")),
        markdown("Tools used", tools),
        markdown("Rule", F.col("rule_name")),
    )
    header = json_text(
        F.lit("header").alias("type"),
        F.struct(F.lit("plain_text").alias("type"), F.col("title").alias("text")).alias("text"),
    )
    section = json_text(F.lit("section").alias("type"), facts.alias("fields"))
    quote = F.struct(
        F.lit("mrkdwn").alias("type"), F.concat(F.lit(">"), F.col("detail")).alias("text")
    )
    detail = json_text(F.lit("section").alias("type"), quote.alias("text"))
    actions = json_text(F.lit("actions").alias("type"), F.array(
        button("View alert", link(base_url, "alerts", "alert_id")),
        button("View session", link(base_url, "sessions", "session_id")),
    ).alias("elements"))
    blocks = F.concat(F.lit("["), F.concat_ws(",", header, section, detail, actions), F.lit("]"))
    return json_text(F.lit(channel).alias("channel"), F.parse_json(blocks).alias("blocks"))


def render_pagerduty(routing_key: str, base_url: str) -> Column:
    """Incident message; repeated sends of one alert share a dedup key."""
    alert_url = link(base_url, "alerts", "alert_id")
    details = F.struct(*renamed({
        "rule_id": "rule_id", "agent_id": "agent_id", "session_id": "session_id",
        "session_event_count": "session_event_count",
        "recent_alert_count": "recent_alert_count", "recent_tools": "recent_tools",
        "detail": "detail", LINK_FIELD: alert_url,
    }))
    payload = F.struct(*renamed({
        "summary": "title",
        "source": F.concat(F.lit(SOURCE_PREFIX), F.col("agent_id")),
        "severity": F.lit("critical"),
        "timestamp": full_timestamp_text(F.col("triggered_at")),
        "component": "agent_name",
        "group": F.coalesce(F.col("labels")["category"], F.lit(FALLBACK_GROUP)),
        "class": "rule_name",
        "custom_details": details,
    }))
    session_url = link(base_url, "sessions", "session_id")
    links = F.array(
        F.struct(alert_url.alias("href"), F.lit(LINK_LABEL).alias("text")),
        F.struct(session_url.alias("href"), F.lit("Session timeline").alias("text")),
    )
    return json_text(*renamed({
        "routing_key": F.lit(routing_key), "event_action": F.lit("trigger"),
        "dedup_key": F.concat(F.lit(DEDUP_KEY_PREFIX), F.col("alert_id")),
        "payload": payload, "links": links,
    }))
