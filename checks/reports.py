"""Roll-ups, dashboards, risk, anomalies, timelines and load checks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from checks.common import (
    AE, ALERTS, AS_OF, HOURLY, TOOLS, alerts_of, events_of, links_of, query,
)
from sentryspark.functions.fields import time_bucket
from sentryspark.operators.rollups import (
    agent_activity_daily, agent_activity_hourly, tool_usage_hourly,
)
from sentryspark.operators.sessions import session_timeline
from sentryspark.plans.anomaly import tool_anomalies
from sentryspark.plans.dashboard import (
    alert_distribution, alert_severity_totals, event_volume, headline_metrics, tool_share,
    tool_usage, top_agents,
)
from sentryspark.plans.quality import (
    event_type_mix, ingest_audit, latency_stats, throughput_windows, window_rates,
)
from sentryspark.plans.risk import agent_risk_summary, top_breakdown
from sentryspark.sources.event_store import RETENTION_DAYS, kept_rows

MONTH = 720


def hourly_of(spark, sf_dir):
    return agent_activity_hourly(events_of(spark, sf_dir))


def tools_of(spark, sf_dir):
    return tool_usage_hourly(events_of(spark, sf_dir))


query("agent_activity_hourly", f"""WITH {HOURLY} SELECT * REPLACE (
 round(avg_latency_ms, 6) AS avg_latency_ms, round(p95_latency_ms, 6) AS p95_latency_ms)
 FROM hourly""")(hourly_of)
query("tool_usage_hourly", f"""WITH {TOOLS} SELECT * REPLACE (
 round(avg_latency_ms, 6) AS avg_latency_ms) FROM tool_hourly""")(tools_of)


@query("agent_activity_daily", f"""WITH {AE} SELECT
 CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS bucket, agent_id, agent_name,
 count(*) AS event_count, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
 count(DISTINCT session_id) AS unique_sessions, count(DISTINCT event_type) AS event_type_variety,
 min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ae GROUP BY 1, 2, 3""")
def agent_activity_daily_query(spark, sf_dir):
    return agent_activity_daily(events_of(spark, sf_dir))


SINCE_MONTH = "bucket >= TIMESTAMP '2024-01-01 00:00:00'"
SINCE_DAY = "bucket >= TIMESTAMP '2024-01-30 00:00:00'"

TOP_AGENTS = """SELECT agent_id, agent_name, CAST(sum(event_count) AS BIGINT) AS total_events,
 CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS total_tokens,
 max(coalesce(max_latency_ms, 0.0)) AS max_latency_ms FROM hourly WHERE {since}
 GROUP BY 1, 2 ORDER BY total_events DESC, agent_id LIMIT {limit}"""


@query("top_agents", f"WITH {HOURLY} {TOP_AGENTS.format(since=SINCE_DAY, limit=20)}")
def top_agents_query(spark, sf_dir):
    return top_agents(hourly_of(spark, sf_dir), AS_OF)


@query("top_agents_month", f"WITH {HOURLY} {TOP_AGENTS.format(since=SINCE_MONTH, limit=5)}")
def top_agents_month_query(spark, sf_dir):
    return top_agents(hourly_of(spark, sf_dir), AS_OF, MONTH, 5)


VOLUME = f"""{HOURLY}, volume AS (SELECT bucket, CAST(sum(event_count) AS BIGINT) AS event_count,
 CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS total_tokens FROM hourly
 WHERE {SINCE_MONTH} GROUP BY 1)"""


@query("event_volume", f"WITH {VOLUME} SELECT * FROM volume ORDER BY bucket")
def event_volume_query(spark, sf_dir):
    return event_volume(hourly_of(spark, sf_dir), AS_OF, MONTH)


DISTRIBUTION = """distribution AS (SELECT severity, status, count(*) AS alert_count FROM alerts
 WHERE triggered_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2)"""


@query("alert_distribution", f"WITH {ALERTS}, {DISTRIBUTION} SELECT * FROM distribution")
def alert_distribution_query(spark, sf_dir):
    return alert_distribution(alerts_of(spark, sf_dir), AS_OF, MONTH)


@query("alert_severity_totals", f"""WITH {ALERTS}, {DISTRIBUTION},
 known AS (SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity)
 SELECT severity, CAST(coalesce(sum(alert_count), 0) AS BIGINT) AS alert_count
 FROM known LEFT JOIN distribution USING (severity) GROUP BY 1
 UNION ALL SELECT 'total', CAST(sum(alert_count) AS BIGINT) FROM distribution""")
def alert_severity_totals_query(spark, sf_dir):
    return alert_severity_totals(alert_distribution(alerts_of(spark, sf_dir), AS_OF, MONTH))


@query("headline_metrics", f"""WITH {VOLUME}, alerts_base AS (SELECT 1),
 alerts AS ({ALERTS.split(', alerts AS (', 1)[1]}, {DISTRIBUTION},
 minutes AS (SELECT *, floor(total_tokens / 60 + 0.5) AS tokens FROM volume),
 latest AS (SELECT arg_max(event_count, bucket) AS e, arg_max(tokens, bucket) AS t,
  avg(event_count) AS me, avg(tokens) AS mt, count(*) AS n FROM minutes)
 SELECT e AS events_last_hour, CAST(t AS BIGINT) AS tokens_per_minute,
 (SELECT CAST(sum(alert_count) AS BIGINT) FROM distribution WHERE status = 'open') AS open_alerts,
 n >= 2 AND e > 1.5 * me AS events_spike, n >= 2 AND t > 1.5 * mt AS tokens_spike FROM latest""")
def headline_metrics_query(spark, sf_dir):
    volume = event_volume(hourly_of(spark, sf_dir), AS_OF, MONTH)
    return headline_metrics(volume, alert_distribution(alerts_of(spark, sf_dir), AS_OF, MONTH))


USAGE = f"""{TOOLS}, usage AS (SELECT tool_name,
 CAST(sum(invocation_count) AS BIGINT) AS invocation_count,
 round(coalesce(avg(avg_latency_ms), 0), 6) AS avg_latency_ms,
 CAST(sum(unique_sessions) AS BIGINT) AS unique_sessions FROM tool_hourly WHERE {SINCE_MONTH}
 GROUP BY 1 ORDER BY invocation_count DESC, tool_name LIMIT 20)"""


@query("tool_usage", f"WITH {USAGE} SELECT * FROM usage")
def tool_usage_query(spark, sf_dir):
    return tool_usage(tools_of(spark, sf_dir), AS_OF, MONTH)


@query("tool_share", f"""WITH {USAGE} SELECT tool_name, invocation_count,
 round(invocation_count * 100.0 / (SELECT max(invocation_count) FROM usage), 6) AS share_percent
 FROM usage""")
def tool_share_query(spark, sf_dir):
    return tool_share(tool_usage(tools_of(spark, sf_dir), AS_OF, MONTH))


def breakdown_sql(value: str, since: str) -> str:
    return f"""SELECT agent_id, concat('{{', string_agg(concat('"', v, '":', n), ',' ORDER BY v), '}}')
 AS breakdown FROM (SELECT agent_id, {value} AS v, count(*) AS n, row_number() OVER (
 PARTITION BY agent_id ORDER BY count(*) DESC, {value}) AS rn FROM ae
 WHERE {value} IS NOT NULL AND {since} GROUP BY 1, 2) WHERE rn <= 10 GROUP BY 1"""


RECENT = "timestamp >= TIMESTAMP '2024-01-24 00:00:00'"
RISK = f"""{ALERTS}, stats AS (SELECT agent_id, max(agent_name) AS agent_name,
 count(*) AS total_events, count(DISTINCT session_id) AS total_sessions,
 count(DISTINCT tool_name) AS unique_tools,
 CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS total_tokens,
 avg(latency_ms) AS avg_latency_ms, count(*) / greatest(
  (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(min(timestamp))) / 6e7, 1.0)
  AS events_per_minute FROM ae WHERE {RECENT} GROUP BY 1),
 alarm AS (SELECT agent_id, count(*) AS open_alerts,
  count(*) FILTER (WHERE severity = 'critical') AS critical_alerts FROM alerts
  WHERE status = 'open' AND triggered_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1),
 types AS ({breakdown_sql('event_type', RECENT)}), tools AS ({breakdown_sql('tool_name', RECENT)}),
 risk AS (SELECT agent_id, agent_name, total_events, total_sessions,
 coalesce(open_alerts, 0) AS open_alerts, coalesce(critical_alerts, 0) AS critical_alerts,
 unique_tools, total_tokens, round(avg_latency_ms, 6) AS avg_latency_ms,
 round(events_per_minute, 6) AS events_per_minute,
 coalesce(types.breakdown, '{{}}') AS top_event_types, coalesce(tools.breakdown, '{{}}') AS top_tools
 FROM stats LEFT JOIN alarm USING (agent_id) LEFT JOIN types USING (agent_id)
 LEFT JOIN tools USING (agent_id))"""
WEEK = timedelta(days=7)


@query("agent_risk_summary", f"WITH {RISK} SELECT * FROM risk")
def agent_risk_summary_query(spark, sf_dir):
    return agent_risk_summary(
        events_of(spark, sf_dir), alerts_of(spark, sf_dir), AS_OF, lookback=WEEK)


@query("agent_risk_one", f"WITH {RISK} SELECT * FROM risk WHERE agent_id = 'agent-5'")
def agent_risk_one_query(spark, sf_dir):
    return agent_risk_summary(
        events_of(spark, sf_dir), alerts_of(spark, sf_dir), AS_OF, "agent-5", WEEK)


@query("agent_risk_unknown", """SELECT 'agent-x' AS agent_id, CAST(NULL AS VARCHAR) AS agent_name,
 CAST(0 AS BIGINT) AS total_events, CAST(0 AS BIGINT) AS total_sessions,
 CAST(0 AS BIGINT) AS open_alerts, CAST(0 AS BIGINT) AS critical_alerts,
 CAST(0 AS BIGINT) AS unique_tools, CAST(0 AS BIGINT) AS total_tokens,
 CAST(0 AS DOUBLE) AS avg_latency_ms, CAST(0 AS DOUBLE) AS events_per_minute,
 '{}' AS top_event_types, '{}' AS top_tools""")
def agent_risk_unknown_query(spark, sf_dir):
    return agent_risk_summary(
        events_of(spark, sf_dir), alerts_of(spark, sf_dir), AS_OF, "agent-x", WEEK)


@query("top_breakdown", f"WITH {AE} {breakdown_sql('tool_name', 'TRUE')}")
def top_breakdown_query(spark, sf_dir):
    return top_breakdown(events_of(spark, sf_dir), "agent_id", "tool_name")


@query("tool_anomalies", f"""WITH {TOOLS}, today AS (SELECT tool_name,
 CAST(sum(invocation_count) AS BIGINT) AS today_count FROM tool_hourly WHERE {SINCE_DAY}
 GROUP BY 1), daily AS (SELECT tool_name, date_trunc('day', bucket) AS day,
 sum(invocation_count) AS n FROM tool_hourly WHERE bucket >= TIMESTAMP '2024-01-24 00:00:00'
 AND bucket < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2),
 baseline AS (SELECT tool_name, avg(n) AS m, stddev_samp(n) AS d FROM daily GROUP BY 1)
 SELECT tool_name, today_count, round(m, 6) AS avg_daily_count,
 round((today_count - m) / nullif(d, 0), 6) AS z_score
 FROM today JOIN baseline USING (tool_name) WHERE (today_count - m) / nullif(d, 0) > 0.25""")
def tool_anomalies_query(spark, sf_dir):
    return tool_anomalies(tools_of(spark, sf_dir), AS_OF, threshold=0.25)


TIMELINE = f"""WITH {ALERTS} SELECT e.event_id, e.timestamp, e.event_type,
 e.agent_id, tool_name, model_id, input_tokens, output_tokens, latency_ms, properties,
 coalesce(a.alert_id, '') AS alert_ids, coalesce(a.severity, '') AS alert_severities
 FROM ae e LEFT JOIN alerts a USING (event_id) WHERE e.session_id = 'sess-7'
 ORDER BY e.timestamp, e.event_id LIMIT 1000"""


@query("session_timeline", TIMELINE)
def session_timeline_query(spark, sf_dir):
    alerts = alerts_of(spark, sf_dir)
    timeline = session_timeline(events_of(spark, sf_dir), links_of(alerts), alerts, "sess-7")
    return timeline.withColumns({
        name: F.array_join(name, ",") for name in ("alert_ids", "alert_severities")})


@query("ingest_audit", f"""WITH {AE} SELECT session_id, count(*) AS total_rows,
 count(DISTINCT trace_id) AS unique_traces, count(*) - count(DISTINCT trace_id) AS duplicates
 FROM ae GROUP BY 1""")
def ingest_audit_query(spark, sf_dir):
    return ingest_audit(events_of(spark, sf_dir))


STATS = """count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean, max(latency_ms) AS maximum,
 round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
 round(quantile_cont(latency_ms, 0.99), 6) AS p99"""


@query("latency_stats", f"WITH {AE} SELECT event_type, {STATS} FROM ae GROUP BY 1")
def latency_stats_query(spark, sf_dir):
    return latency_stats(events_of(spark, sf_dir), ["event_type"])


@query("latency_stats_all", f"WITH {AE} SELECT {STATS} FROM ae")
def latency_stats_all_query(spark, sf_dir):
    return latency_stats(events_of(spark, sf_dir), [])


RATES = f"""{AE}, rates AS (SELECT CAST(floor(ms / 600000) AS BIGINT) AS start, count(*) AS events,
 count(*) / 600.0 AS rate FROM ae GROUP BY 1)"""


@query("window_rates", f"WITH {RATES} SELECT start, events, round(rate, 6) AS rate FROM rates")
def window_rates_query(spark, sf_dir):
    return window_rates(events_of(spark, sf_dir), 600)


@query("throughput_windows", f"""WITH {RATES}, rolling AS (SELECT sum(events) OVER (ORDER BY start
 RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n FROM rates)
 SELECT round(sum(events) / ((max(start) - min(start) + 1) * 600.0), 6) AS average_rate,
 round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate, count(*) AS window_count,
 round(quantile_cont(rate, 0.5), 6) AS p50_rate, round(quantile_cont(rate, 0.95), 6) AS p95_rate,
 round((SELECT min(n) FROM rolling) / 3600.0, 6) AS min_rolling_rate FROM rates""")
def throughput_windows_query(spark, sf_dir):
    return throughput_windows(events_of(spark, sf_dir), 600, 6)


@query("event_type_mix", f"""WITH {AE}, c AS (SELECT event_type, count(*) AS n FROM ae GROUP BY 1)
 SELECT event_type, n, round(n / (SELECT sum(n) FROM c), 6) AS share,
 CASE event_type WHEN 'llm_call' THEN 0.25 WHEN 'tool_invocation' THEN 0.35 ELSE 0.0 END
   AS expected_share,
 round(n / (SELECT sum(n) FROM c) - CASE event_type WHEN 'llm_call' THEN 0.25
   WHEN 'tool_invocation' THEN 0.35 ELSE 0.0 END, 6) AS deviation FROM c""")
def event_type_mix_query(spark, sf_dir):
    return event_type_mix(events_of(spark, sf_dir), {"llm_call": 0.25, "tool_invocation": 0.35})


@query("retention", f"""WITH {HOURLY} SELECT bucket, agent_id, event_type, event_count FROM hourly
 WHERE bucket >= TIMESTAMP '2024-01-11 00:00:00'""")
def retention_query(spark, sf_dir):
    hourly = hourly_of(spark, sf_dir)
    as_of = AS_OF - timedelta(days=20) + timedelta(days=RETENTION_DAYS["agent_activity_hourly"])
    return kept_rows(hourly, "bucket", "agent_activity_hourly", as_of).select(
        "bucket", "agent_id", "event_type", "event_count")


@query("daily_from_hours", f"""WITH {HOURLY} SELECT CAST(date_trunc('day', bucket) AS TIMESTAMP) AS day,
 agent_id, CAST(sum(event_count) AS BIGINT) AS event_count FROM hourly GROUP BY 1, 2""")
def daily_from_hours_query(spark, sf_dir):
    return hourly_of(spark, sf_dir).groupBy(time_bucket("day", "bucket").alias("day"), "agent_id").agg(
        F.sum("event_count").alias("event_count"))
