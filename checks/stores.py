"""Messages made from the events table, and the event store written and read back."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import AE, AS_OF, events_of, query
from checks.conditions import END, KEYED, RANGE, START
from sentryspark.plans.adapter import raw_events
from sentryspark.session import new_folder
from sentryspark.sources.event_store import compact_events, read_events, write_events
from sentryspark.sources.raw import decode_events, normalize_events, records_from_text


COMPACTED = datetime(2024, 1, 18, 23, 59, 59, 999999)


def messages(spark, sf_dir) -> DataFrame:
    """Events as topic records; three in ten are broken in different ways."""
    kind = F.regexp_extract("properties", "([0-9]+)", 1).cast("int") % 10
    message = F.to_json(F.struct(
        F.col("trace_id").alias("TraceId"), F.col("agent_id").alias("agentid"),
        F.col("session_id").alias("sessionId"), F.col("raw_event_type").alias("eventType"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("input_tokens").alias("inputTokens"), F.col("latency_ms").alias("latencyMs"),
        F.from_json("properties", "k INT").alias("extra"), F.lit(1).alias("unknownField"),
    ))
    line = (
        F.when(kind == 0, F.lit("not json")).when(kind == 1, F.lit('{"inputTokens":"12"}'))
        .when(kind == 2, F.lit("null")).otherwise(message)
    )
    return records_from_text(raw_events(spark, sf_dir).select(line.alias("value")))


@query("decode_events", f"""WITH {KEYED} SELECT trace_id, agent_id, 'unknown' AS agent_name,
 session_id, event_type, timestamp, input_tokens, latency_ms, tool_name,
 concat('{{"k":', k, '}}') AS properties FROM (SELECT * REPLACE (NULL AS tool_name) FROM keyed)
 WHERE k % 10 > 2""")
def decode_events_query(spark, sf_dir):
    kept, _ = decode_events(messages(spark, sf_dir))
    return normalize_events(kept).select(
        "trace_id", "agent_id", "agent_name", "session_id", "event_type", "timestamp",
        "input_tokens", "latency_ms", "tool_name", "properties")


@query("dead_letters", f"""WITH {KEYED} SELECT CASE k % 10 WHEN 2 THEN 'InvalidOperationException'
 ELSE 'EventDeserializationException' END AS error_type, CASE k % 10 WHEN 0 THEN 'not json'
 WHEN 1 THEN '{{"inputTokens":"12"}}' ELSE 'null' END AS value, count(*) AS n FROM keyed
 WHERE k % 10 < 3 GROUP BY 1, 2""")
def dead_letters_query(spark, sf_dir):
    _, bad = decode_events(messages(spark, sf_dir))
    text = F.col("value").cast("string").alias("value")
    return bad.groupBy("error_type", text).agg(F.count(F.lit(1)).alias("n"))


@query("event_store", f"""WITH {AE} SELECT event_id, timestamp, event_type, input_tokens, properties
 FROM ae WHERE {RANGE}""")
def event_store_query(spark, sf_dir):
    folder = new_folder(spark, "events")
    write_events(events_of(spark, sf_dir), folder)
    return read_events(spark, folder, START, END).select(
        "event_id", "timestamp", "event_type", "input_tokens", "properties")


@query("compacted_events", f"""WITH {AE} SELECT event_id, agent_id, event_type, timestamp FROM ae
 WHERE timestamp < TIMESTAMP '2024-01-19 00:00:00'""")
def compacted_events_query(spark, sf_dir):
    """Old days of two appends after two compactions, read through the layout."""
    folder = new_folder(spark, "events")
    events = events_of(spark, sf_dir)
    write_events(events.where("hash(event_id) % 2 = 0"), folder)
    compact_events(spark, folder, AS_OF - timedelta(days=5))
    write_events(events.where("hash(event_id) % 2 <> 0"), folder)
    compact_events(spark, folder, AS_OF - timedelta(days=5))
    return read_events(spark, folder, end=COMPACTED).select(
        "event_id", "agent_id", "event_type", "timestamp")
