"""Streaming forms run over the events table in several micro-batches; results equal the batch forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import AE, events_of, query
from checks.conditions import SESSIONS
from checks.detection import (
    BUSY, FLOOD, LIMITS, MATCHES, PAIR, PAIR_WALK, RATE, STAGED, SUPPRESSIONS_SQL, TRIPLE,
    TRIPLE_WALK, loaded, matches_of, rules_of,
)
from checks.stores import messages
from sentryspark.functions.normalize import normalize_event_type
from sentryspark.operators.rules import MATCH_COLUMNS, eval_single
from sentryspark.plans.adapter import RAW_EVENTS_SQL
from sentryspark.session import new_folder, prepare_streaming
from sentryspark.sources.alert_store import read_alerts, read_links
from sentryspark.sources.event_store import write_event_batch
from sentryspark.sources.raw import decode_events, normalize_events
from sentryspark.sources.rollup_store import add_states, merged, read_rollup, refresh
from sentryspark.sources.session_store import read_sessions, write_session_batch
from sentryspark.sources.batches import Batch
from sentryspark.streaming.detection import (
    Folders, read_late, read_matches, start_alerts, start_detection, stream_rules, write_matches,
    write_stream,
)

# Micro-batches the events are dealt to, and rows of a table for each file of a micro-batch.
PARTS = 3
FILE_ROWS = 500_000


def sliced(spark, frame: DataFrame, name: str, order: str = "timestamp") -> DataFrame:
    """A stream over ``frame`` in ``PARTS`` micro-batches, each a range of ``order``, unsorted inside.

    Every batch is a folder written in turn, so the file source takes them in that order. All folders
    have the same number of files, which a trigger reads together.
    """
    prepare_streaming(spark)
    folder = new_folder(spark, name)
    low, high, rows = frame.agg(F.min(order), F.max(order), F.count("*")).first()
    width = (high - low) / PARTS
    files = max(1, rows // FILE_ROWS)
    for part in range(PARTS):
        rows = frame.where(F.col(order) >= F.lit(low + part * width))
        if part < PARTS - 1:
            rows = rows.where(F.col(order) < F.lit(low + (part + 1) * width))
        dealt = rows.withColumn("dealt", F.rand(7)).repartitionByRange(files, "dealt")
        target = f"{folder}/part={part}"
        dealt.sortWithinPartitions("dealt").drop("dealt").write.parquet(target)
        # A range without a row has no file.
        for _ in range(files - len(spark.read.schema(frame.schema).parquet(target).inputFiles())):
            frame.limit(0).write.mode("append").parquet(target)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files)
    return source.parquet(f"{folder}/*")


def event_stream(spark, sf_dir) -> DataFrame:
    """Canonical events as a stream of several micro-batches, out of order within each."""
    return sliced(spark, events_of(spark, sf_dir), "event-stream")


def drained(spark, stream: DataFrame, name: str, each_batch) -> Folders:
    """Run a stream to the end of its source, batches going to ``each_batch``."""
    folders = Folders(new_folder(spark, name))
    query = write_stream(
        stream, name, folders, lambda frame, batch_id: each_batch(frame, batch_id, folders), True)
    query.awaitTermination()
    return folders


@query("stream_stateful_rules", f"""WITH RECURSIVE {AE}, {PAIR_WALK}, {TRIPLE_WALK} {BUSY}
 UNION ALL {RATE} UNION ALL {FLOOD} UNION ALL {PAIR} UNION ALL {TRIPLE}""")
def stream_stateful_rules_query(spark, sf_dir):
    def each_batch(frame, batch_id, folders):
        write_matches(frame.where("NOT late"), "stateful", batch_id, folders.root)

    rules = [rule for rule in loaded(spark) if rule.kind != "SingleEvent"]
    folders = drained(spark, stream_rules(event_stream(spark, sf_dir), rules), "stateful", each_batch)
    return read_matches(spark, folders.root).select(*MATCH_COLUMNS)


@query("stream_single_rules", f"WITH {MATCHES} SELECT * FROM matches WHERE rule_id IN ('slow', 'claude', 'shell')")
def stream_single_rules_query(spark, sf_dir):
    def each_batch(frame, batch_id, folders):
        write_matches(eval_single(frame, loaded(spark)), "single", batch_id, folders.root)

    folders = drained(spark, event_stream(spark, sf_dir), "single", each_batch)
    return read_matches(spark, folders.root).select(*MATCH_COLUMNS)


@query("stream_alerts", f"WITH {STAGED} SELECT rule_id, event_id FROM staged WHERE stage = 'created'")
def stream_alerts_query(spark, sf_dir):
    folders = Folders(new_folder(spark, "alerting"))
    matches = sliced(spark, matches_of(spark, sf_dir).select(*MATCH_COLUMNS), "match-stream")
    started = start_alerts(
        matches, lambda: events_of(spark, sf_dir), lambda: rules_of(spark),
        lambda: spark.sql(SUPPRESSIONS_SQL), folders, LIMITS, available_now=True)
    started.awaitTermination()
    return read_alerts(spark, folders.root).join(read_links(spark, folders.root), "alert_id").select(
        "rule_id", "event_id")


@query("stream_flow", f"WITH {STAGED} SELECT rule_id, event_id FROM staged WHERE stage = 'created'")
def stream_flow_query(spark, sf_dir):
    """Events to alerts for all rule kinds in one query; suppressions and enrichment included."""
    folders = Folders(new_folder(spark, "flow"))
    start_detection(
        event_stream(spark, sf_dir), lambda: events_of(spark, sf_dir), lambda: rules_of(spark),
        lambda: spark.sql(SUPPRESSIONS_SQL), folders, limits=LIMITS, available_now=True,
    ).awaitTermination()
    return read_alerts(spark, folders.root).join(read_links(spark, folders.root), "alert_id").select(
        "rule_id", "event_id")


@query("stream_sessions", f"WITH {SESSIONS} SELECT * FROM plain")
def stream_sessions_query(spark, sf_dir):
    def each_batch(frame, batch_id, folders):
        write_session_batch(frame, batch_id, folders.root)

    folders = drained(spark, event_stream(spark, sf_dir), "sessions", each_batch)
    return read_sessions(spark, folders.root)


@query("stream_rollup_daily", f"""WITH {AE} SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP)
 AS bucket, agent_id, count(*) AS event_count, count(DISTINCT session_id) AS unique_sessions,
 max(timestamp) AS last_seen FROM ae GROUP BY 1, 2""")
def stream_rollup_daily_query(spark, sf_dir):
    folders = drained(spark, event_stream(spark, sf_dir), "rollup", state_batch)
    return merged(spark, folders.root, "agent_activity_daily").select(
        "bucket", "agent_id", "event_count", "unique_sessions", "last_seen")


def state_batch(frame, batch_id, folders):
    batch = Batch(frame.sparkSession, folders.root, "states", batch_id)
    add_states(batch, frame)
    batch.commit()


HOURLY_SQL = f"""WITH {AE} SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS bucket, agent_id,
 event_type, count(*) AS event_count, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
 round(avg(latency_ms), 6) AS avg_latency_ms, max(latency_ms) AS max_latency_ms,
 round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms, count(DISTINCT session_id) AS unique_sessions,
 count(DISTINCT tool_name) AS unique_tools_used FROM ae {{where}} GROUP BY 1, 2, 3"""
HOURLY_COLUMNS = ["bucket", "agent_id", "event_type", "event_count", "total_input_tokens",
                  "max_latency_ms", "unique_sessions", "unique_tools_used"]


def hourly_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*HOURLY_COLUMNS, *[
        F.round(name, 6).alias(name) for name in ("avg_latency_ms", "p95_latency_ms")])


@query("stream_rollup_hourly", HOURLY_SQL.format(where=""))
def stream_rollup_hourly_query(spark, sf_dir):
    """Hourly activity, percentile included, from the states of several batches."""
    folders = drained(spark, event_stream(spark, sf_dir), "rollup", state_batch)
    return hourly_rows(merged(spark, folders.root, "agent_activity_hourly"))


REFRESHED = [datetime(2024, 1, 10, 9, 4), datetime(2024, 1, 10, 9, 7), datetime(2024, 1, 10, 11, 30)]


@query("rollup_refresh_window", HOURLY_SQL.format(
    where="WHERE timestamp >= TIMESTAMP '2024-01-10 07:00:00' AND timestamp < TIMESTAMP '2024-01-10 11:00:00'"))
def rollup_refresh_window_query(spark, sf_dir):
    """Buckets of three refreshes of the hourly roll-up, each over its own window: 07-08, 07-09, 09-11."""
    folders = drained(spark, event_stream(spark, sf_dir), "rollup", state_batch)
    for as_of in REFRESHED:
        refresh(spark, folders.root, "agent_activity_hourly", as_of)
    return hourly_rows(read_rollup(spark, folders.root, "agent_activity_hourly"))


@query("stream_replay", f"WITH {MATCHES} SELECT rule_id, event_id FROM matches WHERE rule_id = 'shell'")
def stream_replay_query(spark, sf_dir):
    """Every batch is written twice, first with the rows of three rules, then of one: one is left."""
    def each_batch(frame, batch_id, folders):
        write_matches(eval_single(frame, loaded(spark)), "single", batch_id, folders.root)
        write_matches(eval_single(frame, loaded(spark, "shell")), "single", batch_id, folders.root)

    folders = drained(spark, event_stream(spark, sf_dir), "replay", each_batch)
    return read_matches(spark, folders.root).select("rule_id", "event_id")


@query("stream_late_rows", f"""WITH {MATCHES} SELECT rule_id, event_id FROM matches
 WHERE rule_id IN ('slow', 'claude', 'shell') AND timestamp < TIMESTAMP '2024-01-15 00:00:00'
 AND timestamp >= TIMESTAMP '2024-01-10 00:00:00'""")
def stream_late_rows_query(spark, sf_dir):
    """Hits of five days that arrive after later ones: kept aside, not evaluated."""
    from datetime import timedelta

    from sentryspark.streaming.detection import Lateness

    cut, early = datetime(2024, 1, 15), datetime(2024, 1, 10)
    events = events_of(spark, sf_dir).where(F.col("timestamp") >= F.lit(early))
    prepare_streaming(spark)
    folder = new_folder(spark, "late-stream")
    for part, rows in enumerate([events.where(F.col("timestamp") >= F.lit(cut)),
                                 events.where(F.col("timestamp") < F.lit(cut))]):
        rows.coalesce(1).write.parquet(f"{folder}/part={part}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    folders = Folders(new_folder(spark, "late"))
    start_detection(
        stream, lambda: events, lambda: rules_of(spark, "slow", "claude", "shell"),
        lambda: spark.sql(SUPPRESSIONS_SQL), folders, available_now=True,
        lateness=Lateness(timedelta(minutes=10), timedelta(days=60)),
    ).awaitTermination()
    return read_late(spark, folders.root).select("rule_id", "event_id")
