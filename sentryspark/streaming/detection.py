"""Streaming detection: one flow from topic records to alerts for all rule kinds.

Two queries read the topic. The ingest query decodes and stores: events, dead letters, sessions and
roll-up states. The detection query finds the hits of all rules in one projection, runs them through
keyed state (rules, dedup, throttle) and turns what is left into alerts. Each micro-batch of either
commits all its tables at once (``sources.batches``), so a replayed batch replaces what it wrote,
also where it has fewer rows than before.

The detection query's plan holds the rules. ``keep_running`` restarts it when the rule table has changed;
state is keyed by rule id and stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sentryspark.functions.alert_text import alert_fingerprint, span_text
from sentryspark.operators.alerting import NoiseLimits, enrich, suppress
from sentryspark.operators.rules import (
    KINDS, MATCH_COLUMNS, hit_facts, of_kind, sequence_context, tagged_hits,
)
from sentryspark.operators.sliding import HOUR_MS
from sentryspark.session import scratch, written
from sentryspark.sources.alert_store import add_alerts, read_alerts
from sentryspark.sources.batches import Batch, exists, read_table
from sentryspark.sources.catalog import Rule, load_rules
from sentryspark.sources.event_store import DAY, TABLE, read_events, stored_form
from sentryspark.sources.raw import dead_letters, decode_events, normalize_events
from sentryspark.sources.rollup_store import add_states
from sentryspark.sources.session_store import PARTIALS, session_parts
from sentryspark.streaming.processors import Dedup, RuleProgress, Throttle

MATCH_SCHEMA = """
    rule_id STRING, severity STRING, event_id STRING, timestamp TIMESTAMP, agent_id STRING,
    agent_name STRING, session_id STRING, ms BIGINT, detail STRING, context STRING
"""
FLOW_SCHEMA = f"{MATCH_SCHEMA}, late BOOLEAN"
RULE_ERRORS = "rule_id STRING, name STRING, error STRING"
# Parameter: state groups over which the hits of a single-event rule are spread.
SINGLE_GROUPS = 64
# Parameters: state groups over which a sequence rule's sessions are spread, and the least length
# of the time blocks into which the rows of a window rule's key are cut.
SEQUENCE_GROUPS = 256
BLOCK_MS = HOUR_MS

# Constants of a rule that its state needs, by kind.
RULE_FACTS: dict[str, Callable[[Rule], dict]] = {
    "SingleEvent": lambda rule: {"detail": rule.detail(), "context": "{}"},
    "Temporal": lambda rule: {
        "window_ms": rule.window_ms, "threshold": rule.threshold, "is_rate": rule.is_rate,
        "minutes": rule.window_minutes, "span": span_text(rule.window_ms),
    },
    "Sequence": lambda rule: {
        "n_steps": len(rule.steps), "span_ms": rule.span_ms, "detail": rule.detail(),
        "context": sequence_context(rule),
    },
}


@dataclass(frozen=True)
class Lateness:
    """How far behind rows may be: to be evaluated, and to be kept as late rows."""

    delay: timedelta = timedelta(minutes=10)
    kept: timedelta = timedelta(hours=1)

    @property
    def delay_ms(self) -> int:
        return self.delay // timedelta(milliseconds=1)

    @property
    def kept_ms(self) -> int:
        return max(self.kept, self.delay) // timedelta(milliseconds=1)


@dataclass(frozen=True)
class Folders:
    """Tables and checkpoints of one deployment, below a folder the whole cluster can reach."""

    root: str

    @property
    def checkpoints(self) -> str:
        return f"{self.root}/checkpoints"


def with_lateness(events: DataFrame, lateness: Lateness = Lateness()) -> DataFrame:
    """Watermark on event time; zone-less times are read as UTC."""
    stamped = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return stamped.withWatermark("timestamp", f"{lateness.kept_ms} milliseconds")


def stream_rules(
    events: DataFrame, rules: list[Rule], members: DataFrame | None = None,
    lateness: Lateness = Lateness(),
) -> DataFrame:
    """Matches of all rules as a stream; ``late`` marks hits that came too late to be evaluated."""
    known = {(kind, number): RULE_FACTS[kind](rule)
             for kind in KINDS for number, rule in enumerate(of_kind(rules, kind))}
    grouped = grouped_hits(with_lateness(events, lateness), rules, members)
    return grouped.groupBy("rule_id", "key", "block").transformWithState(
        RuleProgress(lateness.delay_ms, lateness.kept_ms, known), FLOW_SCHEMA, "Append", "EventTime",
        eventTimeColumnName="timestamp",
    )


def grouped_hits(
    events: DataFrame, rules: list[Rule], members: DataFrame | None = None,
) -> DataFrame:
    """Hits of all rules with their state group (rule_id, key, block).

    Groups of a window rule are its keys cut into time blocks no shorter than the window, so that a
    key with most of the rows is no single task. A row whose window reaches into the next block is
    there a second time, marked as ``prior``.
    """
    hits = hit_facts(tagged_hits(events, rules, members), rules, {
        "SingleEvent": lambda rule: {}, "Sequence": lambda rule: {},
        "Temporal": lambda rule: {
            "window_ms": rule.window_ms, "block_ms": max(rule.window_ms, BLOCK_MS)},
    })
    kind = F.col("kind")
    key = F.when(kind == "SingleEvent", group_of("event_id", SINGLE_GROUPS)).when(
        kind == "Sequence", group_of("session_id", SEQUENCE_GROUPS)).otherwise(F.col("key"))
    own = F.when(kind == "Temporal", F.floor(F.col("ms") / F.col("block_ms")))
    reaches = F.col("ms") + F.col("window_ms").cast("double") > (
        (own.cast("double") + 1) * F.col("block_ms"))
    blocks = F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))
    keyed = hits.withColumns({"key": key, "own": own, "blocks": blocks})
    prior = F.coalesce(F.col("block") > F.col("own"), F.lit(False))
    return keyed.withColumn("block", F.explode("blocks")).withColumn("prior", prior).drop(
        "own", "blocks", "window_ms", "block_ms")


def group_of(column: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(groups)).cast("string")


def stream_dedup(matches: DataFrame, window_ms: int = NoiseLimits.dedup_ms) -> DataFrame:
    """First match per fingerprint and window, as a stream; late ones pass."""
    printed = matches.withColumn(
        "fingerprint",
        alert_fingerprint(F.col("rule_id"), F.col("agent_id"), F.col("severity")),
    )
    return printed.groupBy("fingerprint").transformWithState(
        Dedup(window_ms), f"{FLOW_SCHEMA}, fingerprint STRING", "Append", "EventTime",
        eventTimeColumnName="timestamp",
    )


def stream_throttle(
    survivors: DataFrame,
    limit: int = NoiseLimits.throttle_limit,
    window_ms: int = NoiseLimits.throttle_ms,
    lateness: Lateness = Lateness(),
) -> DataFrame:
    """Dedup survivors within their rule's limit, as a stream; late ones pass."""
    return survivors.groupBy("rule_id").transformWithState(
        Throttle(limit, window_ms, lateness.delay_ms), survivors.schema, "Append", "EventTime",
        eventTimeColumnName="timestamp",
    )


def stream_passed(
    matches: DataFrame, limits: NoiseLimits = NoiseLimits(), lateness: Lateness = Lateness()
) -> DataFrame:
    """Matches that pass dedup and throttle."""
    return stream_throttle(stream_dedup(matches, limits.dedup_ms), limits.throttle_limit,
                           limits.throttle_ms, lateness)


def write_stream(
    df: DataFrame, name: str, folders: Folders, each_batch, available_now: bool
) -> StreamingQuery:
    """Start a query whose micro-batches go to ``each_batch(frame, batch_id)``."""
    writer = (
        df.writeStream.queryName(name).outputMode("append").foreachBatch(each_batch)
        .option("checkpointLocation", f"{folders.checkpoints}/{name}")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_matches(spark: SparkSession, root: str) -> DataFrame:
    """Matches written so far by all sources, with ``source`` and ``batch_id``."""
    return read_table(spark, root, "matches", MATCH_SCHEMA)


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """Hits that came too late for their rules."""
    return read_table(spark, root, "late_events", MATCH_SCHEMA)


def write_matches(matches: DataFrame, source: str, batch_id: int, root: str) -> None:
    """Write one batch of matches of one source; a replay of the batch replaces it."""
    batch = Batch(matches.sparkSession, root, source, batch_id)
    batch.write("matches", matches.select(*MATCH_COLUMNS))
    batch.commit()


def ingest_batch(records: DataFrame, batch_id: int, folders: Folders) -> None:
    """One micro-batch of topic records: events, dead letters, sessions, roll-up states."""
    spark = records.sparkSession
    batch = Batch(spark, folders.root, "ingest", batch_id)
    kept, bad = decode_events(records)
    batch.write("dead_letters", dead_letters(bad))
    # Records are parsed once: everything after reads the batch's events back.
    events = batch.write(TABLE, stored_form(normalize_events(kept)), DAY)
    batch.write("sessions", session_parts(events))
    add_states(batch, events)
    batch.commit()


def start_ingest(
    records: DataFrame, folders: Folders, available_now: bool = False
) -> StreamingQuery:
    """Start the ingest query on topic records."""

    def each_batch(frame: DataFrame, batch_id: int) -> None:
        ingest_batch(frame, batch_id, folders)

    return write_stream(records, "ingest", folders, each_batch, available_now)


def alert_batch(
    passed: DataFrame, batch_id: int, folders: Folders, rules: DataFrame, events: DataFrame,
    suppressions: DataFrame, errors: DataFrame | None = None,
) -> None:
    """One micro-batch of matches behind dedup and throttle: alerts, links, outbox, marks, late rows.

    Alerts of earlier batches count as history; alerts of this batch's first try do not.
    """
    spark = passed.sparkSession
    batch = Batch(spark, folders.root, "detection", batch_id)
    with scratch(spark):
        # The stream's state may run once only, so its rows are written before anything reads them.
        rows = written(passed.select(*MATCH_COLUMNS, "late"), "passed")
        found = rows.where("NOT late").drop("late")
        batch.write("matches", found)
        batch.write("late_events", rows.where("late").drop("late"))
        if errors is not None:
            batch.write("rule_errors", errors)
        history = None if batch_id == 0 else read_alerts(spark, folders.root, batch_id).select(
            "agent_id", "triggered_at")
        started = read_table(spark, folders.root, "sessions", PARTIALS) if exists(
            spark, f"{folders.root}/sessions") else None
        add_alerts(batch, enrich(suppress(found, suppressions), rules, events, history, started))
    batch.commit()


def start_alerts(
    matches: DataFrame,
    events_table: Callable[[], DataFrame],
    read_rules: Callable[[], DataFrame],
    suppressions: Callable[[], DataFrame],
    folders: Folders,
    limits: NoiseLimits = NoiseLimits(),
    lateness: Lateness = Lateness(),
    available_now: bool = False,
) -> StreamingQuery:
    """Start dedup, throttle, suppression and enrichment on a stream of matches."""
    marked = with_lateness(matches, lateness).withColumn("late", F.lit(False))

    def each_batch(frame: DataFrame, batch_id: int) -> None:
        alert_batch(frame, batch_id, folders, read_rules(), events_table(), suppressions())

    return write_stream(
        stream_passed(marked, limits, lateness), "alerts", folders, each_batch, available_now)


def start_detection(
    events: DataFrame,
    events_table: Callable[[], DataFrame],
    read_rules: Callable[[], DataFrame],
    suppressions: Callable[[], DataFrame],
    folders: Folders,
    members: DataFrame | None = None,
    limits: NoiseLimits = NoiseLimits(),
    lateness: Lateness = Lateness(),
    available_now: bool = False,
) -> StreamingQuery:
    """Start the detection query on a stream of canonical events, with the rules as they are now."""
    rules, errors = load_rules(read_rules())
    passed = stream_passed(stream_rules(events, rules, members, lateness), limits, lateness)

    def each_batch(frame: DataFrame, batch_id: int) -> None:
        alert_batch(
            frame, batch_id, folders, read_rules(), events_table(), suppressions(), errors)

    return write_stream(passed, "detection", folders, each_batch, available_now)


def events_of_records(records: DataFrame) -> DataFrame:
    """Canonical events of a stream of topic records; dead letters are the ingest query's."""
    kept, _ = decode_events(records)
    return normalize_events(kept)


def start_flow(
    records: DataFrame,
    folders: Folders,
    read_rules: Callable[[], DataFrame],
    suppressions: Callable[[], DataFrame],
    members: DataFrame | None = None,
    limits: NoiseLimits = NoiseLimits(),
    lateness: Lateness = Lateness(),
    available_now: bool = False,
) -> list[StreamingQuery]:
    """Start the whole flow on topic records: the ingest and the detection query.

    Enrichment reads the committed events, so it sees what ingest has stored by then.
    """
    spark = records.sparkSession
    return [
        start_ingest(records, folders, available_now),
        start_detection(
            events_of_records(records), lambda: read_events(spark, folders.root), read_rules,
            suppressions, folders, members, limits, lateness, available_now),
    ]


def rules_version(rules: DataFrame) -> tuple:
    """A value that changes with the rule table's rows."""
    return tuple(rules.agg(F.count("*"), F.sum(F.xxhash64(*rules.columns).cast("decimal(38,0)"))).first())


def keep_running(
    start: Callable[[], StreamingQuery],
    read_rules: Callable[[], DataFrame],
    stopped: Callable[[], bool],
    poll_seconds: int = 5,
) -> int:
    """Run a query that ``start`` builds with the current rules; restart it when they have changed.

    A batch that the restart interrupts is run again with the new rules. Returns the number of
    starts; an error of the query is raised.
    """
    version, query, starts = rules_version(read_rules()), start(), 1
    while not stopped():
        if query.awaitTermination(poll_seconds):
            return starts
        current = rules_version(read_rules())
        if current != version:
            query.stop()
            version, query, starts = current, start(), starts + 1
    query.stop()
    return starts
