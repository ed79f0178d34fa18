"""From triggered results to alerts: dedup, throttle, suppress, enrich, route, follow up."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentryspark.functions.alert_text import (
    FALLBACK_RULE_NAME, alert_detail, alert_fingerprint, alert_identity, alert_title, rule_labels,
)
from sentryspark.functions.fields import event_millis, severity_order, time_bucket
from sentryspark.operators.chains import run_machines
from sentryspark.operators.sliding import (
    HOUR_MS, running_sum, sliding_count, sliding_distinct,
)
from sentryspark.schema import ALERT_MOVES, SEVERITIES
from sentryspark.session import cut_lineage

# Day column of partitioned events; a filter on it opens no other day.
DAY = "event_date"
MINUTE_MS = 60_000
DAY_MS = 24 * HOUR_MS
RECENT_TOOLS = 10
LIVE_FEED_SIZE = 50

# Channels with the lowest severity each one takes.
CHANNELS = {"live": "low", "webhook": "medium", "slack": "high", "pagerduty": "critical"}

# Delays before the retries of a failed notification, and the last attempt.
RETRY_DELAYS_SECONDS = [30, 120, 600]
MAX_ATTEMPTS = 3


@dataclass(frozen=True)
class NoiseLimits:
    """Settings of the noise reduction."""

    dedup_ms: int = 15 * MINUTE_MS
    throttle_limit: int = 10
    throttle_ms: int = 5 * MINUTE_MS


def dedup(matches: DataFrame, window_ms: int = NoiseLimits.dedup_ms) -> DataFrame:
    """First match per fingerprint, then none until ``window_ms`` after the accepted one.

    Dropped matches do not extend the window. Matches of one millisecond are reduced to
    their first before the shuffle, which also bounds what a time block can hold.
    """
    printed = matches.withColumn(
        "fingerprint",
        alert_fingerprint(F.col("rule_id"), F.col("agent_id"), F.col("severity")),
    )
    rest = [c for c in printed.columns if c not in ("fingerprint", "ms", "event_id")]
    candidates = (
        printed.groupBy("fingerprint", "ms")
        .agg(F.min(F.struct("event_id", *rest)).alias("row"))
        .select("fingerprint", "ms", "row.*")
    )
    # Taking the only step of the first kind, with a second step that never comes.
    machine = candidates.select(
        "*", F.array(F.lit(0)).alias("steps"), F.lit(2).cast("long").alias("n_steps"),
        F.lit(window_ms).cast("long").alias("span_ms"),
    )
    return run_machines(machine, ["fingerprint"], [], "first").select(*printed.columns)


def throttle_counts(
    survivors: DataFrame, window_ms: int = NoiseLimits.throttle_ms, block_ms: int = HOUR_MS
) -> DataFrame:
    """Add ``throttle_count``: distinct milliseconds of the rule in ``(t - window_ms, t]``."""
    return sliding_distinct(survivors, ["rule_id"], "ms", window_ms, "throttle_count", block_ms)


def throttle(
    survivors: DataFrame,
    limit: int = NoiseLimits.throttle_limit,
    window_ms: int = NoiseLimits.throttle_ms,
) -> DataFrame:
    """Drop results of a rule beyond ``limit`` per window; dropped ones count as well."""
    return throttle_counts(survivors, window_ms).where(F.col("throttle_count") <= limit)


def suppression_ways(suppressions: DataFrame) -> list[tuple[DataFrame, list[str]]]:
    """Suppressions by what they name: the rule alone, the agent alone, or both."""
    no_rule, no_agent = F.col("rule_id").isNull(), F.col("agent_id").isNull()
    return [
        (suppressions.where(~no_rule & no_agent), ["rule_id"]),
        (suppressions.where(no_rule & ~no_agent), ["agent_id"]),
        (suppressions.where(~no_rule & ~no_agent), ["rule_id", "agent_id"]),
    ]


def join_suppressions(
    matches: DataFrame, suppressions: DataFrame, keys: list[str], how: str
) -> DataFrame:
    """Semi or anti join on equal ``keys`` with suppressions in force at the match's time."""
    left, right = matches.alias("m"), suppressions.alias("s")
    in_force = (F.col("s.created_at") <= F.col("m.timestamp")) & (
        F.col("m.timestamp") < F.col("s.expires_at")
    )
    same = [F.col(f"m.{key}") == F.col(f"s.{key}") for key in keys]
    return left.join(right, reduce(lambda a, b: a & b, same, in_force), how)


def suppress(matches: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Matches that no suppression in force names by rule, agent or both."""
    for some, keys in suppression_ways(suppressions):
        matches = join_suppressions(matches, some, keys, "left_anti")
    return matches


def flag_suppressed(matches: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Add ``is_suppressed``; every way to be named is an equality join of its own."""
    named = [
        join_suppressions(matches, some, keys, "left_semi").select("rule_id", "event_id")
        for some, keys in suppression_ways(suppressions)
    ]
    hits = reduce(DataFrame.unionByName, named).distinct().withColumn("_hit", F.lit(True))
    return matches.join(hits, ["rule_id", "event_id"], "left").select(
        *matches.columns, F.col("_hit").isNotNull().alias("is_suppressed")
    )


def label_stages(
    matches: DataFrame, suppressions: DataFrame, limits: NoiseLimits = NoiseLimits()
) -> DataFrame:
    """Dedup survivors with the ``stage`` they end in: throttled, suppressed or created."""
    survivors = cut_lineage(dedup(matches, limits.dedup_ms))
    counted = cut_lineage(throttle_counts(survivors, limits.throttle_ms))
    stage = (
        F.when(F.col("throttle_count") > limits.throttle_limit, F.lit("throttled"))
        .when(F.col("is_suppressed"), F.lit("suppressed")).otherwise(F.lit("created"))
    )
    flagged = flag_suppressed(counted, suppressions)
    return flagged.withColumn("stage", stage).drop("is_suppressed", "throttle_count")


def created_matches(
    matches: DataFrame, suppressions: DataFrame, limits: NoiseLimits = NoiseLimits()
) -> DataFrame:
    """Matches that become alerts: dedup, then throttle, then suppression."""
    staged = label_stages(matches, suppressions, limits)
    return staged.where("stage = 'created'").drop("stage")


def stage_counters(matches: DataFrame, staged: DataFrame) -> DataFrame:
    """Counts per stage; received is the sum of the other stages, created also by severity."""
    received = matches.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("received").alias("stage"), F.lit("all").alias("severity"), "n"
    )
    ends = cut_lineage(staged.groupBy("stage", "severity").agg(F.count(F.lit(1)).alias("n")))
    totals = ends.groupBy("stage").agg(F.sum("n").alias("n"))
    by_severity = ends.where("stage = 'created'")
    counted = received.unionByName(
        totals.select("stage", F.lit("all").alias("severity"), "n")
    )
    dropped = counted.agg(
        F.sum(F.when(F.col("stage") == "received", F.col("n")).otherwise(-F.col("n"))).alias("n")
    ).select(F.lit("deduplicated").alias("stage"), F.lit("all").alias("severity"), "n")
    return counted.unionByName(dropped).unionByName(by_severity)


def enrich(
    created: DataFrame,
    rules: DataFrame,
    events: DataFrame,
    history: DataFrame | None = None,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Alerts with rule name and labels, recent alerts, session size and recent tools.

    ``history`` are alerts of earlier runs (agent_id, triggered_at), ``sessions`` (session_id,
    started_at) tells from when on the alerts' sessions have events. Events and alerts are
    read as of each alert's own time, and only of the time, sessions and agents that the alerts
    can refer to; day-partitioned events are pruned by it.
    """
    named = created.join(
        rules.select(F.col("id").alias("rule_id"), F.col("name").alias("_name"), "actions_json"),
        "rule_id", "left",
    )
    alerts = named.select(
        alert_identity(F.col("rule_id"), F.col("event_id")).alias("alert_id"), "rule_id",
        F.coalesce("_name", F.lit(FALLBACK_RULE_NAME)).alias("rule_name"), "severity",
        F.lit("open").alias("status"),
        alert_title(F.col("severity"), F.col("_name"), F.col("agent_name")).alias("title"),
        alert_detail(F.col("detail")).alias("detail"), "context", "agent_id", "agent_name",
        F.coalesce("session_id", F.lit("")).alias("session_id"), "event_id", "ms",
        F.col("timestamp").alias("triggered_at"), rule_labels(F.col("actions_json")).alias("labels"),
    )
    alerts = cut_lineage(alerts)
    first, last = alerts.agg(F.min("triggered_at"), F.max("triggered_at")).first()
    if history is not None:
        history = within(history, "triggered_at", first, last, timedelta(days=1)).join(
            alerts.select("agent_id").distinct(), "agent_id", "left_semi")
    began = None if sessions is None else sessions.join(
        alerts.select("session_id").distinct(), "session_id", "left_semi").agg(F.min("started_at")).first()[0]
    facts = [
        recent_alert_counts(alerts, history),
        session_event_counts(alerts, within(events, "timestamp", began, last)),
        recent_tools(alerts, within(events, "timestamp", first, last, timedelta(hours=1))),
    ]
    joined = reduce(lambda left, right: left.join(right, "alert_id", "left"), facts, alerts)
    no_tools = F.array().cast("array<string>")
    return joined.withColumn("recent_tools", F.coalesce("recent_tools", no_tools)).drop("ms")


def within(
    rows: DataFrame, column: str, first: datetime | None, last: datetime | None,
    back: timedelta = timedelta(0),
) -> DataFrame:
    """Rows from ``back`` before ``first`` (without it, from ever) up to ``last``; none without ``last``.

    Days are a day wider on either side, as the driver may be in another time zone.
    """
    if last is None:
        return rows.where(F.lit(False))
    day = timedelta(days=1)
    test, days = F.col(column) <= F.lit(last), F.col(DAY) <= F.lit((last + day).date())
    if first is not None:
        since = first - back
        test &= F.col(column) >= F.lit(since)
        days &= F.col(DAY) >= F.lit((since - day).date())
    return rows.where(test & days if DAY in rows.columns else test)


def recent_alert_counts(alerts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(alert_id, recent_alert_count): earlier alerts of the agent in the last 24 hours."""
    timeline = alerts.select("alert_id", "agent_id", "ms")
    if history is not None:
        known = history.select(
            F.lit(None).cast("string").alias("alert_id"), "agent_id",
            event_millis("triggered_at").alias("ms"),
        )
        timeline = timeline.unionByName(known)
    timeline = timeline.withColumn("_window", F.lit(DAY_MS + 1))
    counted = sliding_count(timeline, ["agent_id"], "ms", "_window", ["alert_id"], "_count")
    return counted.where("alert_id IS NOT NULL").select(
        "alert_id", (F.col("_count") - 1).alias("recent_alert_count")
    )


def session_event_counts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """(alert_id, session_event_count): events of the session up to the triggering one."""
    wanted = alerts.select("session_id").distinct()
    steps = events.select(
        F.lit(None).cast("string").alias("alert_id"), "session_id",
        event_millis().alias("ms"), "event_id", F.lit(1).alias("_step"),
    ).join(wanted, "session_id", "left_semi")
    probes = alerts.select("alert_id", "session_id", "ms", "event_id", F.lit(0).alias("_step"))
    order = [F.col("ms"), F.col("event_id"), F.col("_step").desc()]
    summed = running_sum(steps.unionByName(probes), ["session_id"], "ms", order, "_step", "_sum")
    return summed.where("alert_id IS NOT NULL").select(
        "alert_id", F.col("_sum").alias("session_event_count")
    )


def recent_tools(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """(alert_id, recent_tools): up to ten distinct tools of the last hour, sorted.

    Tool use is first reduced to its first and last time per session, hour and tool. An alert
    looks at its own hour (used by then?) and the hour before (used late enough?), which is
    exact and never joins an alert with single events. Alerts without tools have no row.
    """
    hour = time_bucket("hour", "timestamp")
    wanted = alerts.select("session_id").distinct()
    used = events.where("tool_name IS NOT NULL").join(wanted, "session_id", "left_semi").groupBy(
        "session_id", hour.alias("hour"), "tool_name"
    ).agg(F.min("timestamp").alias("first_use"), F.max("timestamp").alias("last_use"))
    own_hour = time_bucket("hour", "triggered_at")
    an_hour = F.expr("INTERVAL 1 HOUR")
    looks = alerts.select(
        "alert_id", "session_id", "triggered_at",
        F.explode(F.array(own_hour, own_hour - an_hour)).alias("hour"),
    )
    in_hour = (F.col("hour") == own_hour) & (F.col("first_use") <= F.col("triggered_at"))
    before = (F.col("hour") < own_hour) & (F.col("last_use") >= F.col("triggered_at") - an_hour)
    hits = (
        looks.join(used, ["session_id", "hour"]).where(in_hour | before)
        .select("alert_id", "tool_name").distinct()
    )
    by_alert = Window.partitionBy("alert_id").orderBy("tool_name")
    return (
        hits.withColumn("_rank", F.row_number().over(by_alert))
        .where(F.col("_rank") <= RECENT_TOOLS)
        .groupBy("alert_id").agg(F.array_sort(F.collect_list("tool_name")).alias("recent_tools"))
    )


def route(alerts: DataFrame, channels: dict[str, str] = CHANNELS) -> DataFrame:
    """One row per alert and channel whose lowest severity the alert reaches."""
    offers = F.array(*[
        F.struct(F.lit(name).alias("channel"), F.lit(SEVERITIES.index(lowest)).alias("least"))
        for name, lowest in channels.items()
    ])
    reached = F.filter(offers, lambda offer: offer["least"] <= severity_order(F.col("severity")))
    return alerts.withColumn("channel", F.explode(F.transform(reached, lambda o: o["channel"])))


def live_feed(alerts: DataFrame, size: int = LIVE_FEED_SIZE) -> DataFrame:
    """Newest ``size`` alerts per topic: all, one per agent, one per severity."""
    topics = F.array(
        F.lit("all"), F.concat(F.lit("agent:"), F.col("agent_id")),
        F.concat(F.lit("severity:"), F.col("severity")),
    )
    newest = Window.partitionBy("topic").orderBy(F.desc("triggered_at"), F.asc("alert_id"))
    return (
        alerts.withColumn("topic", F.explode(topics))
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= size)
    )


def new_outbox(routed: DataFrame) -> DataFrame:
    """Outbox rows of routed alerts before the first delivery."""
    return routed.select(
        "alert_id", "channel", F.lit("pending").alias("state"), F.lit(0).alias("attempts"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"),
    )


def retry_plan(outbox: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outbox after a delivery round: outcomes are (alert_id, channel, delivered, at).

    Failures wait 30 s, then 120 s; the third one is final. Rows without outcome stay.
    """
    failures = F.col("attempts") + 1
    delays = F.array(*[F.lit(seconds) for seconds in RETRY_DELAYS_SECONDS])
    delay = F.make_dt_interval(secs=F.try_element_at(delays, failures).cast("decimal(18,6)"))
    failed = F.col("delivered") == F.lit(False)
    again = failed & (failures < MAX_ATTEMPTS)
    joined = outbox.join(outcomes, ["alert_id", "channel"], "left")
    return joined.select(
        "alert_id", "channel",
        F.when(F.col("delivered"), F.lit("sent")).when(again, F.lit("pending"))
        .when(failed, F.lit("failed")).otherwise(F.col("state")).alias("state"),
        F.when(failed, failures).otherwise(F.col("attempts")).alias("attempts"),
        F.when(again, F.col("at") + delay)
        .when(F.col("delivered").isNull(), F.col("next_attempt_at")).alias("next_attempt_at"),
    )


def transition_alerts(alerts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (alert_id, target, decided_at, note) commands; returns alerts and rejected commands.

    The earliest command of an alert in the batch is tried; later ones are rejected.
    """
    order = Window.partitionBy("alert_id").orderBy("decided_at", "target")
    numbered = commands.withColumn("_turn", F.row_number().over(order))
    tried, late = numbered.where("_turn = 1").drop("_turn"), numbered.where("_turn > 1")
    legal = reduce(lambda a, b: a | b, [
        (F.col("status") == source) & (F.col("target") == target)
        for source, target in ALERT_MOVES
    ])
    joined = alerts.join(tried, "alert_id", "left")
    moves = F.coalesce(legal, F.lit(False))

    def moved(target: str, value, column: str):
        return F.when(moves & (F.col("target") == target), value).otherwise(F.col(column))

    changed = {
        "acknowledged_at": moved("acknowledged", F.col("decided_at"), "acknowledged_at"),
        "resolved_at": moved("resolved", F.col("decided_at"), "resolved_at"),
        "resolution_note": moved("resolved", F.col("note"), "resolution_note"),
        "status": F.when(moves, F.col("target")).otherwise(F.col("status")),
    }
    updated = joined.select(*[changed.get(c, F.col(c)).alias(c) for c in alerts.columns])
    statuses = alerts.select("alert_id", "status")
    refused = tried.join(statuses, "alert_id", "left").where(~F.coalesce(legal, F.lit(False)))
    reason = F.when(F.col("status").isNull(), F.lit("Alert not found")).otherwise(
        F.concat(F.lit("Cannot move from "), F.col("status"), F.lit(" to "), F.col("target"))
    )
    rejected = refused.select("alert_id", "target", reason.alias("error")).unionByName(
        late.select("alert_id", "target", F.lit("Only one command per batch").alias("error"))
    )
    return updated, rejected
